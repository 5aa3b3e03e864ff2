"""Queries of the bias battery: discrimination, display order, consistency, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.extraction import verdict_of
from plumbline.operators import agreement, consistency, discrimination, swaps
from plumbline.plans.registry import Inputs, query
from plumbline.plans.shared import rounded, spread, sql_wilson

ROWS_SQL = """
rows_ as (
  select j.*, r.score as ref,
    case when j.score is null or r.score is null then null
      when j.score < r.score then 1 else 0 end as correct,
    case when j.score is null or r.score is null then null
      when j.score = r.score then 1 else 0 end as tie
  from fx_judgments j left join fx_reference_scores r
    on j.judge = r.judge and j.item_id = r.item_id)"""


def spread_judgments(t: Inputs) -> DataFrame:
    """The judgments dealt as their join with reference scores wants them."""
    return spread(t.view("judgments"), ["judge", "item_id"])


def judged_rows(t: Inputs) -> DataFrame:
    return discrimination.discrimination_rows(spread_judgments(t), t.view("reference_scores"))


@query(
    "discrimination_rows",
    f"""with {ROWS_SQL}
select judge, config, item_id, degradation, severity, replicate, ref as reference_score,
  score as variant_score, correct, tie from rows_""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    return judged_rows(t).select(
        "judge",
        "config",
        "item_id",
        "degradation",
        "severity",
        F.col("replicate").cast("bigint").alias("replicate"),
        "reference_score",
        "variant_score",
        "correct",
        "tie",
    )


@query(
    "discrimination_report",
    f"""with {ROWS_SQL}
select case when grouping(severity) = 0 then 'severity' when grouping(degradation) = 0
    then 'degradation' else 'judge' end as level, judge, degradation, severity,
  count(correct) as n_pairs, sum(correct)::bigint as n_correct,
  round(avg(correct), 6) as accuracy,
  round({sql_wilson("sum(correct)", "count(correct)", "lo")}, 6) as lo,
  round({sql_wilson("sum(correct)", "count(correct)", "hi")}, 6) as hi,
  round(sum(tie) / greatest(count(correct), 1), 6) as tie_rate,
  round((count(*) - count(correct)) / count(*), 6) as parse_failure_rate,
  round(avg(score), 6) as mean_variant_score
from rows_ group by grouping sets ((judge), (judge, degradation), (judge, degradation, severity))""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    return rounded(discrimination.discrimination_report(judged_rows(t)))


@query(
    "judge_summary",
    f"""with {ROWS_SQL},
priced as (select *, (prompt_tokens * 0.1 + completion_tokens * 0.4)::double / 1000000 as cost
  from rows_),
refs as (select judge, coalesce(sum(score), 0) / count(*) as mean_reference_score,
  sum((prompt_tokens * 0.1 + completion_tokens * 0.4)::double / 1000000) as cost
  from fx_reference_scores group by judge),
worst as (select judge, arg_min(degradation, (acc, degradation)) as worst_degradation from
  (select judge, degradation, avg(correct) as acc from rows_ group by 1, 2) group by judge)
select p.judge, count(correct) as n_pairs, round(avg(correct), 6) as accuracy,
  round(sum(tie) / greatest(count(correct), 1), 6) as tie_rate,
  round((count(*) - count(correct)) / count(*), 6) as parse_failure_rate,
  round(any_value(r.mean_reference_score), 6) as mean_reference_score,
  round(sum(p.cost) + any_value(r.cost), 6) as cost_usd_total,
  round(avg(latency_ms), 6) as latency_ms_mean,
  any_value(worst_degradation) as worst_degradation
from priced p join refs r on p.judge = r.judge join worst w on w.judge = p.judge group by p.judge""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    cost = (F.col("prompt_tokens") * 0.1 + F.col("completion_tokens") * 0.4) / 1e6
    rows = judged_rows(t).withColumn("cost_usd", cost)
    references = t.view("reference_scores").withColumn("cost_usd", cost)
    return rounded(discrimination.judge_summary(rows, references))


def ordered_answers(t: Inputs) -> DataFrame:
    """The raw pair view as one row per display order."""
    raw = t.view("pair_raw").withColumn(
        "_order",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("first"), F.col("fwd_text").alias("text")),
                F.struct(F.lit(False).alias("first"), F.col("rev_text").alias("text")),
            )
        ),
    )
    return raw.select(
        "uid",
        "judge",
        F.lit("pairwise").alias("config"),
        F.lit(0).alias("replicate"),
        "degradation",
        "severity",
        "source_id",
        F.col("_order.first").alias("reference_first"),
        verdict_of(F.col("_order.text")).alias("verdict"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("tokens"),
        "latency_ms",
        ((F.col("prompt_tokens") * 0.1 + F.col("completion_tokens") * 0.4) / 1e6).alias("cost_usd"),
    )


def outcomes(t: Inputs) -> DataFrame:
    return swaps.resolve_swaps(ordered_answers(t), ("degradation", "severity", "source_id"))


SQL_VERDICT = """upper(coalesce(
  nullif(regexp_extract({c}, '(?i)VERDICT\\s*[:=]\\s*\\**\\s*(A|B|TIE)\\b', 1), ''),
  nullif(regexp_extract({c}, '(?i)\\b(?:answer|trajectory|option)\\s+(A|B)\\s+is\\s+better', 1), ''),
  nullif(regexp_extract({c}, '(?im)^\\s*(A|B|tie)\\s*$', 1), '')))"""


def sql_clean(column: str) -> str:
    """Reasoning removed, one tag at a time: the SQL engine's regex has no back-references."""
    out = column
    for tag in ("think", "thinking", "reasoning"):
        out = f"regexp_replace({out}, '(?is)<{tag}>.*?</{tag}>', '', 'g')"
    return f"trim(regexp_replace({out}, '(?is)<(?:think|thinking|reasoning)>.*', '', 'g'), ' \t\n\r')"


OUTCOMES_SQL = f"""
verdicts as (select *, {SQL_VERDICT.format(c=sql_clean("fwd_text"))} as f,
  {SQL_VERDICT.format(c=sql_clean("rev_text"))} as r from fx_pair_raw),
sides as (select *, case f when 'A' then 'REF' when 'B' then 'DEG' when 'TIE' then 'tie' end as fwd,
  case r when 'A' then 'DEG' when 'B' then 'REF' when 'TIE' then 'tie' end as rev,
  right(sha256(uid || '|' || judge || '|pairwise|0'), 1) in
    ('0','2','4','6','8','a','c','e') as pick_first from verdicts),
outcomes as (select uid, judge, degradation, severity, source_id, fwd as forward, rev as reverse,
  coalesce(fwd = rev, false) as consistent,
  case when fwd = rev then fwd else 'inconsistent' end as verdict,
  coalesce((fwd = 'REF')::int, 0) as correct_ref_first,
  coalesce((rev = 'REF')::int, 0) as correct_deg_first,
  coalesce((case when pick_first then fwd else rev end = 'REF')::int, 0) as correct_single_random,
  coalesce((fwd = 'REF' and rev = 'REF')::int, 0) as correct_swapped,
  2 * latency_ms as latency_ms,
  2 * (prompt_tokens * 0.1 + completion_tokens * 0.4)::double / 1000000 as cost_usd,
  2 * (prompt_tokens + completion_tokens)::bigint as tokens,
  fwd is not null and rev is not null as parsed_ok from sides)"""


@query(
    "swap_resolution",
    f"""with {OUTCOMES_SQL} select * exclude (latency_ms, cost_usd),
  round(latency_ms, 6) as latency_ms, round(cost_usd, 9) as cost_usd from outcomes""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    return outcomes(t).drop("config", "replicate").withColumn(
        "latency_ms", F.round("latency_ms", 6)
    ).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "both_display_orders",
    """select uid, judge, reference_first, case when reference_first then fwd_text else rev_text end
  as option_a, case when reference_first then rev_text else fwd_text end as option_b
from (select *, unnest([true, false]) as reference_first from fx_pair_raw)""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    pairs = t.view("pair_raw").withColumnsRenamed({"fwd_text": "reference", "rev_text": "degraded"})
    return swaps.both_orders(pairs).select(
        "uid", "judge", "reference_first", "option_a", "option_b"
    )


POSITION_SQL = f"""with {OUTCOMES_SQL}
select case when grouping(degradation) = 0 then 'degradation' else 'judge' end as level, judge,
  degradation, count(*) as n_pairs,
  round(avg((not consistent)::int), 6) as inconsistency_rate,
  round({sql_wilson("sum((not consistent)::int)", "count(*)", "lo")}, 6) as lo,
  round({sql_wilson("sum((not consistent)::int)", "count(*)", "hi")}, 6) as hi,
  round(avg(correct_ref_first), 6) as accuracy_reference_first,
  round(avg(correct_deg_first), 6) as accuracy_degraded_first,
  round(avg(correct_single_random), 6) as accuracy_random_order,
  round(avg(correct_swapped), 6) as accuracy_swap_and_average,
  round(avg((coalesce(forward = 'tie', false) or coalesce(reverse = 'tie', false))::int), 6)
    as tie_rate,
  round(avg((not parsed_ok)::int), 6) as parse_failure_rate,
  round(avg(correct_ref_first) - avg(correct_single_random), 6) as fixed_order_inflation,
  round(avg(correct_swapped) - avg(correct_single_random), 6) as swap_vs_single_call,
  round(sum(cost_usd), 6) as cost_usd_total, 2 as calls_per_comparison
from outcomes group by grouping sets ((judge), (judge, degradation))"""


@query("position_report", POSITION_SQL, "pair_raw")
def _(t: Inputs) -> DataFrame:
    return rounded(swaps.position_report(outcomes(t)))


@query(
    "swap_economics",
    f"""with {OUTCOMES_SQL} select judge, 2 as extra_calls_multiplier,
  round(avg(correct_swapped) - avg(correct_single_random), 6) as accuracy_gain_over_single_call,
  round(avg((not consistent)::int), 6) as inconsistency_rate from outcomes group by judge""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    return rounded(swaps.swap_economics(swaps.position_report(outcomes(t))))


@query(
    "trace_blindness",
    f"""with {OUTCOMES_SQL}
select case when grouping(severity) = 0 then 'severity' when grouping(degradation) = 0
    then 'degradation' else 'judge' end as level, judge, degradation, severity,
  case degradation when '1-URGENT' then 'argument blindness' when '2-HIGH' then 'path blindness'
    else degradation end as label, count(*) as n,
  round(avg(correct_swapped), 6) as detection_accuracy,
  round(1 - avg(correct_swapped), 6) as miss_rate,
  round({sql_wilson("sum(correct_swapped)", "count(*)", "lo")}, 6) as lo,
  round({sql_wilson("sum(correct_swapped)", "count(*)", "hi")}, 6) as hi,
  round(avg((not consistent)::int), 6) as order_inconsistency
from outcomes group by grouping sets ((judge), (judge, degradation), (judge, degradation, severity))""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    labels = {"1-URGENT": "argument blindness", "2-HIGH": "path blindness"}
    return rounded(swaps.trace_blindness(outcomes(t), labels))


@query(
    "worst_blindness",
    f"""with {OUTCOMES_SQL},
by_defect as (select judge, degradation, avg(correct_swapped) as acc from outcomes group by 1, 2)
select judge, arg_min(degradation, (acc, degradation)) as degradation,
  arg_min(degradation, (acc, degradation)) as label, round(min(acc), 6) as detection_accuracy,
  round(1 - min(acc), 6) as miss_rate from by_defect group by judge""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    return rounded(swaps.worst_blindness(swaps.trace_blindness(outcomes(t))))


SQL_BAND = """case when score is null then null when score >= 9 then 'excellent'
  when score >= 7 then 'good' when score >= 5 then 'adequate' when score >= 3 then 'poor'
  else 'bad' end"""


@query(
    "score_bands",
    f"""select judge, {SQL_BAND} as band, count(*) as n from fx_judgments group by all""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return (
        t.view("judgments")
        .groupBy("judge", consistency.band(F.col("score")).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def runs(t: Inputs) -> DataFrame:
    """Replicated scores: judge and prompt config together make one judge."""
    return t.view("judgments").select(
        F.concat_ws("/", "judge", "config").alias("judge"), "item_id", "replicate", "score"
    )


RUNS_SQL = f"""
runs as (select judge || '/' || config as judge, item_id, replicate, score, {SQL_BAND} as band
  from fx_judgments)"""


@query(
    "flip_rates",
    f"""with {RUNS_SQL},
items as (select judge, item_id, (count(distinct band) > 1)::int as bf,
  (count(distinct score >= 7) > 1)::int as df,
  case when count(score) > 1 then stddev_pop(score) end as sd from runs group by 1, 2)
select judge, count(*) as n_items, round(avg(bf), 6) as verdict_flip_rate,
  round({sql_wilson("sum(bf)", "count(*)", "lo")}, 6) as verdict_flip_lo,
  round({sql_wilson("sum(bf)", "count(*)", "hi")}, 6) as verdict_flip_hi,
  round(avg(df), 6) as accept_reject_flip_rate,
  round({sql_wilson("sum(df)", "count(*)", "lo")}, 6) as accept_reject_flip_lo,
  round({sql_wilson("sum(df)", "count(*)", "hi")}, 6) as accept_reject_flip_hi,
  round(coalesce(avg(sd), 0), 6) as mean_score_sd, round(coalesce(max(sd), 0), 6) as max_score_sd
from items group by judge""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return rounded(consistency.flip_rates(runs(t)))


@query(
    "replicate_disagreement",
    f"""with {RUNS_SQL},
pairs as (select a.judge, a.replicate as ra, b.replicate as rb,
  avg(((a.score >= 7) <> (b.score >= 7))::int) as share
  from runs a join runs b on a.judge = b.judge and a.item_id = b.item_id
    and a.replicate < b.replicate
  where a.score is not null and b.score is not null group by 1, 2, 3)
select judge, count(*) as n_run_pairs, round(avg(share), 6) as two_run_decision_disagreement
from pairs group by judge""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return rounded(consistency.replicate_disagreement(runs(t)))


@query(
    "agreement_report",
    f"""with {RUNS_SQL},
m as (select judge, item_id, band, count(*) as c, sum(count(*)) over (partition by judge, item_id)
  as m from runs where band is not null group by 1, 2, 3),
per_item as (select judge, item_id, any_value(m) as m,
  (any_value(m) * any_value(m) - sum(c * c))::double / (any_value(m) - 1) as dis
  from m where m > 1 group by 1, 2),
obs as (select judge, sum(dis) / sum(m) as d_o from per_item group by 1),
cats as (select judge, band, sum(c) as c from m where m > 1 group by 1, 2),
exp_ as (select judge, 1 - sum(c * (c - 1))::double / (sum(c) * (sum(c) - 1)) as d_e
  from cats group by 1),
pairs as (select a.judge, a.replicate as ra, b.replicate as rb, a.band as x, b.band as y
  from runs a join runs b on a.judge = b.judge and a.item_id = b.item_id
    and a.replicate < b.replicate where a.band is not null and b.band is not null),
po as (select judge, ra, rb, count(*) as n, avg((x = y)::int) as po from pairs group by 1, 2, 3),
mx as (select judge, ra, rb, x as c, count(*) as n from pairs group by all),
my as (select judge, ra, rb, y as c, count(*) as n from pairs group by all),
pe as (select mx.judge, mx.ra, mx.rb, sum(mx.n * my.n)::double as s from mx join my
  on mx.judge = my.judge and mx.ra = my.ra and mx.rb = my.rb and mx.c = my.c group by 1, 2, 3),
ks as (select po.judge, case when coalesce(s, 0) / (n * n) >= 1 then 1.0
  else (po - coalesce(s, 0) / (n * n)) / (1 - coalesce(s, 0) / (n * n)) end as k
  from po left join pe on po.judge = pe.judge and po.ra = pe.ra and po.rb = pe.rb)
select o.judge, round(any_value(case when d_e <= 0 then 1 else 1 - d_o / d_e end), 6)
  as krippendorff_alpha, round(avg(k), 6) as mean_pairwise_kappa
from obs o join exp_ e on o.judge = e.judge left join ks on ks.judge = o.judge group by o.judge""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return rounded(consistency.agreement_report(runs(t)))


SIMPSON = """(select sum(case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end
  * exp(-(z * i / 4000.0) * (z * i / 4000.0))) * z / 4000.0 / 3 from range(0, 4001) r(i))"""


@query(
    "mcnemar_by_judge",
    f"""with {OUTCOMES_SQL},
n as (select judge, degradation, count(*) filter (correct_ref_first = 1 and correct_deg_first = 0)
  as b, count(*) filter (correct_deg_first = 1 and correct_ref_first = 0) as c
  from outcomes group by 1, 2),
s as (select *, (b + c) < 25 as exact, case when b + c = 0 then 0 when b + c < 25 then least(b, c)
  else (abs(b - c) - 1) ** 2 / (b + c) end::double as statistic,
  sqrt(case when b + c >= 25 then (abs(b - c) - 1) ** 2 / (b + c) else 0 end / 2) as z from n)
select judge, degradation, b, c, exact, round(statistic, 6) as statistic,
  round(case when b + c = 0 then 1 when exact then least(1, 2 * list_sum(list_transform(
      range(0, least(b, c) + 1), lambda k: gamma(b + c + 1) / gamma(k + 1) / gamma(b + c - k + 1)))
      / 2 ** (b + c))
    when z > 6 then 0
    else 1 - 2 / sqrt(pi()) * {SIMPSON} end, 6) as p_value from s""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    late = outcomes(t)
    return rounded(
        agreement.mcnemar(late, ["judge", "degradation"], "correct_ref_first", "correct_deg_first")
    )


@query(
    "mcnemar_few_discordant",
    f"""with {OUTCOMES_SQL},
n as (select source_id, judge, degradation, severity,
  count(*) filter (correct_ref_first = 1 and correct_deg_first = 0) as b,
  count(*) filter (correct_deg_first = 1 and correct_ref_first = 0) as c
  from outcomes group by 1, 2, 3, 4)
select *, (b + c) < 25 as exact, case when (b + c) < 25 then least(b, c) end::double as fewer,
  round(case when b + c = 0 then 1 when (b + c) < 25 then least(1, 2 * list_sum(list_transform(
      range(0, least(b, c) + 1), lambda k: gamma(b + c + 1) / gamma(k + 1) / gamma(b + c - k + 1)))
      / 2 ** (b + c)) end, 6) as p_exact from n""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    keys = ["source_id", "judge", "degradation", "severity"]
    tested = agreement.mcnemar(outcomes(t), keys, "correct_ref_first", "correct_deg_first")
    exact = F.col("exact")
    return rounded(
        tested.select(
            *keys,
            "b",
            "c",
            "exact",
            F.when(exact, F.least("b", "c").cast("double")).alias("fewer"),
            F.when(exact, F.col("p_value")).alias("p_exact"),
        )
    )


@query(
    "kappa_of_orders",
    f"""with {OUTCOMES_SQL},
p as (select judge, forward as x, reverse as y from outcomes
  where forward is not null and reverse is not null),
po as (select judge, count(*) as n, avg((x = y)::int) as po from p group by 1),
mx as (select judge, x as c, count(*) as n from p group by 1, 2),
my as (select judge, y as c, count(*) as n from p group by 1, 2),
pe as (select mx.judge, sum(mx.n * my.n)::double as s from mx join my
  on mx.judge = my.judge and mx.c = my.c group by 1)
select po.judge, n, round((po - coalesce(s, 0) / n / n) / (1 - coalesce(s, 0) / n / n), 6) as kappa
from po left join pe on po.judge = pe.judge""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    both = outcomes(t).where(F.col("parsed_ok"))
    return rounded(agreement.kappa(both, ["judge"], "forward", "reverse"))


@query(
    "krippendorff_by_config",
    f"""with m as (select config, item_id, {SQL_BAND} as band, count(*) as c,
  sum(count(*)) over (partition by config, item_id) as m
  from fx_judgments where score is not null group by 1, 2, 3),
per_item as (select config, item_id, any_value(m) as m,
  (any_value(m) * any_value(m) - sum(c * c))::double / (any_value(m) - 1) as dis
  from m where m > 1 group by 1, 2),
obs as (select config, sum(m)::bigint as n_ratings, sum(dis) / sum(m) as d_o from per_item group by 1),
cats as (select config, band, sum(c) as c from m where m > 1 group by 1, 2),
exp_ as (select config, 1 - sum(c * (c - 1))::double / (sum(c) * (sum(c) - 1)) as d_e
  from cats group by 1)
select o.config, n_ratings, round(1 - d_o / d_e, 6) as alpha from obs o join exp_ using (config)""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    banded = t.view("judgments").withColumn("band", consistency.band(F.col("score")))
    return rounded(agreement.krippendorff(banded, ["config"], "item_id", "band"))


SPEARMAN_SQL = """with pairs as (select {by}, {x} as x, {y} as y from {source}
  where {x} is not null and {y} is not null),
ranked as (select *,
  rank() over (partition by {keys} order by x) + (count(*) over (partition by {keys}, x) - 1) / 2.0
    as rx,
  rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0
    as ry from pairs)
select {keys}, count(*) as n, round(corr(rx, ry), 6) as rho from ranked group by {keys}"""


@query(
    "severity_monotonicity",
    SPEARMAN_SQL.format(
        by="judge, degradation", keys="judge, degradation", x="severity", y="score", source="fx_judgments"
    ),
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return rounded(
        agreement.spearman(
            t.view("judgments"), ["judge", "degradation"], "severity", "score", p_values=False
        )
    )


@query(
    "spearman_latency_tokens",
    SPEARMAN_SQL.format(
        by="judge", keys="judge", x="latency_ms", y="completion_tokens", source="fx_judgments"
    ),
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return rounded(
        agreement.spearman(
            t.view("judgments"), ["judge"], "latency_ms", "completion_tokens", p_values=False
        )
    )


@query("severity_monotonicity_tests")
def _(t: Inputs) -> DataFrame:
    return agreement.spearman(t.view("judgments"), ["judge", "degradation"], "severity", "score")


@query(
    "cliffs_delta_by_judge",
    """with a as (select judge, score from fx_judgments where config = 'cot' and score is not null),
b as (select judge, score from fx_judgments where config <> 'cot' and score is not null),
ha as (select judge, score, count(*) as n from a group by 1, 2),
hb as (select judge, score, count(*) as n from b group by 1, 2),
s as (select ha.judge, sum(ha.n * hb.n * sign(ha.score - hb.score)) as d
  from ha join hb on ha.judge = hb.judge group by 1)
select s.judge, (select sum(n)::bigint from ha where ha.judge = s.judge) as n_a,
  (select sum(n)::bigint from hb where hb.judge = s.judge) as n_b,
  round(d::double / (select sum(n) from ha where ha.judge = s.judge)
    / (select sum(n) from hb where hb.judge = s.judge), 6) as delta from s""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    scored = t.view("judgments").where(F.col("score").isNotNull())
    return rounded(
        agreement.cliffs_delta(scored, ["judge"], F.col("config") == "cot", "score")
    )


HOLM_SQL = f"""with {OUTCOMES_SQL},
n as (select source_id, judge, degradation, severity,
  count(*) filter (correct_ref_first = 1 and correct_deg_first = 0) as b,
  count(*) filter (correct_deg_first = 1 and correct_ref_first = 0) as c
  from outcomes group by 1, 2, 3, 4),
z as (select *, sqrt(case when b + c >= 25 then (abs(b - c) - 1) ** 2 / (b + c) else 0 end / 2) as z from n),
p as (select *, case when b + c = 0 then 1 when z > 6 then 0
    when b + c >= 25 then 1 - 2 / sqrt(pi()) * {SIMPSON}
    else least(1, 2 * list_sum(list_transform(
      range(0, least(b, c) + 1), lambda k: gamma(b + c + 1) / gamma(k + 1) / gamma(b + c - k + 1)))
      / 2 ** (b + c)) end as p from z),
r as (select *, row_number() over (partition by judge order by p, source_id, degradation, severity)
  as rk, count(*) over (partition by judge) as m from p),
adj as (select *, least(1, max((m - rk + 1) * p) over (partition by judge
  order by rk rows unbounded preceding)) as p_adjusted from r)"""


def _all_tests(t: Inputs) -> DataFrame:
    """Holm over every McNemar test of a judge."""
    keys = ["source_id", "judge", "degradation", "severity"]
    tested = agreement.mcnemar(outcomes(t), keys, "correct_ref_first", "correct_deg_first")
    return agreement.holm(tested, ["judge"], "p_value", ["source_id", "degradation", "severity"])


@query(
    "holm_adjusted",
    HOLM_SQL
    + """ select judge, source_id, degradation, severity, round(p, 6) as p_value, m as n_tests,
  round(p_adjusted, 6) as p_adjusted, p_adjusted <= 0.05 as reject from adj""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    return rounded(_all_tests(t)).select(
        "judge",
        "source_id",
        "degradation",
        "severity",
        "p_value",
        "n_tests",
        "p_adjusted",
        "reject",
    )


@query(
    "holm_summary",
    HOLM_SQL
    + """ select judge, count(*) as n_tests, count(*) filter (p_adjusted <= 0.05) as n_significant
from adj group by judge""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    return agreement.holm_summary(_all_tests(t), ["judge"])
