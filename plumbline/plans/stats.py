"""Queries of intervals, tests, costs, latency, power and run accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators import (
    ablation,
    accounting,
    bootstrap,
    costs,
    discrimination,
    latency,
    power,
    self_preference,
    traces,
    verbosity,
)
from plumbline.plans.bias import (
    OUTCOMES_SQL,
    ROWS_SQL,
    SIMPSON,
    judged_rows,
    outcomes,
    spread_judgments,
)
from plumbline.plans.registry import Inputs, query
from plumbline.plans.shared import rounded, sql_wilson
from plumbline.plans.traces import nested_traces

RESAMPLES = bootstrap.RESAMPLES


def priced_judgments(t: Inputs) -> DataFrame:
    return costs.with_cost(spread_judgments(t), t.view("models"))


@query("bootstrap_accuracy")
def _(t: Inputs) -> DataFrame:
    return bootstrap.bootstrap_ci(
        judged_rows(t), ["judge", "degradation", "severity"], "correct", RESAMPLES
    )


@query("bootstrap_latency")
def _(t: Inputs) -> DataFrame:
    return bootstrap.bootstrap_ci(t.view("judgments"), ["judge"], "latency_ms")


@query("fixed_order_inflation")
def _(t: Inputs) -> DataFrame:
    return bootstrap.paired_diff(
        outcomes(t), ["judge"], "correct_ref_first", "correct_single_random", RESAMPLES
    )


@query("swap_mitigation")
def _(t: Inputs) -> DataFrame:
    return bootstrap.paired_diff(
        outcomes(t), ["judge"], "correct_swapped", "correct_single_random", RESAMPLES
    )


@query("cluster_interval")
def _(t: Inputs) -> DataFrame:
    return bootstrap.cluster_ci(outcomes(t), ["judge"], "source_id", "correct_swapped", RESAMPLES)


@query("poisson_cluster_interval")
def _(t: Inputs) -> DataFrame:
    return bootstrap.poisson_ci(outcomes(t), ["judge"], "source_id", F.col("correct_swapped"), F.lit(1.0), seed=7)


@query("poisson_mean_interval")
def _(t: Inputs) -> DataFrame:
    flipped = F.when(F.col("consistent"), 0.0).otherwise(1.0)
    return bootstrap.poisson_ci(outcomes(t), ["judge"], "uid", flipped, F.lit(1.0), seed=11)


@query("poisson_paired_interval")
def _(t: Inputs) -> DataFrame:
    difference = F.col("correct_swapped") - F.col("correct_ref_first")
    return bootstrap.poisson_ci(outcomes(t), ["judge"], "uid", difference, F.lit(1.0), seed=13)


def _estimate_sql(kind: str, x: str, source: str, unit: str = "uid", size: str = "1") -> str:
    """Value, n and normal-theory standard error of a ratio of totals over resampled units."""
    return f"""select '{kind}' as kind, judge, value, n, sqrt(sum((x - value * size) ** 2)) / n as error
  from (select judge, sum({x})::double as x, sum({size})::double as size from {source} group by judge, {unit}) u
  join (select judge, (sum({x}) / sum({size}))::double as value, sum({size})::bigint as n from {source} group by judge) v using (judge)
  group by judge, value, n"""


ESTIMATES_SQL = " union all ".join(
    [
        _estimate_sql("mean", "latency_ms", "(select *, row_number() over () as uid from fx_judgments where latency_ms is not null)"),
        _estimate_sql("paired", "(correct_swapped - correct_single_random)", "outcomes"),
        _estimate_sql("cluster", "correct_swapped", "outcomes", "source_id"),
        _estimate_sql("poisson mean", "(not consistent)::int", "outcomes"),
        _estimate_sql("poisson cluster", "correct_swapped", "outcomes", "source_id"),
    ]
)


@query(
    "bootstrap_estimates",
    f"""with {OUTCOMES_SQL}, e as ({ESTIMATES_SQL})
select kind, judge, round(value, 6) as value, n, true as inside, error > 0 as spread from e""",
    "pair_raw judgments",
)
def _(t: Inputs) -> DataFrame:
    """Every interval method beside what theory says: is the value inside, and is the width that of 1.96 standard errors
    on each side, within three tenths?"""
    pairs, judged = outcomes(t), t.view("judgments").where(F.col("latency_ms").isNotNull())
    flipped = F.when(F.col("consistent"), 0.0).otherwise(1.0)
    one = F.lit(1.0)
    sources = {
        "mean": (judged, F.monotonically_increasing_id(), F.col("latency_ms")),
        "paired": (pairs, F.col("uid"), F.col("correct_swapped") - F.col("correct_single_random")),
        "cluster": (pairs, F.col("source_id"), F.col("correct_swapped")),
        "poisson mean": (pairs, F.col("uid"), flipped),
        "poisson cluster": (pairs, F.col("source_id"), F.col("correct_swapped")),
    }
    found = {
        "mean": bootstrap.bootstrap_ci(judged, ["judge"], "latency_ms"),
        "paired": bootstrap.paired_diff(pairs, ["judge"], "correct_swapped", "correct_single_random").withColumnRenamed("diff", "value"),
        "cluster": bootstrap.cluster_ci(pairs, ["judge"], "source_id", "correct_swapped"),
        "poisson mean": bootstrap.poisson_ci(pairs, ["judge"], "uid", flipped, one, seed=11),
        "poisson cluster": bootstrap.poisson_ci(pairs, ["judge"], "source_id", F.col("correct_swapped"), one, seed=7),
    }
    parts = []
    for kind, (rows, unit, x) in sources.items():
        sums = rows.groupBy("judge", unit.alias("unit")).agg(F.sum(x.cast("double")).alias("x"), F.count(F.lit(1)).alias("size"))
        whole = rows.groupBy("judge").agg(F.avg(x.cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
        spread = F.sqrt(F.sum((F.col("x") - F.col("v") * F.col("size")) ** 2)) / F.first("n")
        error = sums.join(whole, "judge").groupBy("judge", "n").agg(spread.alias("error"))
        drawn = found[kind].select("judge", "value", "lo", "hi").join(error, "judge")
        width = (F.col("hi") - F.col("lo")) / (2 * 1.959964 * F.col("error"))
        parts.append(
            drawn.select(
                F.lit(kind).alias("kind"),
                "judge",
                "value",
                "n",
                F.col("value").between(F.col("lo"), F.col("hi")).alias("inside"),
                F.when(F.col("error") > 0, width.between(0.7, 1.3)).otherwise(F.col("hi") > F.col("lo")).alias("spread"),
            )
        )
    return rounded(reduce(DataFrame.unionByName, parts))


@query(
    "wilson_by_defect",
    f"""select degradation, count(score) as n, count(*) filter (score >= 7) as k,
  round({sql_wilson("count(*) filter (score >= 7)", "count(score)", "lo", 0.9)}, 6) as lo,
  round({sql_wilson("count(*) filter (score >= 7)", "count(score)", "hi", 0.9)}, 6) as hi
from fx_judgments group by degradation""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    counted = t.view("judgments").groupBy("degradation").agg(
        F.count("score").alias("n"), F.count_if(F.col("score") >= 7).alias("k")
    )
    low, high = wilson(F.col("k"), F.col("n"), 0.90)
    return rounded(counted.withColumn("lo", low).withColumn("hi", high))


VERBOSITY_SQL = f"""
v as (select j.*, r.score as ref from fx_judgments j join fx_reference_scores r
  on j.judge = r.judge and j.item_id = r.item_id
  where j.score is not null and r.score is not null),
rep as (select judge, config, severity, count(*) as n, avg(len_ratio) as mean_length_ratio,
  avg(score - ref) as delta_points, sum((score > ref)::int) as k, avg(score) as padded_mean_score,
  avg(ref) as reference_mean_score from v group by 1, 2, 3)"""


def padded(t: Inputs) -> DataFrame:
    return verbosity.padded_pairs(spread_judgments(t), t.view("reference_scores").select("judge", "item_id", "score"))


@query(
    "verbosity_report",
    f"""with {VERBOSITY_SQL} select judge, config, severity, n,
  round(mean_length_ratio, 6) as mean_length_ratio, round(delta_points, 6) as delta_points,
  round(case when mean_length_ratio > 1 then delta_points / greatest(mean_length_ratio - 1, 1e-9)
    else 0 end, 6) as points_per_doubling,
  round(k / n, 6) as share_scored_higher, round({sql_wilson("k", "n", "lo")}, 6) as share_lo,
  round({sql_wilson("k", "n", "hi")}, 6) as share_hi,
  round(padded_mean_score, 6) as padded_mean_score,
  round(reference_mean_score, 6) as reference_mean_score from rep""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    return rounded(verbosity.verbosity_report(padded(t)))


@query(
    "max_verbosity_gain",
    f"""with {VERBOSITY_SQL} select judge, round(max(delta_points), 6) as max_verbosity_gain
from rep group by judge""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    return rounded(verbosity.max_verbosity_gain(verbosity.verbosity_report(padded(t))))


@query("verbosity_intervals")
def _(t: Inputs) -> DataFrame:
    return verbosity.verbosity_intervals(padded(t), RESAMPLES)


def judged_traces(traces: DataFrame) -> DataFrame:
    """Scores of traces by four stand-in judges that like length to different degrees and at times give none."""
    steps = F.size("steps")
    judges = F.array(
        *[
            F.struct(
                F.lit(f"j{j}").alias("judge"),
                F.when(F.col("trace_id").cast("bigint") % 17 != j, F.least(F.lit(10.0), 4.0 + 0.3 * j * steps)).alias("score"),
            )
            for j in range(4)
        ]
    )
    return traces.select("*", F.inline(judges))


LENGTH_SQL = """
n as (select trace_id, count(*) as k from fx_trace_calls group by 1),
v as (select trace_id, k, k + least(greatest(1, round_even(severity * 4, 0)::int), 4) as kp
  from n, (select unnest([0.2, 0.5, 0.9]::double[]) as severity)),
b as (select 'j' || j as judge, least(10.0, 4.0 + 0.3 * j * kp)::double - least(10.0, 4.0 + 0.3 * j * k)::double as d
  from v, (select unnest([0, 1, 2, 3]) as j) where trace_id::bigint % 17 <> j)"""


@query(
    "trace_length_bias",
    f"""with {LENGTH_SQL} select judge, round(avg(d), 6) as diff, count(*) as n, avg(d) > 0 as significant, true as inside
from b group by judge""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    """Padded traces against their own reference traces, all severities, over all judges."""
    whole = nested_traces(t)
    variants = traces.build_trace_variants(whole, ["length_padding"])
    references = judged_traces(whole.select("trace_id", "steps")).select("judge", "trace_id", "score")
    padded_traces = judged_traces(variants.select("trace_id", "severity", "len_ratio", "steps"))
    pairs = verbosity.padded_trace_pairs(padded_traces.drop("steps"), references)
    out = verbosity.trace_length_bias(pairs, RESAMPLES)
    return rounded(out.select("judge", "diff", "n", "significant", F.col("diff").between(F.col("lo"), F.col("hi")).alias("inside")))


LOO_SQL = """
g as (select *, sum(score) over (partition by generator, item_id) as s,
  count(score) over (partition by generator, item_id) as k from fx_generated
  where score is not null),
dev as (select g.judge, g.generator, g.item_id, score - (s - score) / (k - 1) as deviation,
  a.family = b.family as own_family from g join fx_models a on a.alias = g.judge
  join fx_models b on b.alias = g.generator where k > 1)"""


def deviations(t: Inputs) -> DataFrame:
    return self_preference.loo_deviation(t.view("generated"), t.view("models"))


@query(
    "leave_one_out_deviation",
    f"""with {LOO_SQL} select judge, generator, item_id, round(deviation, 6) as deviation, own_family
from dev""",
    "generated models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(deviations(t))


@query(
    "deviation_summary",
    f"""with {LOO_SQL} select judge, generator as part, count(*) as n,
  round(avg(deviation), 6) as mean_deviation, 'generator' as level from dev group by 1, 2
union all select judge, case when own_family then 'own family' else 'other family' end, count(*),
  round(avg(deviation), 6), 'family' from dev group by 1, 2""",
    "generated models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(self_preference.deviation_summary(deviations(t)))


@query(
    "own_other_pairs",
    f"""with {LOO_SQL},
p as (select *, row_number() over (partition by judge, own_family order by generator, item_id)
  as position from dev)
select a.judge, a.position, round(a.deviation, 6) as own, round(b.deviation, 6) as other
from p a join p b on a.judge = b.judge and a.position = b.position
where a.own_family and not b.own_family""",
    "generated models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(self_preference.own_other_pairs(deviations(t)))


@query(
    "self_enhancement_unpaired",
    f"""with {LOO_SQL} select judge, round(avg(deviation) filter (own_family), 6) as own_mean,
  round(avg(deviation) filter (not own_family), 6) as other_mean,
  round(avg(deviation) filter (own_family) - avg(deviation) filter (not own_family), 6) as effect
from dev group by judge""",
    "generated models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(self_preference.self_enhancement_unpaired(deviations(t)))


@query("self_enhancement")
def _(t: Inputs) -> DataFrame:
    return self_preference.self_enhancement(deviations(t), RESAMPLES)


@query("deviation_intervals")
def _(t: Inputs) -> DataFrame:
    return self_preference.deviation_intervals(deviations(t), RESAMPLES)


ABLATION_SQL = f"""{ROWS_SQL},
abl as (select r.*, coalesce(correct, 0) as ok, (prompt_tokens * m.list_usd_per_mtok_in
  + completion_tokens * m.list_usd_per_mtok_out) / 1000000 as cost
  from rows_ r left join fx_models m on m.alias = r.judge)"""


def ablation_rows(t: Inputs) -> DataFrame:
    return ablation.ablation_rows(priced_judgments(t), t.view("reference_scores"))


@query(
    "config_accuracy",
    f"""with {ABLATION_SQL} select judge, config, count(*) as n, round(avg(ok), 6) as accuracy,
  round({sql_wilson("sum(ok)", "count(*)", "lo")}, 6) as lo,
  round({sql_wilson("sum(ok)", "count(*)", "hi")}, 6) as hi,
  sum(prompt_tokens + completion_tokens)::bigint as total_tokens, round(sum(cost), 6) as cost_usd,
  round(avg(latency_ms), 6) as mean_latency_ms from abl group by 1, 2""",
    "judgments reference_scores models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(ablation.config_accuracy(ablation_rows(t)))


COMPARISON_SQL = f"""with {ABLATION_SQL},
pairs as (select a.judge, a.config as baseline, b.config as candidate, a.ok as a, b.ok as b
  from abl a join abl b on a.judge = b.judge and a.item_id = b.item_id
    and a.replicate = b.replicate
  where (a.config, b.config) in (('vague', 'rubric'), ('vague', 'cot'), ('rubric', 'cot'))),
tok as (select judge, config, sum(prompt_tokens + completion_tokens)::bigint as tk from abl
  group by 1, 2),
n as (select p.judge, baseline, candidate, count(*) as n, avg(b) - avg(a) as delta,
  sum((b = 1 and a = 0)::int)::bigint as b, sum((a = 1 and b = 0)::int)::bigint as c,
  avg(b) * (1 - avg(a)) - avg(a) * (1 - avg(b)) as cd
  from pairs p group by 1, 2, 3),
s as (select n.*, tb.tk - ta.tk as extra_tokens, (b + c) < 25 as exact,
  case when b + c = 0 then 0 when b + c < 25 then least(b, c)
    else (abs(b - c) - 1) ** 2 / (b + c) end::double as statistic,
  sqrt(case when b + c >= 25 then (abs(b - c) - 1) ** 2 / (b + c) else 0 end / 2) as z
  from n join tok ta on ta.judge = n.judge and ta.config = baseline
  join tok tb on tb.judge = n.judge and tb.config = candidate),
pv as (select *, case when b + c = 0 then 1 when exact then least(1, 2 * list_sum(list_transform(
      range(0, least(b, c) + 1), lambda k: gamma(b + c + 1) / gamma(k + 1) / gamma(b + c - k + 1)))
      / 2 ** (b + c)) when z > 6 then 0 else 1 - 2 / sqrt(pi()) * {SIMPSON} end as p from s),
r as (select *, row_number() over (order by p, judge, baseline, candidate) as rk,
  count(*) over () as m from pv)
select judge, baseline, candidate, n, round(delta, 6) as delta, b, c,
  round(statistic, 6) as statistic, round(p, 6) as p_value, exact, round(cd, 6) as cliffs_delta,
  extra_tokens, round(100 * delta / (extra_tokens / 1000), 6) as points_per_1k_extra_tokens,
  round(least(1, max((m - rk + 1) * p) over (order by rk rows unbounded preceding)), 6)
    as p_adjusted_holm,
  least(1, max((m - rk + 1) * p) over (order by rk rows unbounded preceding)) <= 0.05
    as significant_after_correction from r"""


@query("config_comparisons", COMPARISON_SQL, "judgments reference_scores models")
def _(t: Inputs) -> DataFrame:
    return rounded(ablation.config_comparisons(ablation_rows(t), ["item_id", "replicate"]))


@query("config_delta_intervals")
def _(t: Inputs) -> DataFrame:
    return ablation.config_delta_intervals(
        ablation_rows(t), ["item_id", "replicate"], resamples=RESAMPLES
    )


@query(
    "priced_log",
    """select judge, config, round(sum((prompt_tokens * list_usd_per_mtok_in
  + completion_tokens * list_usd_per_mtok_out) / 1000000), 6) as list_cost,
  round(sum((prompt_tokens * usd_per_mtok_in + completion_tokens * usd_per_mtok_out) / 1000000), 6)
    as real_cost from fx_judgments j join fx_models m on m.alias = j.judge group by 1, 2""",
    "judgments models",
)
def _(t: Inputs) -> DataFrame:
    listed = costs.with_cost(t.view("judgments"), t.view("models")).withColumnRenamed(
        "cost_usd", "listed"
    )
    both = costs.with_cost(listed, t.view("models"), list_price=False)
    return rounded(
        both.groupBy("judge", "config").agg(
            F.sum("listed").alias("list_cost"), F.sum("cost_usd").alias("real_cost")
        )
    )


COST_SQL = f"""with {ABLATION_SQL},
sm as (select judge, count(correct) as n_pairs, avg(correct) as accuracy, avg(latency_ms) as lat,
  sum(cost) as vcost from abl group by 1),
rc as (select r.judge, sum((prompt_tokens * m.list_usd_per_mtok_in
  + completion_tokens * m.list_usd_per_mtok_out) / 1000000) as rcost
  from fx_reference_scores r join fx_models m on m.alias = r.judge group by 1),
c as (select sm.judge, m.provider, m.family, m.tier, accuracy, vcost + rcost as cost, n_pairs, lat
  from sm join rc on sm.judge = rc.judge join fx_models m on m.alias = sm.judge),
u as (select *, 1000 * cost / greatest(n_pairs, 1) as c1k,
  cost / greatest(accuracy * n_pairs, 1e-9) as cpc from c)"""


def cost_table(t: Inputs) -> DataFrame:
    models = t.view("models")
    rows = discrimination.discrimination_rows(
        costs.with_cost(spread_judgments(t), models), t.view("reference_scores")
    )
    references = costs.with_cost(t.view("reference_scores"), models)
    return costs.cost_accuracy(discrimination.judge_summary(rows, references), models)


@query(
    "cost_accuracy",
    COST_SQL
    + """ select judge, provider, family, tier, round(accuracy, 6) as accuracy,
  round(cost, 6) as total_cost_usd, round(c1k, 6) as cost_per_1k_usd,
  round(cpc, 6) as cost_per_correct_usd, round(lat, 6) as mean_latency_ms,
  round(1000 / greatest(lat, 1e-9), 6) as judgments_per_second,
  round(accuracy / greatest(cost, 1e-12), 6) as accuracy_per_dollar from u""",
    "judgments reference_scores models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(cost_table(t))


@query(
    "pareto_judges",
    COST_SQL
    + """ select judge, round(accuracy, 6) as accuracy, round(c1k, 6) as cost_per_1k_usd from (
  select *, max(accuracy) over (order by c1k, judge rows between unbounded preceding and
  1 preceding) as best from u) where best is null or accuracy > best""",
    "judgments reference_scores models",
)
def _(t: Inputs) -> DataFrame:
    frontier = costs.pareto(cost_table(t), "cost_per_1k_usd", "accuracy", "judge")
    return rounded(frontier.select("judge", "accuracy", "cost_per_1k_usd"))


@query(
    "pareto_parts",
    """select p_type, p_partkey, p_retailprice, p_size from (
  select *, max(p_size) over (partition by p_type order by p_retailprice, p_partkey
  rows between unbounded preceding and 1 preceding) as best from part)
where best is null or p_size > best""",
)
def _(t: Inputs) -> DataFrame:
    parts = t.table("part").select("p_type", "p_partkey", "p_retailprice", "p_size")
    return costs.pareto(parts, "p_retailprice", "p_size", "p_partkey", ("p_type",))


@query(
    "cost_headline",
    COST_SQL
    + """, f as (select * from u order by accuracy desc, judge limit 1),
o as (select * from u where tier = 'open-weight' order by accuracy desc, judge limit 1),
ch as (select * from u order by cpc, judge limit 1)
select f.judge as frontier_judge, o.judge as best_open_weight_judge,
  round(100 * o.accuracy / f.accuracy, 6) as accuracy_retained_pct,
  round(o.accuracy - f.accuracy, 6) as accuracy_gap,
  round(o.c1k / greatest(f.c1k, 1e-12), 6) as open_cost_over_frontier_cost,
  ch.judge as cheapest_per_correct_judgment,
  round(f.lat / greatest(o.lat, 1e-9), 6) as latency_ratio_frontier_over_open
from f, o, ch where o.judge <> f.judge""",
    "judgments reference_scores models",
)
def _(t: Inputs) -> DataFrame:
    return rounded(costs.headline(cost_table(t)))


@query("cost_headline_gap")
def _(t: Inputs) -> DataFrame:
    keys = ["item_id", "degradation", "severity", "config", "replicate"]
    return costs.headline_gap(judged_rows(t), costs.headline(cost_table(t)), keys, RESAMPLES)


LATENCY_SQL = """with r as (select {keys}, {ms} as v,
  row_number() over (partition by {keys} order by {ms}) - 1 as i,
  count(*) over (partition by {keys}) as n from {source}{where})
select {keys}, any_value(n) as n, round(avg(v), 6) as mean,
  max(v) filter (i = round_even(0.5 * (n - 1), 0)) as p50,
  max(v) filter (i = round_even(0.9 * (n - 1), 0)) as p90,
  max(v) filter (i = round_even(0.95 * (n - 1), 0)) as p95,
  max(v) filter (i = round_even(0.99 * (n - 1), 0)) as p99, max(v) as max,
  max(v) filter (i = round_even(0.99 * (n - 1), 0)) <= {budget} as within_budget
from r group by {keys}"""


@query(
    "latency_summary",
    LATENCY_SQL.format(keys="endpoint", ms="ms", source="fx_requests", where="", budget=150.0),
    "requests",
)
def _(t: Inputs) -> DataFrame:
    return rounded(latency.latency_summary(t.view("requests"), ["endpoint"], "ms", 150.0))


@query(
    "judge_latency",
    LATENCY_SQL.format(
        keys="judge, config", ms="latency_ms", source="fx_judgments", where="", budget=900.0
    ),
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    return rounded(
        latency.latency_summary(t.view("judgments"), ["judge", "config"], "latency_ms", 900.0)
    )


@query(
    "latency_percentile_linear",
    """select endpoint, round(quantile_cont(ms, 0.95), 6) as p95,
  round(quantile_cont(ms, 0.99), 6) as p99 from fx_requests group by endpoint""",
    "requests",
)
def _(t: Inputs) -> DataFrame:
    requests = t.view("requests")
    parts = [
        latency.percentile_linear(requests, ["endpoint"], "ms", p).withColumnRenamed("value", name)
        for name, p in (("p95", 0.95), ("p99", 0.99))
    ]
    return rounded(parts[0].join(parts[1], "endpoint"))


@query(
    "last_samples_latency",
    LATENCY_SQL.replace("with r as", "with tot as (select endpoint, count(*) as count, "
        "count(*) filter (is_error) as errors from fx_requests group by 1), r as")
    .replace("select {keys}, any_value(n) as n,", "select r.{keys}, any_value(count) as count, "
        "any_value(errors) as errors, any_value(n) as window,")
    .replace("from r group by {keys}", "from r join tot on tot.endpoint = r.endpoint group by r.{keys}")
    .format(
        keys="endpoint",
        ms="ms",
        source="(select *, row_number() over (partition by endpoint order by ts desc, event_id desc)"
        " as back from fx_requests)",
        where=" where back <= 500",
        budget=150.0,
    ),
    "requests",
)
def _(t: Inputs) -> DataFrame:
    return rounded(latency.last_n_latency(t.view("requests"), 500, 150.0))


@query(
    "power_by_defect",
    f"""with {ROWS_SQL},
g as (select judge, degradation, count(correct) as n, avg(correct) filter (severity > 0.8) as p1,
  avg(correct) filter (severity < 0.3) as p2 from rows_ group by 1, 2),
q as (select *, 1.959963984540054::double as za, 0.8416212335729143::double as zb,
  (p1 + p2) / 2 as m from g),
s as (select *, ceil((za * sqrt(2 * m * (1 - m)) + zb * sqrt(p1 * (1 - p1) + p2 * (1 - p2))) ** 2
    / (p1 - p2) ** 2)::bigint as need,
  (abs(p1 - p2) - za * sqrt(2 * m * (1 - m) / n)) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / n) as x
  from q where p1 <> p2),
w as (select *, abs(x) / sqrt(2) as z from s)
select judge, degradation, n, need as n_required, round(abs(p1 - p2), 6) as effect,
  round(0.5 + sign(x) * {SIMPSON} / sqrt(pi()), 6) as power, n >= need as adequate from w""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    correct, severity = F.col("correct"), F.col("severity")
    groups = judged_rows(t).groupBy("judge", "degradation").agg(
        F.count("correct").alias("n"),
        F.avg(F.when(severity > 0.8, correct)).alias("p1"),
        F.avg(F.when(severity < 0.3, correct)).alias("p2"),
    )
    report = power.power_report(groups.where(F.col("p1") != F.col("p2")), "n", "p1", "p2")
    return rounded(report.drop("p1", "p2"))


@query(
    "paired_sample_size",
    f"""with {OUTCOMES_SQL},
g as (select judge, degradation, count(*) as n,
  avg((correct_ref_first <> correct_deg_first)::int) as d from outcomes group by 1, 2)
select judge, degradation, n, round(d, 6) as discordant,
  ceil((1.959963984540054::double * 2.6 + 0.8416212335729143::double
    * sqrt(2.6::double ** 2 - 0.6::double ** 2 * d)) ** 2 / (0.6::double ** 2 * d))::bigint
    as n_required from g""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    groups = outcomes(t).groupBy("judge", "degradation").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("correct_ref_first") != F.col("correct_deg_first"), 1.0).otherwise(0.0)).alias(
            "discordant"
        ),
    )
    need = power.n_for_paired_flags(F.col("discordant"), F.lit(1.6))
    return rounded(groups.withColumn("n_required", need))


@query(
    "failure_report",
    """with k as (select judge, nullif(split_part(error, ':', 1), '') as kind, count(*) as calls
  from fx_judgments group by 1, 2),
s as (select judge, coalesce(sum(calls) filter (kind is not null), 0)::bigint as failed_calls,
  sum(calls)::bigint as total_calls,
  string_agg(kind || '=' || calls, ',' order by kind) filter (kind is not null) as errors,
  coalesce(bool_or(kind = 'QuotaExhaustedError'), false) as quota_exhausted from k group by 1)
select *, round(failed_calls / greatest(total_calls, 1), 6) as failure_rate,
  failed_calls >= 25 and failed_calls / greatest(total_calls, 1) > 0.2 as stop from s""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    report = accounting.failure_report(t.view("judgments"))
    flat = F.transform(
        F.array_sort(F.map_entries("errors")),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return rounded(report.withColumn("errors", F.array_join(flat, ",")))


@query(
    "panel_coverage",
    """with e as (select distinct p_type as experiment, 'j' || (p_partkey * p_size % 5) as judge
  from part where p_size > 47),
p as (select alias as judge from fx_models),
x as (select experiment, p.judge from (select distinct experiment from e), p)
select x.experiment, string_agg(x.judge, ',' order by x.judge) as missing from x
where not exists (select 1 from e where e.experiment = x.experiment and e.judge = x.judge)
group by 1""",
    "models",
)
def _(t: Inputs) -> DataFrame:
    log = t.table("part").where(F.col("p_size") > 47).select(
        F.col("p_type").alias("experiment"),
        F.concat(F.lit("j"), (F.col("p_partkey") * F.col("p_size") % 5).cast("string")).alias(
            "judge"
        ),
    )
    missing = accounting.coverage(log, t.view("models").select(F.col("alias").alias("judge")))
    return missing.withColumn("missing", F.array_join("missing", ","))


@query(
    "usage_vs_allowance",
    """with u as (select judge, (ts - interval 8 hours)::date as day, count(*) as day_requests,
  sum(prompt_tokens + completion_tokens)::bigint as day_tokens,
  coalesce(bool_or(split_part(error, ':', 1) = 'QuotaExhaustedError'), false) as exhausted
  from fx_judgments group by 1, 2)
select u.judge, cast(day as varchar) as day, day_requests, day_tokens, rpd, exhausted,
  (case when exhausted then 0 else rpd - day_requests end)::bigint as remaining,
  round(4467 / rpd, 6) as days_of_work_left
from u join fx_models m on m.alias = u.judge""",
    "judgments models",
)
def _(t: Inputs) -> DataFrame:
    log = t.view("judgments").withColumn(
        "tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint")
    )
    report = accounting.usage_vs_allowance(log, t.view("models"), 4467)
    return rounded(
        report.withColumn("day", F.col("day").cast("string")).withColumn(
            "remaining", F.col("remaining").cast("bigint")
        )
    )


CALLS_SQL = """calls as (select event_id as call_id, 'j' || (user_id % 4) as judge, ts,
  cast(round(value) as bigint) as tokens from events)"""


def calls(t: Inputs) -> DataFrame:
    return t.table("events").select(
        F.col("event_id").alias("call_id"),
        F.concat(F.lit("j"), (F.col("user_id") % 4).cast("string")).alias("judge"),
        "ts",
        F.round("value").cast("bigint").alias("tokens"),
    )


@query(
    "rate_windows",
    f"""with {CALLS_SQL},
w as (select *, count(*) over x as requests_in_window, sum(tokens) over x as tokens_in_window
  from calls window x as (partition by judge order by epoch_us(ts)
    range between 599999999 preceding and current row))
select call_id, w.judge, ts, requests_in_window, tokens_in_window::bigint as tokens_in_window,
  requests_in_window >= rpm * 0.9::double or tokens_in_window > tpm * 0.9::double as over_limit
from w join fx_models m on m.alias = w.judge""",
    "models",
)
def _(t: Inputs) -> DataFrame:
    return accounting.rate_windows(calls(t), t.view("models"), seconds=600)


@query(
    "token_reservation",
    """with c as (select o_orderkey, 'j' || (o_custkey % 4) as judge,
  (100 + o_custkey % 50)::bigint as prompt_tokens, 400::bigint as max_tokens,
  (10 + o_orderkey * 7 % 700)::bigint as used_tokens, o_orderdate from orders),
h as (select *, list(used_tokens) over (partition by judge order by o_orderdate, o_orderkey
  rows between 64 preceding and 1 preceding) as u from c)
select o_orderkey, judge, case when coalesce(len(u), 0) < 8 then prompt_tokens + max_tokens
  else floor(prompt_tokens + least(max_tokens::double, list_sort(u)[
    least(len(u) - 1, floor(len(u) * 0.9::double)::bigint) + 1] * 1.15::double))::bigint
  end as reserved_tokens from h""",
)
def _(t: Inputs) -> DataFrame:
    log = t.table("orders").select(
        "o_orderkey",
        "o_orderdate",
        F.concat(F.lit("j"), (F.col("o_custkey") % 4).cast("string")).alias("judge"),
        (100 + F.col("o_custkey") % 50).alias("prompt_tokens"),
        F.lit(400).cast("bigint").alias("max_tokens"),
        (10 + F.col("o_orderkey") * 7 % 700).alias("used_tokens"),
    )
    held = accounting.token_reservation(log, ["o_orderdate", "o_orderkey"])
    return held.select("o_orderkey", "judge", "reserved_tokens")


@query(
    "token_headroom",
    """with b as (select j.*, (case when config = 'cot' then 512 else 160 end)
  * (case when reasoning then 10 else 1 end) as budget
  from fx_judgments j join fx_models m on m.alias = j.judge),
s as (select *, 1 - completion_tokens / budget as headroom, case when score is null
  then (case when degradation = 'omission' then 'truncated' else 'unparseable' end)
  when 1 - completion_tokens / budget < 0.15 then 'too tight' else 'ok' end as status from b)
select judge, config, status, budget, count(*) as n, round(min(headroom), 6) as least_headroom
from s group by 1, 2, 3, 4""",
    "judgments models",
)
def _(t: Inputs) -> DataFrame:
    log = t.view("judgments").withColumn(
        "finish_reason", F.when(F.col("degradation") == "omission", "MAX_TOKENS").otherwise("stop")
    )
    checked = accounting.headroom(log, t.view("models"))
    return rounded(
        checked.groupBy("judge", "config", "status", "budget").agg(
            F.count(F.lit(1)).alias("n"), F.min("headroom").alias("least_headroom")
        )
    )
