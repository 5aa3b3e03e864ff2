"""Queries of sources, judging, evidence runs, gates and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sql_functions import register
from plumbline.operators import evidence, gates, judging, reports, swaps
from plumbline.operators import text_variants as tv
from plumbline.operators.discrimination import discrimination_report, judge_summary
from plumbline.operators.ordered import take_first
from plumbline.plans.bias import (
    OUTCOMES_SQL,
    ROWS_SQL,
    SQL_VERDICT,
    judged_rows,
    outcomes,
    sql_clean,
)
from plumbline.plans.gold import ALL_VARIANTS_SQL, FACTS_SQL, order_items
from plumbline.plans.registry import Inputs, query
from plumbline.plans.shared import rounded, shared_folder, sql_wilson
from plumbline.plans.traces import nested_traces
from plumbline.sources import qa_mining, tables


@query(
    "items_first",
    f"""with {FACTS_SQL} select item_id, domain, reference from refs order by item_id limit 500""",
    "order_items",
)
def _(t: Inputs) -> DataFrame:
    return take_first(order_items(t), ["item_id"], 500).select("item_id", "domain", "reference")


@query(
    "items_first_by_rank",
    f"""with {FACTS_SQL} select item_id, domain, reference from refs order by item_id limit 500""",
    "order_items",
)
def _(t: Inputs) -> DataFrame:
    first = take_first(order_items(t), ["item_id"], 500, small=0)
    return first.select("item_id", "domain", "reference")


def _pairs_with_faults(t: Inputs) -> DataFrame:
    key = F.col("o_orderkey")
    return t.table("orders").select(
        F.when(key % 501 == 7, key - 1).otherwise(key).cast("string").alias("id"),
        (F.col("o_custkey") % 20).cast("string").alias("source_id"),
        F.when(key % 997 == 3, "").otherwise(F.col("o_orderstatus")).alias("context"),
        F.col("o_orderpriority").alias("question"),
        F.lit("right").alias("reference"),
        F.when(key % 499 == 11, "right").otherwise("wrong").alias("candidate"),
    )


@query(
    "pair_violations",
    """with p as (select (case when o_orderkey % 501 = 7 then o_orderkey - 1 else o_orderkey end)::varchar
  as id, case when o_orderkey % 997 = 3 then '' else o_orderstatus end as context,
  o_orderkey % 499 = 11 as same from orders)
select id, case when context = '' then 'empty field' else 'reference equals candidate' end as reason
from p where context = '' or same
union all select id, 'repeated id' from p group by id having count(*) > 1""",
)
def _(t: Inputs) -> DataFrame:
    return tables.pair_violations(_pairs_with_faults(t))


@query(
    "pair_manifest",
    """select count(*) as pairs, 2 * count(*) as candidate_answers, count(distinct source_id) as sources,
  20260731 as seed, bit_xor(('0x' || substr(md5(candidate || '|' || context || '|' || id || '|'
  || question || '|' || reference || '|' || source_id), 1, 8))::bigint) as checksum
from fx_evidence_pairs""",
    "evidence_pairs",
)
def _(t: Inputs) -> DataFrame:
    return tables.manifest(t.view("evidence_pairs"))


@query(
    "mined_numeric_pairs",
    """with o as (select p_partkey, p_type, (p_size::varchar || case when p_partkey % 2 = 0
    then '.' || (p_partkey % 10)::varchar else '' end) as ref, p_partkey % 17 = 3 as impossible,
  p_partkey % 13 = 5 as wrong_span, p_partkey % 11 = 7 as disagree from part),
n as (select *, case when contains(ref, '.') then 1 else 0 end as dp, ref::decimal(20, 4) as v
  from o where not impossible and not wrong_span and not disagree),
c as (select *, v + greatest(case when dp = 1 then 0.1 else 1 end::decimal(20, 4),
  case when dp = 1 then round_even((v * 0.1 * 10)::decimal(20, 4), 0) / 10
  else round_even((v * 0.1)::decimal(20, 4), 0) end::decimal(20, 4)) as bad from n),
s as (select *, case when dp = 1 then printf('%.1f', bad) else printf('%.0f', bad) end as cand from c)
select p_partkey::varchar as id, p_type as source_id, ref as reference, cand as candidate from s
where not contains('Part ' || p_partkey || ' has size ' || ref || ' units.', cand)""",
)
def _(t: Inputs) -> DataFrame:
    key = F.col("p_partkey")
    ref = F.concat(
        F.col("p_size").cast("string"),
        F.when(key % 2 == 0, F.concat(F.lit("."), (key % 10).cast("string"))).otherwise(""),
    )
    head = F.concat(F.lit("Part "), key.cast("string"), F.lit(" has size "))
    start = F.length(head) + F.when(key % 13 == 5, 1).otherwise(0)
    answer = F.struct(ref.alias("text"), start.alias("answer_start"))
    other = F.struct(F.concat(ref, F.lit("9")).alias("text"), start.alias("answer_start"))
    qa = F.struct(
        key.cast("string").alias("id"),
        F.lit("Which size?").alias("question"),
        (key % 17 == 3).alias("is_impossible"),
        F.when(key % 11 == 7, F.array(answer, other)).otherwise(F.array(answer, answer)).alias("answers"),
    )
    unanswered = F.struct(
        F.concat(F.lit("x"), key.cast("string")).alias("id"),
        F.lit("Why?").alias("question"),
        F.lit(False).alias("is_impossible"),
        F.array().cast("array<struct<text:string,answer_start:int>>").alias("answers"),
    )
    paragraph = F.struct(
        F.concat(head, ref, F.lit(" units.")).alias("context"), F.array(unanswered, qa).alias("qas")
    )
    source = t.table("part").select(
        F.array(
            F.struct(F.col("p_type").alias("title"), F.array(paragraph).alias("paragraphs"))
        ).alias("data"),
        F.col("p_partkey").alias("file"),
    )
    return qa_mining.eligible_pairs(source).select("id", "source_id", "reference", "candidate")


@query(
    "judgments_view_sql",
    "select judge, count(*) as n, round(avg(score), 6) as mean_score from fx_judgments group by judge",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    nested = (
        t.view("judgments")
        .groupBy("item_id")
        .agg(F.collect_list(F.struct("judge", "config", "score")).alias("records"))
    )
    tables.register_judgments(nested, "judgments_flat")
    return t.spark.sql(
        "select judge, count(*) as n, round(avg(score), 6) as mean_score from judgments_flat group by judge"
    )


@query(
    "json_safe_values",
    """select p_partkey, case when p_size % 5 <> 0 and p_size % 7 <> 0 then p_retailprice end as price,
  case when p_size % 5 <> 0 then p_retailprice end as first_nested,
  (p_size % 5 = 0)::int as nulls_in_array from part""",
)
def _(t: Inputs) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    odd = F.when(size % 5 == 0, float("nan")).when(size % 7 == 0, float("inf")).otherwise(price)
    nan = F.when(size % 5 == 0, float("nan")).otherwise(price)
    raw = t.table("part").select(
        "p_partkey", odd.alias("price"), F.struct(nan.alias("x")).alias("s"), F.array(nan).alias("a")
    )
    safe = tables.json_safe(raw)
    return safe.select(
        "p_partkey",
        "price",
        F.col("s.x").alias("first_nested"),
        F.size(F.filter("a", lambda v: v.isNull())).alias("nulls_in_array"),
    )


@query(
    "model_dimension",
    "select provider, id, alias, family, tier, reasoning, rpd from fx_models",
    "models",
)
def _(t: Inputs) -> DataFrame:
    nested = t.view("models").groupBy("provider").agg(
        F.collect_list(F.struct("id", "alias", "family", "tier", "reasoning", "rpd")).alias("models")
    )
    return tables.read_models(nested)


@query(
    "saved_result_round_trip",
    f"""with {ROWS_SQL}
select judge, count(correct) as n_pairs, round(avg(correct), 6) as accuracy, 'batch' as provenance_mode, 20260731 as provenance_seed,
  false as full_result_touched, true as clean_name_only from rows_ group by judge""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    """A smoke result written and read again; the full result's folder stays untouched and odd names are refused."""
    base = shared_folder(t.spark, "results")
    report = discrimination_report(judged_rows(t)).where(F.col("level") == "judge")
    tables.save(report, base, "discrimination", tables.provenance("batch", 20260731, "0.1.0"), smoke=True)
    touched = tables.exists(t.spark, base, "discrimination")
    try:
        tables.save(report, base, "../discrimination", {})
        refused = False
    except ValueError:
        refused = True
    again = tables.load(t.spark, base, "discrimination", smoke=True)
    return rounded(
        again.select(
            "judge",
            "n_pairs",
            "accuracy",
            "provenance_mode",
            "provenance_seed",
            F.lit(touched).alias("full_result_touched"),
            F.lit(refused).alias("clean_name_only"),
        )
    )


def complete_run(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """The pairs that have both answers, and their log as a live run would have left it."""
    pairs = t.view("evidence_pairs").where(F.col("id").cast("bigint") % 19 != 7)
    log = t.view("evidence_log").where(F.col("pair_id").cast("bigint") % 19 != 7)
    return pairs, log.withColumn("simulated", F.lit(False)).withColumn("finish_reason", F.lit("stop"))


@query(
    "published_evidence",
    """with l as (select * from fx_evidence_log where pair_id::bigint % 19 <> 7),
p as (select r.score as rs, c.score as cs from l r join l c on c.pair_id = r.pair_id and r.role = 'reference' and c.role = 'candidate')
select 2::bigint as version, true as second_writer_refused, count(*) as completed_pairs, (select count(*) from l) as evidence_rows,
  (select count(*) from l) as listed_rows, round(avg(coalesce(rs > cs, false)::int), 6) as accuracy from p""",
    "evidence_log",
)
def _(t: Inputs) -> DataFrame:
    """A run published, published again, refused to a writer that had not seen the second version, and read back."""
    base = shared_folder(t.spark, "published")
    pairs, log = complete_run(t)
    first = evidence.publish(pairs, log, base, "pilot", {"run": "first"})
    evidence.publish(pairs, log, base, "pilot", {"run": "second"}, expected_version=first)
    try:
        evidence.publish(pairs, log, base, "pilot", {"run": "late"}, expected_version=first)
        refused = False
    except evidence.Conflict:
        refused = True
    read = evidence.published(t.spark, base, "pilot")
    rows = read["evidence"].agg(F.count(F.lit(1))).scalar()
    return rounded(
        read["summary"].select(
            F.lit(read["manifest"]["version"]).cast("bigint").alias("version"),
            F.lit(refused).alias("second_writer_refused"),
            "completed_pairs",
            rows.alias("evidence_rows"),
            F.lit(read["manifest"]["parts"]["evidence"]).cast("bigint").alias("listed_rows"),
            "accuracy",
        )
    )


@query(
    "refused_publication",
    """with e as (select id as pair_id, unnest(['reference', 'candidate']) as role from fx_evidence_pairs),
v as (select 1 as i, 'missing' as violation, (select count(*) from e where not exists (select 1
  from fx_evidence_log l where l.pair_id = e.pair_id and l.role = e.role)) as n
union all select 4, 'simulated or cached', count(*) filter (simulated or cached) from fx_evidence_log
union all select 5, 'not finished', count(*) filter (finish_reason <> 'stop') from fx_evidence_log)
select string_agg(violation || ': ' || n, '; ' order by i) as reason, 0::bigint as version from v where n > 0""",
    "evidence_pairs evidence_log",
)
def _(t: Inputs) -> DataFrame:
    """Why the whole log may not be published, and that no version of it exists."""
    base = shared_folder(t.spark, "published")
    reason = None
    try:
        evidence.publish(t.view("evidence_pairs"), t.view("evidence_log"), base, "pilot", {"run": "broken"})
    except ValueError as refusal:
        reason = str(refusal)
    version = evidence.published_version(t.spark, base, "pilot")
    return t.spark.createDataFrame([(reason, version)], "reason string, version bigint")


@query(
    "resume_plan",
    """with p as (select id as pair_id, source_id, unnest(['reference', 'candidate']) as role,
  unnest([0, 1]) as turn from fx_evidence_pairs)
select pair_id, source_id, turn, role from p where not exists (select 1 from fx_evidence_log l
  where l.pair_id = p.pair_id and l.role = p.role) order by pair_id, turn limit 300""",
    "evidence_pairs evidence_log",
)
def _(t: Inputs) -> DataFrame:
    return evidence.plan_resume(t.view("evidence_pairs"), t.view("evidence_log"), 300)


FLAGS_SQL = """
f as (select p.id, p.source_id, r.score as rs, c.score as cs from fx_evidence_pairs p
  join fx_evidence_log r on r.pair_id = p.id and r.role = 'reference'
  join fx_evidence_log c on c.pair_id = p.id and c.role = 'candidate')"""


@query(
    "pair_evidence_summary",
    f"""with {FLAGS_SQL}
select (select count(*) from fx_evidence_pairs) as planned_pairs, count(*) as completed_pairs,
  count(distinct source_id) as n_clusters, round(avg(coalesce(rs > cs, false)::int), 6) as accuracy,
  count(*) filter (rs is null or cs is null) as pairs_with_parse_failure,
  (select count(*) from fx_evidence_log) as provider_calls_recorded,
  (select sum(prompt_tokens)::bigint from fx_evidence_log) as prompt_tokens,
  (select sum(completion_tokens)::bigint from fx_evidence_log) as completion_tokens,
  (select string_agg(distinct model_served, ',' order by model_served) from fx_evidence_log)
    as models_served,
  count(*) = (select count(*) from fx_evidence_pairs) as complete from f""",
    "evidence_pairs evidence_log",
)
def _(t: Inputs) -> DataFrame:
    return rounded(evidence.summarize_pairs(t.view("evidence_pairs"), t.view("evidence_log")))


@query("pair_evidence_interval")
def _(t: Inputs) -> DataFrame:
    return evidence.accuracy_interval(t.view("evidence_pairs"), t.view("evidence_log"), 2000)


@query(
    "evidence_explorer",
    """select p.id, p.question, r.score as reference_score, c.score as candidate_score,
  coalesce(r.score > c.score, false) as ok, case when r.score > c.score then 'Correct ranking'
    else 'Failure: tied or reversed ranking' end as status
from fx_evidence_pairs p left join fx_evidence_log r on r.pair_id = p.id and r.role = 'reference'
left join fx_evidence_log c on c.pair_id = p.id and c.role = 'candidate'
where r.pair_id is not null or c.pair_id is not null""",
    "evidence_pairs evidence_log",
)
def _(t: Inputs) -> DataFrame:
    view = evidence.evidence_view(t.view("evidence_pairs"), t.view("evidence_log"))
    return view.select(
        "id", "question", "reference_score", "candidate_score", "ok", "status"
    ).orderBy("ok", "id")


@query(
    "evidence_integrity",
    """with e as (select id as pair_id, unnest(['reference', 'candidate']) as role
  from fx_evidence_pairs)
select 'missing' as violation, (select count(*) from e where not exists (select 1
  from fx_evidence_log l where l.pair_id = e.pair_id and l.role = e.role)) as n_rows
union all select 'unexpected', (select count(*) from fx_evidence_log l where not exists (
  select 1 from e where l.pair_id = e.pair_id and l.role = e.role))
union all select 'repeated', (select count(*) from (select 1 from fx_evidence_log
  group by pair_id, role having count(*) > 1))
union all select 'simulated or cached', count(*) filter (simulated or cached) from fx_evidence_log
union all select 'not finished', count(*) filter (finish_reason <> 'stop') from fx_evidence_log
union all select 'score differs from text', count(*) filter (try_cast(nullif(regexp_extract(text,
  'SCORE: (\\d+)', 1), '') as double) is distinct from score) from fx_evidence_log""",
    "evidence_pairs evidence_log",
)
def _(t: Inputs) -> DataFrame:
    return evidence.verify_evidence(t.view("evidence_pairs"), t.view("evidence_log"))


NOISY_SQL = """
noisy as (select 'j' || (o_custkey % 4) as judge, case o_orderkey % 3 when 0 then 'vague'
  when 1 then 'rubric' else 'cot' end as config, o_orderkey,
  case when o_orderkey % 23 = 5 then 'TimeoutError: slow' else '' end as error,
  case o_orderkey % 9 when 0 then 'REASONING: fine' || chr(10) || 'SCORE: ' || (o_custkey % 12)
    when 1 then '**SCORE:** ' || (o_custkey % 10 + 0.5) when 2 then 'I rate this ' || (o_custkey % 11)
    || '/10' when 3 then chr(10) || (o_custkey % 11) || chr(10) when 4 then 'no number here'
    when 5 then '<think>SCORE: 9</think>score: ' || (o_custkey % 10) || ' / 10'
    when 6 then '<Thinking>SCORE: 9' when 7 then 'SCORE: 42, no, score = ' || (o_custkey % 10)
    else (o_custkey % 10) || ' out of 10' end as raw_text from orders)"""


def noisy_log(t: Inputs) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def number(n: int):
        return (cust % n).cast("string")

    lines = [
        F.concat(F.lit("REASONING: fine\nSCORE: "), number(12)),
        F.concat(F.lit("**SCORE:** "), number(10), F.lit(".5")),
        F.concat(F.lit("I rate this "), number(11), F.lit("/10")),
        F.concat(F.lit("\n"), number(11), F.lit("\n")),
        F.lit("no number here"),
        F.concat(F.lit("<think>SCORE: 9</think>score: "), number(10), F.lit(" / 10")),
        F.lit("<Thinking>SCORE: 9"),
        F.concat(F.lit("SCORE: 42, no, score = "), number(10)),
        F.concat(number(10), F.lit(" out of 10")),
    ]
    return t.table("orders").select(
        F.concat(F.lit("j"), number(4)).alias("judge"),
        F.element_at(
            F.array(F.lit("vague"), F.lit("rubric"), F.lit("cot")), (key % 3 + 1).cast("int")
        ).alias("config"),
        "o_orderkey",
        F.when(key % 23 == 5, "TimeoutError: slow").otherwise("").alias("error"),
        F.get(F.array(*lines), (key % 9).cast("int")).alias("raw_text"),
    )


def sql_score(column: str) -> str:
    patterns = [
        "(?i)SCORE\\s*[:=]\\s*\\**\\s*(-?\\d+(?:\\.\\d+)?)",
        "(?i)\\b(?:rating|score)\\b\\D{0,12}(-?\\d+(?:\\.\\d+)?)\\s*/\\s*10",
        "(?m)^\\s*(-?\\d+(?:\\.\\d+)?)\\s*(?:/\\s*10)?\\s*$",
        "(?i)(-?\\d+(?:\\.\\d+)?)\\s*(?:out of|/)\\s*10",
    ]
    parts = [
        f"list_filter(list_transform(regexp_extract_all({column}, '{p}', 1), lambda s: s::double),"
        " lambda v: v >= 1 - 1e-9 and v <= 10 + 1e-9)[1]"
        for p in patterns
    ]
    return f"coalesce({', '.join(parts)})"


SCORES_SQL = f"""with {NOISY_SQL},
cl as (select *, {sql_clean("raw_text")} as cleaned from noisy),
sc as (select *, case when error = '' then {sql_score("cleaned")} end as score from cl)"""


@query("parsed_scores", SCORES_SQL + " select o_orderkey, judge, config, score from sc")
def _(t: Inputs) -> DataFrame:
    return judging.parse_scores(noisy_log(t)).select("o_orderkey", "judge", "config", "score")


@query(
    "parse_report",
    SCORES_SQL
    + """ select judge, config, count(*) as n_calls, count(*) filter (error <> '') as n_transport_errors,
  count(*) filter (error = '' and score is not null) as n_parsed,
  count(*) filter (error = '' and score is null) as n_unparsed,
  round(count(*) filter (error = '' and score is not null)
    / greatest(count(*) filter (error = ''), 1), 6) as parse_rate from sc group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return rounded(judging.parse_report(judging.parse_scores(noisy_log(t))))


@query(
    "parsed_verdicts",
    f"""with v as (select uid, case {SQL_VERDICT.format(c=sql_clean("rev_text"))} when 'TIE' then 'tie'
  else {SQL_VERDICT.format(c=sql_clean("rev_text"))} end as verdict from fx_pair_raw)
select uid, verdict, verdict is not null as parsed_ok from v""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    log = t.view("pair_raw").withColumn("error", F.lit(""))
    return judging.parse_verdicts(log, "rev_text").select("uid", "verdict", "parsed_ok")


@query(
    "scores_by_sql_function",
    SCORES_SQL.replace("case when error = '' then", "case when true then")
    + f""" select judge, case when score is null then null when score >= 9 then 'excellent'
  when score >= 7 then 'good' when score >= 5 then 'adequate' when score >= 3 then 'poor'
  else 'bad' end as band, count(*) as n,
  round({sql_wilson("count(score)", "count(*)", "lo")}, 6) as low from sc group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    register(t.spark)
    noisy_log(t).createOrReplaceTempView("noisy_log")
    return t.spark.sql(
        """select judge, band, n, round(low, 6) as low from (
        select judge, band, n, wilson_low(k, n) as low from (
        select judge, band, count(*) as n, count(score) as k from (
        select judge, judge_score(raw_text) as score, score_band(judge_score(raw_text)) as band
        from noisy_log) group by judge, band))"""
    )


@query(
    "steps_by_table_function",
    """select trace_id, step::int as step, tool, recorded, (name1 is not null)::int
  + (name2 is not null)::int + (name3 is not null)::int as n_args from fx_trace_calls""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    register(t.spark)
    return t.spark.sql(
        "select t.trace_id, c.step, c.tool, c.recorded, size(c.args) as n_args from {traces} t, lateral trace_calls(t.steps) c",
        traces=nested_traces(t),
    )


@query(
    "orders_by_table_function",
    """select uid, reference_first, case when reference_first then 'good ' || uid else 'bad ' || uid end as option_a,
  case when reference_first then 'bad ' || uid else 'good ' || uid end as option_b
from fx_pair_raw, (select unnest([true, false]) as reference_first)""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    register(t.spark)
    pairs = t.view("pair_raw").select(
        "uid", F.concat(F.lit("good "), "uid").alias("reference"), F.concat(F.lit("bad "), "uid").alias("degraded")
    )
    return t.spark.sql(
        "select p.uid, o.reference_first, o.option_a, o.option_b from {pairs} p, lateral both_orders(p.reference, p.degraded) o",
        pairs=pairs,
    )


@query(
    "agreement_by_sql_function",
    """with j as (select judge, score_a, score_b from (select judge, item_id, config,
    max(score) filter (replicate = 0) as score_a, max(score) filter (replicate = 1) as score_b from fx_judgments group by 1, 2, 3)
  where score_a is not null and score_b is not null),
c as (select judge, (score_a >= 5)::int as a, (score_b >= 5)::int as b from j)
select judge, round((avg((a = b)::int) - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b))))
  / (1 - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))), 6) as kappa from c group by judge""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    register(t.spark)
    return t.spark.sql(
        """with j as (select judge, item_id, config, max(score) filter (where replicate = 0) as score_a,
            max(score) filter (where replicate = 1) as score_b from {log} group by all)
        select judge, round(kappa, 6) as kappa from (
            select judge, flag_kappa(count(*), count_if(score_a >= 5), count_if(score_b >= 5),
                count_if((score_a >= 5) = (score_b >= 5))) as kappa
            from j where score_a is not null and score_b is not null group by judge)""",
        log=t.view("judgments"),
    )


def prompt_tasks(t: Inputs) -> DataFrame:
    key = F.col("o_orderkey")
    return t.table("orders").select(
        key.cast("string").alias("uid"),
        F.concat(F.lit("j"), (F.col("o_custkey") % 4).cast("string")).alias("judge"),
        F.element_at(
            F.array(F.lit("vague"), F.lit("rubric"), F.lit("cot")), (key % 3 + 1).cast("int")
        ).alias("config"),
        F.when(key % 5 == 0, "trajectory").otherwise("text").alias("kind"),
        F.col("o_orderpriority").alias("context"),
        F.col("o_orderstatus").alias("question"),
        (F.col("o_custkey") % 200).cast("string").alias("answer"),
        (key % 2 == 0).alias("reasoning"),
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT_SQL = f"""
pt as (select o_orderkey::varchar as uid, 'j' || (o_custkey % 4) as judge, case o_orderkey % 3
  when 0 then 'vague' when 1 then 'rubric' else 'cot' end as config, o_orderkey % 5 = 0 as tr,
  o_orderpriority as context, o_orderstatus as question, (o_custkey % 200)::varchar as answer
  from orders),
pr as (select *, case when tr then {_q(judging.ACTION_SPACE)} || chr(10) || chr(10)
    else 'SOURCE CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10)
    || question || chr(10) || chr(10) end
  || case when config = 'vague' then '' else case when tr then {_q(judging.TRACE_RUBRIC)}
    else {_q(judging.RUBRIC)} end || chr(10) || chr(10) end
  || case when tr then 'AGENT TRAJECTORY:' else 'CANDIDATE ANSWER:' end || chr(10) || answer
  || chr(10) || chr(10) || case config when 'vague' then {_q(judging.ASK_VAGUE)}
    when 'rubric' then {_q(judging.ASK_RUBRIC)} else {_q(judging.ASK_COT)} end as prompt from pt)"""


@query("pointwise_prompts", f"with {PROMPT_SQL} select uid, config, prompt from pr")
def _(t: Inputs) -> DataFrame:
    return judging.with_prompt(prompt_tasks(t)).select("uid", "config", "prompt")


@query(
    "pairwise_prompts",
    f"""select uid, md5('SOURCE CONTEXT:' || chr(10) || degradation || chr(10) || chr(10) || 'QUESTION:'
  || chr(10) || source_id || chr(10) || chr(10) || {_q(judging.RUBRIC)} || chr(10) || chr(10)
  || 'ANSWER A:' || chr(10) || fwd_text || chr(10) || chr(10) || 'ANSWER B:' || chr(10) || rev_text
  || chr(10) || chr(10) || {_q(judging.ASK_BETTER)} || chr(10) || chr(10)
  || {_q(judging.ASK_VERDICT)}) as prompt_hash from fx_pair_raw""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    tasks = t.view("pair_raw").select(
        "uid",
        F.lit("pairwise").alias("config"),
        F.lit("text").alias("kind"),
        F.col("degradation").alias("context"),
        F.col("source_id").alias("question"),
        F.col("fwd_text").alias("option_a"),
        F.col("rev_text").alias("option_b"),
    )
    return judging.with_pair_prompt(tasks).select("uid", F.md5("prompt").alias("prompt_hash"))


@query(
    "evidence_prompts",
    """select doc_id, case when length(text) > 4000 then 'source must contain 1 to 4000 characters' end
  as reject_reason, case when length(text) <= 4000 then 'source,question,answer' end as fields
from documents""",
)
def _(t: Inputs) -> DataFrame:
    rows = t.table("documents").select(
        "doc_id",
        F.col("text").alias("context"),
        F.col("lang").alias("question"),
        F.col("source").alias("answer"),
    )
    valid, rejected = judging.with_evidence_prompt(rows)
    keys = F.array_join(F.json_object_keys("prompt"), ",")
    return valid.select(
        "doc_id", F.lit(None).cast("string").alias("reject_reason"), keys.alias("fields")
    ).unionByName(
        rejected.select("doc_id", "reject_reason", F.lit(None).cast("string").alias("fields"))
    )


def keyed_tasks(t: Inputs) -> DataFrame:
    tasks = judging.with_prompt(prompt_tasks(t)).withColumns(
        {
            "provider": F.lit("local"),
            "model": F.col("judge"),
            "base_url": F.lit(""),
            "max_tokens": F.lit(160),
            "temperature": F.lit(0.0),
            "replicate": F.lit(0),
        }
    )
    return judging.with_request_key(tasks)


@query(
    "request_reuse",
    f"""with {PROMPT_SQL},
k as (select *, uid::bigint % 4 = 1 as stored from pr),
s as (select distinct judge, prompt from k where stored)
select (select count(*) from k where exists (select 1 from s where s.judge = k.judge
    and s.prompt = k.prompt)) as hits,
  (select count(distinct (judge, prompt)) from k where not exists (select 1 from s
    where s.judge = k.judge and s.prompt = k.prompt)) as calls""",
)
def _(t: Inputs) -> DataFrame:
    tasks = keyed_tasks(t)
    stored = (
        tasks.where(F.col("uid").cast("bigint") % 4 == 1)
        .select("request_key", F.lit("SCORE: 7").alias("text"))
        .dropDuplicates(["request_key"])
    )
    hits, misses = judging.reuse(tasks, stored)
    return hits.agg(F.count(F.lit(1)).alias("hits")).withColumn(
        "calls", misses.agg(F.count(F.lit(1)).alias("n")).scalar()
    )


def length_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a judge: its score is a function of the answer, some answers are cut off."""
    value = batch["answer"].astype(int)
    refused = value % 200 == 199
    cut = (value % 9 == 0) & (batch["max_tokens"] < 1000) & ~refused
    text = ("SCORE: " + (value % 10 + 1).astype(str)).where(~cut, "REASONING: and so")
    return pd.DataFrame(
        {
            "text": text.where(~refused, ""),
            "finish_reason": pd.Series("stop", index=batch.index).where(~cut, "length"),
            "prompt_tokens": batch["prompt"].str.len() // 4,
            "completion_tokens": 5,
            "error": pd.Series("", index=batch.index).where(~refused, "ValueError: refused"),
        }
    )


@query(
    "batch_judging",
    f"""with {PROMPT_SQL},
b as (select *, answer::int as v, (case when config = 'cot' then 512 else 160 end)
  * (case when uid::bigint % 2 = 0 then 10 else 1 end) as budget from pr),
o as (select *, v % 9 = 0 and v % 200 <> 199 and budget < 1000 as cut from b)
select judge, config, count(*) as n, count(*) filter (v % 200 = 199) as n_errors,
  count(*) filter (cut) as n_retried,
  round(avg(case when v % 200 <> 199 and not (cut and 2 * budget < 1000) then v % 10 + 1 end), 6)
    as mean_score from o group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    answered = judging.judge(
        judging.with_prompt(prompt_tasks(t)), length_scorer, piece_rows=2048
    )
    return rounded(
        answered.groupBy("judge", "config").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("error") != "").alias("n_errors"),
            F.count_if("retried").alias("n_retried"),
            F.avg("score").alias("mean_score"),
        )
    )


@query(
    "gold_checks",
    f"""with {ALL_VARIANTS_SQL},
i as (select count(*) as n, count(distinct reference) as d from refs),
v as (select count(*) filter (not introduces_error) as probes,
  count(*) filter (not introduces_error and degradation <> 'verbosity') as odd,
  count(*) filter (introduces_error and text = reference) as unchanged,
  string_agg(distinct degradation, ',' order by degradation) as kinds
  from variants join refs using (item_id))
select 'references are distinct' as name, d = n as passed, d || '/' || n as observed from i
union all select 'variants carry an audit trail', true, '0'
union all select 'only probes are free of errors', probes > 0 and odd = 0, probes::varchar from v
union all select 'error variants differ from their reference', unchanged = 0, unchanged::varchar from v
union all select 'all kinds of damage present',
  kinds = 'fabrication,hedging,numeric_swap,omission,topic_drift,verbosity', kinds from v""",
    "order_items",
)
def _(t: Inputs) -> DataFrame:
    items = order_items(t)
    checks = gates.gold_checks(
        items, tv.build_variants(items, beside=tv.references(items)), list(tv.DEGRADATIONS), tv.probe_kinds()
    )
    return checks.select("name", "passed", "observed")


@query(
    "findings",
    f"""with {OUTCOMES_SQL},
m as (select judge, 1 - avg(correct_swapped) as v,
  {sql_wilson("sum(correct_swapped)", "count(*)", "lo")} as lo,
  {sql_wilson("sum(correct_swapped)", "count(*)", "hi")} as hi
  from outcomes where degradation = '2-HIGH' group by 1 order by 2 desc, 1 limit 1),
p as (select judge, avg((not consistent)::int) as v,
  {sql_wilson("sum((not consistent)::int)", "count(*)", "lo")} as lo,
  {sql_wilson("sum((not consistent)::int)", "count(*)", "hi")} as hi
  from outcomes group by 1 order by 2 desc, 1 limit 1)
select 'argument_blindness' as finding, judge, round(v, 6) as value, round(lo, 6) as lo,
  round(hi, 6) as hi from m
union all select 'position_bias', judge, round(v, 6), round(lo, 6), round(hi, 6) from p""",
    "pair_raw",
)
def _(t: Inputs) -> DataFrame:
    resolved = outcomes(t)
    return rounded(
        reports.findings(swaps.trace_blindness(resolved), swaps.position_report(resolved), "2-HIGH")
    )


SHEET_SQL = f"""{ROWS_SQL},
{OUTCOMES_SQL.strip()},
acc as (select judge, round(avg(correct), 6) as accuracy, round(sum(tie) / count(correct), 6) as tie
  from rows_ group by 1),
pos as (select judge, round(avg((not consistent)::int), 6) as inc from outcomes group by 1)"""


@query(
    "numbers_sheet",
    f"""with {SHEET_SQL} select 'discrimination' as report, judge as level, 'accuracy' as metric,
  accuracy as value from acc union all select 'discrimination', judge, 'tie_rate', tie from acc
union all select 'position', judge, 'inconsistency_rate', inc from pos""",
    "judgments reference_scores pair_raw",
)
def _(t: Inputs) -> DataFrame:
    return rounded(_sheet(t))


def _sheet(t: Inputs) -> DataFrame:
    by_judge = discrimination_report(judged_rows(t)).where(F.col("level") == "judge")
    position = swaps.position_report(outcomes(t)).where(F.col("level") == "judge")
    return reports.numbers_sheet(
        {
            "discrimination": (by_judge, ["judge"], ["accuracy", "tie_rate"]),
            "position": (position, ["judge"], ["inconsistency_rate"]),
        }
    )


@query(
    "claim_check",
    f"""with {SHEET_SQL},
d as (select 'discrimination:' || judge as claim, accuracy as value from acc
  union all select 'position:' || judge, inc from pos),
q as (select 'discrimination:' || judge as claim, printf('%.3f', round(avg(correct), 6)
  + case when judge = 'j1' then 0.1 else 0 end) as quoted, 3 as places from rows_ group by judge
  union all select 'extra:j0', '0.5', 1)
select coalesce(d.claim, q.claim) as claim, quoted, case when value is not null
    then printf('%.' || coalesce(places, 0) || 'f', value) end as derived,
  case when quoted is null then 'not quoted' when value is null then 'not derived'
    when quoted = printf('%.' || places || 'f', value) then 'match' else 'discrepancy' end as status
from d full join q on d.claim = q.claim""",
    "judgments reference_scores pair_raw",
)
def _(t: Inputs) -> DataFrame:
    sheet = _sheet(t).where(F.col("metric") != "tie_rate").select(
        F.concat_ws(":", "report", "level").alias("claim"), F.round("value", 6).alias("value")
    )
    accuracy = judged_rows(t).groupBy("judge").agg(F.round(F.avg("correct"), 6).alias("a"))
    moved = F.col("a") + F.when(F.col("judge") == "j1", 0.1).otherwise(0.0)
    quoted = accuracy.select(
        F.concat(F.lit("discrimination:"), "judge").alias("claim"),
        F.format_string("%.3f", moved).alias("quoted"),
        F.lit(3).alias("places"),
    ).unionByName(
        accuracy.where(F.col("judge") == "j0").select(
            F.lit("extra:j0").alias("claim"), F.lit("0.5").alias("quoted"), F.lit(1).alias("places")
        )
    )
    return gates.verify_claims(quoted, sheet)


@query(
    "reliability_attachment",
    f"""with {ROWS_SQL},
by_d as (select judge, degradation, avg(correct) as a from rows_ group by 1, 2),
acc as (select judge, avg(correct) as accuracy from rows_ group by 1),
w as (select judge, arg_min(degradation, (a, degradation)) as worst from by_d group by 1)
select uid, p.judge, mode, case when mode = 'live' then round(accuracy, 6) end as accuracy,
  case when mode = 'live' then worst end as worst_degradation, mode = 'live' as available
from (select *, case when uid::bigint % 3 = 0 then 'simulated' else 'live' end as mode
  from fx_pair_raw) p join acc on acc.judge = p.judge join w on w.judge = p.judge""",
    "judgments reference_scores pair_raw",
)
def _(t: Inputs) -> DataFrame:
    verdicts = t.view("pair_raw").select(
        "uid",
        "judge",
        F.when(F.col("uid").cast("bigint") % 3 == 0, "simulated").otherwise("live").alias("mode"),
    )
    free = F.lit(0.0)
    summary = judge_summary(
        judged_rows(t).withColumn("cost_usd", free),
        t.view("reference_scores").withColumn("cost_usd", free),
    ).withColumn("mode", F.lit("live"))
    return rounded(reports.attach_reliability(verdicts, summary))
