"""Queries of the student classifier: features, splits, calibration, thresholds, gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text_features as tf
from plumbline.operators import calibration, features, gates, latency, text_variants
from plumbline.operators import student as st
from plumbline.operators.discrimination import discrimination_report
from plumbline.plans.bias import ROWS_SQL, judged_rows
from plumbline.plans.gold import order_items
from plumbline.plans.registry import Inputs, query
from plumbline.plans.shared import drained, rounded, sql_wilson, stored, table_stream
from plumbline.session import cut_lineage, ensure_checkpoint_dir
from plumbline.streaming.operators import stream_guard


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // {len(part)})"


STRUCTURAL_SQL = f"""
w as (select doc_id, text, lower(text) as lt, regexp_extract_all(lower(text), '[a-z'']+') as ws
  from documents),
s as (select *, greatest(len(ws), 1)::double as n, greatest({_count("text", ".")}
  + {_count("text", "!")} + {_count("text", "?")}, 1)::double as sen,
  length(regexp_replace(text, '[^0-9]', '', 'g')) as dig from w)
select doc_id, round(ln(1 + length(text)::double), 6) as log_chars,
  round(ln(1 + len(ws)::double), 6) as log_words,
  round(len(list_distinct(ws)) / n, 6) as type_token_ratio,
  round(len(list_filter(ws, lambda x: list_contains({_list(tf.HEDGE_WORDS)}, x))) / n, 6)
    as hedge_density,
  ({" + ".join(_count("lt", p) for p in tf.FILLER_PHRASES)})::double as filler_count,
  round(dig / greatest(length(text), 1), 6) as numeric_density,
  round({_count("text", ",")} / sen, 6) as commas_per_sentence,
  round(n / sen, 6) as words_per_sentence,
  (upper(substr(text, 1, 1)) = substr(text, 1, 1) and lower(substr(text, 1, 1))
    <> substr(text, 1, 1))::int::double as capital_start,
  round(ln(1 + sen), 6) as log_sentences,
  round(len(list_filter(ws, lambda x: length(x) > 9)) / n, 6) as long_word_share,
  regexp_matches(text, '\\bp\\s*=\\s*0')::int::double as p_equals_zero from s"""


@query("structural_features", f"with {STRUCTURAL_SQL.strip()}")
def _(t: Inputs) -> DataFrame:
    docs = t.table("documents").select("doc_id", "text")
    return rounded(features.structural_features(docs, "text").drop("text"))


def covered_documents(t: Inputs) -> DataFrame:
    """Each document as an answer, with the next one as its source."""
    docs = t.table("documents").select("doc_id", F.col("text").alias("answer"), F.col("source").alias("question"))
    following = t.table("documents").select(
        (F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context")
    )
    return docs.join(following, "doc_id")


@query(
    "coverage_features",
    f"""with d as (select a.doc_id, a.text as answer, a.source as question, b.text as context
  from documents a join documents b on b.doc_id = a.doc_id + 1),
w as (select doc_id, answer,
  list_filter(list_distinct(regexp_extract_all(lower(context), '[a-z'']+')),
    lambda x: not list_contains({_list(tf.STOP_WORDS)}, x)) as c,
  list_filter(list_distinct(regexp_extract_all(lower(answer), '[a-z'']+')),
    lambda x: not list_contains({_list(tf.STOP_WORDS)}, x)) as a,
  list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z'']+')),
    lambda x: not list_contains({_list(tf.STOP_WORDS)}, x)) as q,
  length(regexp_replace(answer, '[^0-9]', '', 'g')) as dig from d)
select doc_id, case when len(c) = 0 then 0 else round(len(list_intersect(c, a)) / len(c), 6) end
  as source_coverage,
  case when len(c) = 0 then 0 else round(len(list_intersect(c, a)) / greatest(len(a), 1), 6) end
  as groundedness,
  case when len(c) = 0 then 0 else round((len(a) - len(list_intersect(c, a))) / greatest(len(a), 1), 6)
  end as unsupported_vocabulary,
  case when len(c) = 0 then 0 else round(len(list_intersect(q, a)) / greatest(len(q), 1), 6) end
  as on_question,
  case when len(c) = 0 then 0 else round(len(a) / len(c), 6) end as relative_size,
  case when len(c) = 0 then 0 else round(dig / greatest(len(a), 1), 6) end as digits_per_word from w""",
)
def _(t: Inputs) -> DataFrame:
    out = features.coverage_features(covered_documents(t))
    return rounded(out.select("doc_id", *tf.COVERAGE))


@query(
    "rendered_examples",
    """select a.doc_id, md5('CONTEXT: ' || b.text || chr(10) || 'QUESTION: ' || a.source || chr(10)
  || '[SEP]' || chr(10) || 'ANSWER: ' || a.text) as text_hash, true as restored
from documents a join documents b on b.doc_id = a.doc_id + 1""",
)
def _(t: Inputs) -> DataFrame:
    docs = covered_documents(t).withColumnsRenamed(
        {"answer": "a0", "question": "q0", "context": "c0"}
    )
    text = features.render_example(F.col("q0"), F.col("a0"), F.col("c0"))
    back = features.split_example(docs.withColumn("text", text))
    same = (
        (F.col("answer") == F.col("a0"))
        & (F.col("question") == F.col("q0"))
        & (F.col("context") == F.col("c0"))
    )
    return back.select("doc_id", F.md5("text").alias("text_hash"), same.alias("restored"))


@query(
    "gram_counts",
    """with t as (select doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as ws0,
  list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as tk from documents),
w as (select doc_id, list_filter(ws0, lambda x: length(x) >= 2) as ws, tk from t)
select doc_id, (len(ws) + greatest(len(ws) - 1, 0))::int as n_word_grams,
  coalesce(list_sum(list_transform(tk, lambda x: length(x) + greatest(length(x) - 1, 0))), 0)::int
    as n_char_grams from w""",
)
def _(t: Inputs) -> DataFrame:
    docs = t.table("documents")
    return docs.select(
        "doc_id",
        F.size(features.word_grams(F.col("text"))).alias("n_word_grams"),
        F.size(features.char_grams(F.col("text"))).alias("n_char_grams"),
    )


@query(
    "teacher_labels",
    """select judge || ':' || item_id || ':' || config || ':' || replicate as uid, (score >= 7)::int as teacher_label,
  (severity < 0.3)::int as truth_label, degradation, score as teacher_score
from fx_judgments where score is not null""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    log = t.view("judgments")
    shaped = log.select(
        F.concat_ws(":", "judge", "item_id", "config", F.col("replicate").cast("string")).alias("uid"),
        "item_id",
        F.lit("q").alias("question"),
        F.col("config").alias("answer"),
        F.lit("").alias("context"),
        "score",
        (F.col("severity") < 0.3).alias("is_reference"),
        "degradation",
        "severity",
    )
    labels = calibration.label_from_scores(shaped)
    return labels.select("uid", "teacher_label", "truth_label", "degradation", "teacher_score")


@query(
    "stratification_level",
    """with c as (select item_group, teacher_label, count(*) as n from fx_student group by 1, 2),
m as (select min(n) as a, (select min(n) from (select sum(n)::bigint as n from c group by item_group))
  as b, (select min(n) from (select sum(n)::bigint as n from c group by teacher_label)) as d from c)
select a as min_group_label, b as min_group, d as min_label, case when a >= 6 then 'group and label'
  when b >= 6 then 'group' else 'label' end as level from m""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return calibration.stratification_level(t.view("student"), "item_group", "teacher_label")


SPLIT_SQL = """
g as (select item_group, row_number() over (order by md5(item_group || '|split|20260731'), item_group)
  as ord, count(*) over () as n from (select distinct item_group from fx_student)),
cut as (select *, ceil(0.2::double * n) as nt, ceil((0.2::double / (1.0::double - 0.2::double))
  * (n - ceil(0.2::double * n))) as nc from g),
sp as (select s.*, case when ord <= nt then 'test' when ord <= nt + nc then 'calibration'
  else 'train' end as split from fx_student s join cut using (item_group))"""


def split_rows(t: Inputs) -> DataFrame:
    return calibration.group_split(t.view("student"), "item_group")


@query("group_split", f"with {SPLIT_SQL} select uid, item_group, split from sp", "student")
def _(t: Inputs) -> DataFrame:
    return split_rows(t).select("uid", "item_group", "split")


@query(
    "row_split",
    """with r as (select uid, teacher_label, row_number() over (partition by teacher_label
  order by md5(uid || '|split|20260731'), uid) as ord, count(*) over (partition by teacher_label) as n
  from fx_student)
select uid, case when ord <= round_even(0.2::double * n, 0) then 'test'
  when ord <= round_even(0.2::double * n, 0) + round_even(0.2::double * n, 0) then 'calibration'
  else 'train' end as split from r""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return calibration.row_split(t.view("student"), "teacher_label", "uid").select("uid", "split")


TABLE_SQL = """
b as (select greatest(1, 1 + """ + " + ".join(f"(p > {e!r}::double)::int" for e in [float(x) for x in __import__("numpy").linspace(0, 1, 11)[1:-1]]) + """) as bin,
  p, truth_label as y from fx_student),
ct as (select bin, count(*) as n, avg(p) as confidence, avg(y) as accuracy from b group by 1)"""


@query(
    "calibration_table",
    f"""with {TABLE_SQL} select d.bin::int as bin, round((d.bin - 1) / 10, 6) as bin_lo,
  round(d.bin / 10, 6) as bin_hi, coalesce(n, 0) as n, round(confidence, 6) as confidence,
  round(accuracy, 6) as accuracy from range(1, 11) d(bin) left join ct on ct.bin = d.bin""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return rounded(calibration.calibration_table(t.view("student"), "p", "truth_label"))


@query(
    "expected_calibration_error",
    f"with {TABLE_SQL} select round(sum(n * abs(accuracy - confidence)) / sum(n), 6) as ece from ct",
    "student",
)
def _(t: Inputs) -> DataFrame:
    table = calibration.calibration_table(t.view("student"), "p", "truth_label")
    return rounded(calibration.ece(table))


@query(
    "binary_metrics",
    """with r as (select p, truth_label as y, rank() over (order by p)
  + (count(*) over (partition by p) - 1) / 2.0 as rk from fx_student)
select count(*) as n, round(avg((p - y) ** 2), 6) as brier,
  round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y)
    * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) as log_loss,
  round(avg(((p >= 0.5)::int = y)::int), 6) as accuracy,
  round((sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6)
    as auc from r""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return rounded(calibration.binary_metrics(t.view("student"), "p", "truth_label"))


CUTS_SQL = "[" + ", ".join(f"{c!r}::double" for c in calibration.THRESHOLDS) + "]"
THRESHOLD_SQL = f"""
k as (select unnest({CUTS_SQL}) as thr),
tt as (select thr, count(*) filter (p >= thr and y = 1) as ag, count(*) filter (p >= thr and y = 0)
  as ab, count(*) filter (y = 1) as g, count(*) filter (y = 0) as b
  from k, (select p, teacher_label as y from fx_student) group by thr),
bt as (select thr from tt where ag + ab > 0 and ab / (ag + ab) <= 0.45::double
  order by (ag / g + (b - ab) / b) / 2 desc, thr limit 1),
chosen as (select coalesce((select thr from bt), 0.5) as thr)"""


@query(
    "threshold_table",
    f"""with {THRESHOLD_SQL} select round(thr, 6) as threshold, ag as allowed_good, ab as allowed_bad,
  g as good, b as bad from tt""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return rounded(calibration.threshold_table(t.view("student"), "p", "teacher_label"))


@query(
    "chosen_threshold",
    f"""with {THRESHOLD_SQL} select round(thr, 6) as threshold, exists (select 1 from bt) as feasible
from chosen""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return rounded(calibration.choose_threshold(t.view("student"), "p", "teacher_label", 0.45))


@query(
    "oracle_cut",
    """with s as (select score, (severity < 0.3)::int as y from fx_judgments where score is not null),
c as (select distinct score as cut from s),
a as (select cut, avg(((score >= cut)::int = y)::int) as acc from c, s group by 1)
select cut, round(acc, 6) as accuracy from a order by acc desc, cut limit 1""",
    "judgments",
)
def _(t: Inputs) -> DataFrame:
    scored = t.view("judgments").select("score", (F.col("severity") < 0.3).cast("int").alias("y"))
    return rounded(calibration.oracle_cut(scored, "score", "y"))


POINT_SQL = """select count(*) as n,
  round(count(*) filter (p < {thr} and y = 0) / greatest(count(*) filter (p < {thr}), 1), 6)
    as block_precision,
  round(count(*) filter (p < {thr} and y = 1) / greatest(count(*) filter (y = 1), 1), 6)
    as false_block_rate,
  round(count(*) filter (p < {thr} and y = 0) / greatest(count(*) filter (y = 0), 1), 6)
    as bad_output_caught,
  round(count(*) filter (p >= {thr} and y = 0) / greatest(count(*) filter (p >= {thr}), 1), 6)
    as false_allow_rate,
  round(count(*) filter (p < {thr}) / count(*), 6) as block_rate,
  round(count(*) filter ((p >= {thr}) = (y = 1)) / count(*), 6) as accuracy,
  round((count(*) filter (p >= {thr} and y = 1) / count(*) filter (y = 1)
    + count(*) filter (p < {thr} and y = 0) / count(*) filter (y = 0)) / 2, 6) as balanced_accuracy,
  round(greatest(count(*) filter (y = 1), count(*) filter (y = 0)) / count(*), 6)
    as majority_baseline from {source}"""


@query(
    "operating_point",
    POINT_SQL.format(thr="0.45", source="(select p, truth_label as y from fx_student)"),
    "student",
)
def _(t: Inputs) -> DataFrame:
    return rounded(calibration.operating_point(t.view("student"), "p", "truth_label", 0.45))


def decisions(t: Inputs) -> DataFrame:
    return t.view("student").select(
        "uid",
        "degradation",
        "p",
        "truth_label",
        "teacher_label",
        (F.col("p") >= 0.45).cast("int").alias("student_label"),
    )


@query(
    "fidelity",
    f"""with c as (select degradation, count(*) as n, sum(((p >= 0.45)::int = truth_label)::int) as s,
  sum((teacher_label = truth_label)::int) as tc from fx_student group by 1 having count(*) >= 5)
select degradation, n, round(s / n, 6) as student_accuracy,
  round({sql_wilson("s", "n", "lo")}, 6) as lo, round({sql_wilson("s", "n", "hi")}, 6) as hi,
  round(tc / n, 6) as teacher_accuracy,
  row_number() over (order by s / n, degradation) = 1 as blind_spot from c""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    return rounded(
        calibration.fidelity(decisions(t), "student_label", "teacher_label", "truth_label")
    )


@query(
    "cascade",
    f"""with x as (select abs(p - 0.45::double) / 0.55::double as cf,
  ((p >= 0.45)::int = truth_label)::int as sc, (teacher_label = truth_label)::int as tc
  from fx_student),
m as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.01]::double[]) as margin),
r as (select margin, count(*) as n, avg((cf < margin)::int) as e,
  sum(case when cf >= margin then sc else tc end) as k, avg(tc) as jo from x, m group by 1),
v as (select *, {sql_wilson("k", "n", "lo")} as lo, {sql_wilson("k", "n", "hi")} as hi from r)
select margin, round(e, 6) as escalation_rate, round(k / n, 6) as combined_accuracy,
  round(lo, 6) as lo, round(hi, 6) as hi, round(e * 0.27, 6) as cost_per_1k_usd,
  round(4 + e * 300, 6) as mean_latency_ms, lo <= jo and jo <= hi as viable,
  lo <= jo and jo <= hi and margin = (select arg_min(margin, (e, margin)) from v
    where lo <= jo and jo <= hi) as recommended from v""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    rows = decisions(t).select(
        "p",
        (F.col("student_label") == F.col("truth_label")).cast("int").alias("sc"),
        (F.col("teacher_label") == F.col("truth_label")).cast("int").alias("tc"),
    )
    return rounded(calibration.cascade(rows, "p", "sc", "tc", 0.45, 0.27, 4.0, 300.0))


@query(
    "picked_teacher",
    f"""with {ROWS_SQL},
a as (select judge, config, avg(correct) as acc from rows_ group by 1, 2)
select judge, config, 0 as priority from a order by acc desc, judge, config limit 1""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    rows = judged_rows(t)
    ablation = rows.groupBy("judge", "config").agg(F.avg("correct").alias("accuracy"))
    discrimination = discrimination_report(rows).where(F.col("level") == "judge").select(
        "judge", F.lit("cot").alias("config"), "accuracy"
    )
    panel = t.view("models").select(
        F.col("alias").alias("judge"), F.lit("cot").alias("config"), F.lit(1).alias("position")
    )
    return calibration.pick_teacher(ablation, discrimination, panel)


@query(
    "guard_reasons",
    f"""with {STRUCTURAL_SQL.strip().replace(" from w)", " from w),").replace("select doc_id, round(ln(1 + length", "f as (select doc_id, round(ln(1 + length", 1)}),
r as (select f.*, p from f join fx_student on uid = doc_id::varchar)
select doc_id, case when p >= 0.5 then 'allow' else 'block' end as decision,
  'p(acceptable)=' || printf('%.3f', p) || case when p >= 0.5 then ' at or above threshold 0.50'
    else ' below threshold 0.50' || case when hedge_density > 0.02 or filler_count >= 2
      or numeric_density < 0.005 then '; contributing signals: ' else '' end
    || concat_ws(', ', case when hedge_density > 0.02 then 'high hedge-word density' end,
      case when filler_count >= 2 then 'content-free filler phrases' end,
      case when numeric_density < 0.005 then 'few committed numeric claims' end) end as reason
from r""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    signals = features.structural_features(t.table("documents").select("doc_id", "text"), "text")
    scored = signals.join(
        t.view("student").select(F.col("uid").cast("bigint").alias("doc_id"), "p"), "doc_id"
    )
    return st.decide(scored, 0.5).select("doc_id", "decision", "reason")


@query(
    "leaked_sources",
    f"""with {SPLIT_SQL},
l as (select item_group, case when uid::bigint % 97 = 3 then 'test' else split end as split from sp)
select item_group from l where split = 'test' intersect select item_group from l where split <> 'test'""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    broken = split_rows(t).withColumn(
        "split", F.when(F.col("uid").cast("bigint") % 97 == 3, "test").otherwise(F.col("split"))
    )
    return gates.leakage(broken, "item_group")


@query(
    "student_gate",
    f"""with {SPLIT_SQL}, {TABLE_SQL.strip()},
op as ({POINT_SQL.format(thr="0.45", source="(select p, truth_label as y from fx_student)")}),
e as (select sum(n * abs(accuracy - confidence)) / sum(n) as ece from ct),
l as (select quantile_cont(ms, 0.99) as p99 from fx_requests),
bs as (select degradation, avg(((p >= 0.45)::int = truth_label)::int) as a from fx_student
  where degradation in ('en', 'fr') group by 1)
select 'accuracy' as name, accuracy >= 0.85 as passed, true as gating from op
union all select 'block_precision', block_precision >= 0.9, true from op
union all select 'false_block_rate', false_block_rate <= 0.05, true from op
union all select 'bad_output_caught', bad_output_caught >= 0.35, true from op
union all select 'ece', ece <= 0.15, true from e
union all select 'p99_ms', p99 <= 150, true from l
union all select 'held-out sources are separate', true, true
union all select 'blind spot: ' || degradation, a <= 0.25, false from bs""",
    "student requests",
)
def _(t: Inputs) -> DataFrame:
    student = t.view("student")
    point = calibration.operating_point(student, "p", "truth_label", 0.45)
    error = calibration.ece(calibration.calibration_table(student, "p", "truth_label"))
    slow = latency.percentile_linear(
        t.view("requests").withColumn("g", F.lit("all")), ["g"], "ms", 0.99
    ).select("value")
    measures = point.withColumn("ece", error.scalar()).withColumn("p99_ms", slow.scalar())
    by_defect = calibration.fidelity(
        decisions(t), "student_label", "teacher_label", "truth_label"
    ).withColumnRenamed("student_accuracy", "accuracy")
    checks = gates.run_gate(
        [
            gates.quality_checks(measures),
            gates.leakage_check(split_rows(t), "item_group"),
            gates.blind_spot_checks(by_defect, ["en", "fr"], gating=False),
        ]
    )
    return checks.select("name", "passed", "gating")


@query(
    "gate_verdict",
    f"""with {TABLE_SQL.strip()},
op as ({POINT_SQL.format(thr="0.45", source="(select p, truth_label as y from fx_student)")}),
e as (select sum(n * abs(accuracy - confidence)) / sum(n) as ece from ct),
c as (select accuracy >= 0.85 as passed from op union all select ece <= 0.15 from e)
select count(*) as n_checks, count(*) filter (passed) as n_passed, bool_and(passed) as gate_passed
from c""",
    "student",
)
def _(t: Inputs) -> DataFrame:
    student = t.view("student")
    point = calibration.operating_point(student, "p", "truth_label", 0.45)
    error = calibration.ece(calibration.calibration_table(student, "p", "truth_label"))
    bounds = {k: gates.BOUNDS[k] for k in ("accuracy", "ece")}
    return gates.gate_verdict(
        gates.quality_checks(point.withColumn("ece", error.scalar()), bounds)
    )


@query(
    "interval_gate",
    f"""with {ROWS_SQL},
r as (select judge, count(correct) as n, {sql_wilson("sum(correct)", "count(correct)", "lo")} as lo,
  {sql_wilson("sum(correct)", "count(correct)", "hi")} as hi from rows_ group by judge)
select 'interval of ' || judge as name, hi > lo or n < 3 as passed, printf('%.3f, %.3f', lo, hi) as observed,
  'a real interval' as expected, true as gating from r""",
    "judgments reference_scores",
)
def _(t: Inputs) -> DataFrame:
    report = discrimination_report(judged_rows(t)).where(F.col("level") == "judge")
    return gates.interval_checks(report.withColumnRenamed("n_pairs", "n"), "judge")


def labelled_examples(t: Inputs) -> DataFrame:
    """The labelled documents as rendered examples."""
    following = t.table("documents").select(
        (F.col("doc_id") - 1).cast("string").alias("uid"), F.col("text").alias("source_text")
    )
    rows = t.view("student").join(following, "uid", "left")
    text = features.render_example(
        F.col("item_group"), F.col("answer"), F.coalesce("source_text", F.lit(""))
    )
    return rows.select(
        "uid", "item_group", "degradation", "teacher_label", "truth_label", text.alias("text")
    )


def split_students(t: Inputs) -> DataFrame:
    """The labelled examples and their split, stored once as texts.

    Features are made where they are used: they are many times as large as their text, and a guard asks for none of the test rows.
    """
    return stored(calibration.group_split(labelled_examples(t), "item_group"), "split")


ROWS_PER_TASK = 20_000


def fitted(train: DataFrame, *names: str) -> st.Student:
    """A student of rendered texts; ``names`` are those of label and group where they are not the usual ones.

    Folds are dealt among texts, as features are many times as large, and the texts evenly to tasks, as the few files of a split are not even.
    """
    count = train.count()
    tasks = max(2 * train.sparkSession.sparkContext.defaultParallelism, count // ROWS_PER_TASK)
    dealt = st.with_folds(train, *names).repartition(tasks)
    return st.fit_student(features.hashing_features(dealt), *names, count=count)


def trained(split: DataFrame) -> st.Student:
    model = fitted(split.where(F.col("split") == "train"))
    return st.recalibrate(model, split.where(F.col("split") == "calibration"), predict=st.predict_texts)


@query("hashed_features")
def _(t: Inputs) -> DataFrame:
    out = features.hashing_features(labelled_examples(t))
    return out.select(
        "uid",
        F.size("features.indices").alias("n_features"),
        F.aggregate("features.indices", F.lit(0).cast("bigint"), lambda a, i: a + i).alias("index_sum"),
        F.round(F.aggregate("features.values", F.lit(0.0), lambda a, v: a + v), 6).alias("value_sum"),
    )


@query(
    "embedding_features",
    f"""with {STRUCTURAL_SQL.strip().replace(" from w)", " from w),").replace("select doc_id, round(ln(1 + length", "f as (select doc_id, round(ln(1 + length", 1)})
select doc_id, (len(embedding) + 18)::int as n_features,
  round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as vector_sum,
  round(log_chars + log_words + type_token_ratio + hedge_density + filler_count + numeric_density + commas_per_sentence
    + words_per_sentence + capital_start + log_sentences + long_word_share + p_equals_zero, 4) as interpretable_sum
from f join embeddings on vec_id = doc_id""",
)
def _(t: Inputs) -> DataFrame:
    vectors = t.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = t.table("documents").select(
        "doc_id", features.render_example(F.col("source"), F.col("text"), F.lit("")).alias("text")
    )
    out = features.embedding_features(docs.join(vectors, "doc_id"), "embedding")
    given = F.size("embedding")
    rest = F.transform(F.slice("features.values", given + 1, F.lit(18)), lambda v: F.round(v, 6))

    def total(values: Column) -> Column:
        return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 4)

    return out.select(
        "doc_id",
        F.size("features.values").alias("n_features"),
        total(F.slice("features.values", F.lit(1), given)).alias("vector_sum"),
        total(rest).alias("interpretable_sum"),
    )


@query("trained_student")
def _(t: Inputs) -> DataFrame:
    split = split_students(t)
    model = trained(split)
    path = f"{ensure_checkpoint_dir(t.spark)}/student-{uuid.uuid4().hex}"
    st.save_student(model, t.spark, path)
    loaded = st.load_student(t.spark, path)
    test = st.predict_texts(split.where(F.col("split") == "test"), loaded)
    point = calibration.operating_point(test, "p", "truth_label", loaded.threshold)
    return point.withColumn("threshold", F.lit(loaded.threshold))


def document_requests(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.col("source").alias("question"),
        F.col("text").alias("answer"),
        F.lit("").alias("context"),
    )


@query("guarded_documents")
def _(t: Inputs) -> DataFrame:
    model = trained(split_students(t))
    requests = document_requests(t.table("documents"))
    return st.guard(requests, model).select("doc_id", "p", "decision", "reason")


@query("streamed_guard")
def _(t: Inputs) -> DataFrame:
    """The documents as a stream through the guard."""
    model = trained(split_students(t))
    requests = document_requests(table_stream(t, "documents"))
    return drained(stream_guard(requests, model), "append").select("doc_id", "p", "decision", "reason")


@query("held_out_probes")
def _(t: Inputs) -> DataFrame:
    """A student of the balanced gold sample, met with the padded references it was never shown."""
    items = order_items(t)
    drawn = text_variants.build_variants(items, sample_seed=text_variants.SEED)
    drawn = drawn.select("item_id", "variant_id", "uid", "severity", "degradation", "text", "introduces_error")
    training, probes = text_variants.balanced_sample(items, stored(drawn, "variants"))  # training rows and probes are drawn from the same
    asked = items.select("item_id", "question", "context")

    def rendered(rows: DataFrame) -> DataFrame:
        text = features.render_example(F.col("question"), F.col("text"), F.col("context"))
        return rows.join(asked, "item_id").select("uid", "item_id", "truth", text.alias("text"))

    # features are made where they are used: stored, those of all items would take many times the space of the texts
    split = stored(calibration.group_split(stored(rendered(training), "examples"), "item_id"), "split")

    model = fitted(split.where(F.col("split") == "train"), "truth", "item_id")
    model = st.recalibrate(model, split.where(F.col("split") == "calibration"), "truth", predict=st.predict_texts)
    return st.probe_report(st.predict_texts(rendered(probes), model), model.threshold)
