"""Queries that damage, render and replay agent traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import trace_audit, traces
from plumbline.plans.registry import Inputs, query
from plumbline.plans.shared import rounded


def nested_traces(t: Inputs) -> DataFrame:
    """The call view regrouped to one row per trace; a conversation has few turns."""

    def arg(n: int):
        return F.struct(
            F.col(f"name{n}").alias("name"), F.col(f"arg{n}").alias("text"), F.lit(False).alias("number")
        )

    args = F.filter(F.array(arg(1), arg(2), arg(3)), lambda a: a["name"].isNotNull())
    step = F.struct(
        "step",
        "tool",
        args.alias("args"),
        F.col("recorded").alias("result"),
        F.when(F.col("step") % 2 == 0, "as planned").otherwise("").alias("reasoning"),
    )
    grouped = t.view("trace_calls").groupBy("trace_id", "answer_kind").agg(
        F.array_sort(F.collect_list(step)).alias("ordered")
    )
    steps = F.transform(
        "ordered",
        lambda s: F.struct(s["tool"], s["args"], s["result"], s["reasoning"]),
    )
    return grouped.select(
        "trace_id",
        F.concat(F.lit("Plan transport "), "trace_id").alias("task"),
        steps.cast(traces.STEPS_TYPE).alias("steps"),
        F.lit("42 kg").alias("final_answer"),
        F.when(F.col("answer_kind") == 0, "42 kg")
        .when(F.col("answer_kind") == 1, " 42 kg ")
        .when(F.col("answer_kind") == 2, "41 kg")
        .alias("expected_final_answer"),
    )


FACTOR_SQL = " ".join(
    f"when lower(arg2) = '{a}' and lower(arg3) = '{b}' then {f!r}::double"
    for a, b, f in trace_audit.CONVERSION_FACTORS
)
LOOKUP_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in trace_audit.LOOKUP_TABLE.items())

STATUS_SQL = f"""
rep as (select *, case tool when 'lookup' then case arg1 {LOOKUP_SQL} end
  when 'unit_convert' then regexp_replace(regexp_replace(printf('%.4f',
    try_cast(arg1 as double) * case {FACTOR_SQL} end), '0+$', ''), '\\.$', '')
  when 'date_diff' then datediff('day', try_cast(arg1 as date), try_cast(arg2 as date))::varchar
  when 'calculator' then regexp_replace(regexp_replace(printf('%.4f',
    try_cast(split_part(arg1, ' ', 1) as double) * 2.5 + try_cast(split_part(arg1, ' ', 5) as double)),
    '0+$', ''), '\\.$', '') end as replayed from fx_trace_calls),
st as (select *, case when tool not in ('lookup', 'unit_convert', 'date_diff', 'calculator')
  then 'unsupported_tool' when replayed is null then 'invalid_call'
  when trim(replayed) <> trim(recorded) then 'result_mismatch' else 'passed' end as status from rep)"""


@query(
    "trace_steps",
    """select trace_id, step::int as step, tool, recorded, (name1 is not null)::int
  + (name2 is not null)::int + (name3 is not null)::int as n_args from fx_trace_calls""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    calls = trace_audit.explode_steps(nested_traces(t))
    return calls.select("trace_id", "step", "tool", "recorded", F.size("args").alias("n_args"))


@query(
    "step_status",
    f"with {STATUS_SQL} select trace_id, step::int as step, tool, replayed, status from st",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    checked = trace_audit.step_status(trace_audit.explode_steps(nested_traces(t)))
    return checked.select("trace_id", "step", "tool", "replayed", "status")


def _register_tool(tool: str, name: str) -> None:
    @query(
        name,
        f"""with {STATUS_SQL} select trace_id, step::int as step, replayed from st
where tool = '{tool}'""",
        "trace_calls",
    )
    def _(t: Inputs) -> DataFrame:
        calls = trace_audit.explode_steps(nested_traces(t)).where(F.col("tool") == tool)
        return trace_audit.TOOLS[tool](calls).select("trace_id", "step", "replayed")


for _tool, _name in (
    ("lookup", "replay_lookup"),
    ("unit_convert", "replay_convert"),
    ("date_diff", "replay_date_diff"),
    ("calculator", "replay_calculator"),
):
    _register_tool(_tool, _name)


@query(
    "trace_audit",
    f"""with {STATUS_SQL},
rpt as (select trace_id, step, row_number() over (partition by trace_id, tool, name1, arg1,
  coalesce(arg2, ''), coalesce(arg3, '') order by step) as rn from fx_trace_calls),
roll as (select st.trace_id, count(*) as steps_checked, count(*) filter (status <> 'passed')
  as step_failures, string_agg(st.status, ',' order by st.step) as statuses,
  case any_value(answer_kind) when 0 then true when 1 then true when 2 then false end as ok,
  coalesce(string_agg(st.step, ',' order by st.step) filter (rn > 1), '') as repeats
  from st join rpt on rpt.trace_id = st.trace_id and rpt.step = st.step group by 1)
select trace_id, steps_checked, step_failures, ok as answer_matches_expected, statuses, repeats,
  case when step_failures > 0 or not coalesce(ok, true) then 'failed' when ok then 'passed'
    else 'consistent' end as status from roll""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    return trace_audit.audit(nested_traces(t)).select(
        "trace_id",
        "steps_checked",
        "step_failures",
        "answer_matches_expected",
        "status",
        F.array_join("checked.status", ",").alias("statuses"),
        F.array_join(F.col("repeats").cast("array<string>"), ",").alias("repeats"),
    )


@query(
    "audit_report",
    f"""with {STATUS_SQL} select case when grouping(tool) = 1 then '(all)' else tool end as tool,
  case when grouping(status) = 1 then '(all)' else status end as status, count(*) as calls
from st group by cube (tool, status)""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    return trace_audit.audit_report(trace_audit.step_status(trace_audit.explode_steps(nested_traces(t))))


RENDER_SQL = """
lines as (select trace_id, step, 'STEP ' || step || ': call ' || tool || '(' || name1 || '=''' || arg1
  || '''' || coalesce(', ' || name2 || '=''' || arg2 || '''', '')
  || coalesce(', ' || name3 || '=''' || arg3 || '''', '') || ') -> ' || recorded
  || case when step % 2 = 0 then chr(10) || '        rationale: as planned' else '' end as line
  from fx_trace_calls),
texts as (select trace_id, 'TASK: Plan transport ' || trace_id || chr(10)
  || string_agg(line, chr(10) order by step) || chr(10) || 'FINAL ANSWER: 42 kg' as text
  from lines group by trace_id)"""


@query("rendered_traces", f"with {RENDER_SQL} select trace_id, text from texts", "trace_calls")
def _(t: Inputs) -> DataFrame:
    return traces.render_trace(nested_traces(t)).select("trace_id", "text")


GRID_SQL = "grid as (select * from (values (0.2::double, '0.2'), (0.5::double, '0.5'), (0.9::double, '0.9')) g(severity, lab))"


def sql_draw(kind: str, tail: str) -> str:
    return f"md5(trace_id || '|{kind}|' || lab || '|20260731|' || {tail})"


def sql_insertions(kind: str, k: str, names: str, last: str) -> str:
    place = f"('0x' || substr({sql_draw(kind, chr(39) + 'place|' + chr(39) + ' || ord')}, 1, 7))::bigint"
    return f"""with {GRID_SQL},
n as (select trace_id, count(*) as n from fx_trace_calls group by 1),
names as (select unnest({names}) as nm, unnest(range(0, len({names}))) as j),
picked as (select trace_id, n, severity, lab, nm, row_number() over (partition by trace_id, lab
  order by {sql_draw(kind, "j")}, j) - 1 as ord from n, grid, names),
ins as (select trace_id, severity, nm as tool, {place} % ({last} + 1) as place, 0 as orig, ord
  from picked where ord < {k}),
al as (select * from ins union all select trace_id, severity, tool, step - 1, 1, 0
  from fx_trace_calls, grid)
select trace_id, severity, string_agg(tool, ',' order by place, orig, ord) as tools from al
group by 1, 2"""


@query(
    "traces_length_padding",
    sql_insertions(
        "length_padding",
        "least(greatest(1, round_even(severity * 4, 0)::int), 4)",
        "['lookup', 'lookup', 'calculator', 'lookup']",
        "n",
    ),
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    variants = traces.build_trace_variants(nested_traces(t), ["length_padding"])
    return variants.select("trace_id", "severity", F.array_join("steps.tool", ",").alias("tools"))


@query(
    "traces_phantom_tool",
    sql_insertions(
        "phantom_tool",
        "greatest(1, round_even(severity * 2, 0)::int)",
        "['web_search', 'sql_query', 'currency_api', 'weather_lookup', 'geocode']",
        "greatest(n - 1, 0)",
    ),
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    variants = traces.build_trace_variants(nested_traces(t), ["phantom_tool"])
    return variants.select("trace_id", "severity", F.array_join("steps.tool", ",").alias("tools"))


@query(
    "traces_silent_failure",
    f"""with {GRID_SQL},
r as (select c.*, severity, lab, count(*) over (partition by trace_id, lab) as n, row_number() over (
  partition by trace_id, lab order by {sql_draw("silent_failure", "(step - 1)")}, step) as rn
  from fx_trace_calls c, grid),
s as (select *, case when rn <= greatest(1, round_even(severity * least(2, n), 0)::int)
  then coalesce(regexp_replace(regexp_replace(printf('%.4f', try_cast(recorded as double)
    * (1.0::double + (0.1::double + 0.6::double * severity))), '0+$', ''), '\\.$', ''),
    '(unavailable)') else recorded end as result from r)
select trace_id, severity, string_agg(result, ',' order by step) as results from s group by 1, 2""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    variants = traces.build_trace_variants(nested_traces(t), ["silent_failure"])
    return variants.select("trace_id", "severity", F.array_join("steps.result", ",").alias("results"))


@query(
    "traces_wrong_argument",
    f"""with {GRID_SQL},
d as (select c.*, severity, lab, row_number() over (partition by trace_id, lab order by step) - 1 as j,
  count(*) over (partition by trace_id, lab) as m from fx_trace_calls c, grid
  where tool <> 'web_search'),
p as (select *, row_number() over (partition by trace_id, lab
  order by {sql_draw("wrong_argument", "j")}, j) as rn,
  ('0x' || substr({sql_draw("wrong_argument", "(step - 1) || '|sign'")}, 1, 1))::int % 2 as odd,
  ('0x' || substr({sql_draw("wrong_argument", "(step - 1) || '|token'")}, 1, 7))::bigint % 3 as tk
  from d),
h as (select * from p where rn <= greatest(1, round_even(severity * least(2, m), 0)::int)),
x as (select *, try_cast(split_part(arg1, ' ', 2 * tk::int + 1) as double)
  * (1.0::double + (0.05::double + 0.5::double * severity)
  * case when odd = 1 then 1.0::double else -1.0::double end) as moved from h),
y as (select *, regexp_replace(regexp_replace(printf('%.4f', moved), '0+$', ''), '\\.$', '') as shown
  from x),
z as (select *, case tool
  when 'lookup' then case when arg1 <> 'warehouse_b_capacity' then 'warehouse_b_capacity' end
  when 'unit_convert' then 'lb'
  when 'date_diff' then substr(arg2, 1, 8) || lpad(least(28, greatest(1, substr(arg2, 9)::int
    + case when odd = 1 then 5 else -3 end))::varchar, 2, '0')
  else case tk when 0 then shown || ' * 2.5 + ' || split_part(arg1, ' ', 5)
    when 1 then split_part(arg1, ' ', 1) || ' * ' || shown || ' + ' || split_part(arg1, ' ', 5)
    else split_part(arg1, ' ', 1) || ' * 2.5 + ' || shown end end as new_arg from y)
select trace_id, severity, string_agg(step || '=' || new_arg, ';' order by step) as changes
from z where new_arg <> case tool when 'date_diff' then arg2 when 'unit_convert' then arg2
  else arg1 end group by 1, 2""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    variants = traces.build_trace_variants(nested_traces(t), ["wrong_argument"])
    calls = trace_audit.explode_steps(
        variants.where("introduces_error").select(F.col("uid").alias("trace_id"), "steps")
    )
    before = trace_audit.explode_steps(nested_traces(t)).select(
        F.col("trace_id").alias("_t"), F.col("step").alias("_s"), F.col("args").alias("_old")
    )
    key = {"lookup": "key", "unit_convert": "frm", "date_diff": "d2", "calculator": "expr"}
    new = F.coalesce(
        *[F.when(F.col("tool") == k, trace_audit.argument(n)["text"]) for k, n in key.items()]
    )
    base = F.substring_index("trace_id", ":", 1)
    changed = calls.join(before, (base == F.col("_t")) & (F.col("step") == F.col("_s"))).where(
        F.to_json("args") != F.to_json("_old")
    )
    return (
        changed.select(
            base.alias("trace_id"),
            F.substring_index("trace_id", "@", -1).cast("double").alias("severity"),
            F.struct("step", F.concat_ws("=", F.col("step").cast("string"), new).alias("c")).alias("c"),
        )
        .groupBy("trace_id", "severity")
        .agg(F.array_join(F.array_sort(F.collect_list("c"))["c"], ";").alias("changes"))
    )


@query(
    "trace_variant_enumeration",
    f"""with {GRID_SQL}, n as (select trace_id, count(*) filter (tool <> 'web_search') as m
  from fx_trace_calls group by 1)
select d as requested, case when d = 'wrong_argument' and m = 0 then 'length_padding' else d end
  as degradation, severity, count(*) as n from n, grid,
  (select unnest(['length_padding', 'phantom_tool', 'wrong_argument', 'silent_failure']) as d)
group by all""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    variants = traces.build_trace_variants(nested_traces(t))
    return variants.groupBy("requested", "degradation", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "trace_profile",
    """with n as (select trace_id, count(*) as k from fx_trace_calls group by 1)
select count(*) as n_traces, round(avg(k), 2) as mean_steps, min(k)::int as min_steps,
  max(k)::int as max_steps, (select string_agg(distinct tool, ',' order by tool)
  from fx_trace_calls) as tools_used from n""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    return traces.profile_traces(nested_traces(t)).withColumn(
        "tools_used", F.array_join("tools_used", ",")
    )


@query("audit_detection_by_defect")
def _(t: Inputs) -> DataFrame:
    variants = traces.build_trace_variants(nested_traces(t))
    damaged = variants.select(
        F.col("uid").alias("trace_id"),
        "task",
        "steps",
        "final_answer",
        F.lit(None).cast("string").alias("expected_final_answer"),
    ).dropDuplicates(["trace_id"])
    unique = variants.dropDuplicates(["uid"])
    return rounded(trace_audit.detection_by_degradation(unique, trace_audit.audit(damaged)))


def trace_payloads(t: Inputs, note: Column, task: Column | None = None, argument: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Traces as JSON payloads; ``note`` is a field that no payload should have (null: it has none)."""
    steps = F.transform(
        "steps",
        lambda s: F.struct(
            s["tool"],
            F.map_from_entries(F.transform(s["args"], lambda a: F.struct(a["name"], argument(a["text"])))).alias("args"),
            s["result"],
        ),
    )
    doc = F.struct(
        (F.col("task") if task is None else task).alias("task"),
        steps.alias("steps"),
        "final_answer",
        "expected_final_answer",
        note.alias("note"),
    )
    return nested_traces(t).select("trace_id", F.to_json(doc).alias("payload"))


@query(
    "trace_payload_validation",
    """with c as (select trace_id, count(*) as n from fx_trace_calls group by 1)
select trace_id, case when trace_id::int % 11 = 4 then 'unknown field'
  when trace_id::int % 7 = 2 then 'task length'
  when trace_id::int % 13 = 3 then 'argument bounds' end as reject_reason, n::int as n_steps from c""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    number = F.col("trace_id").cast("int")
    payloads = trace_payloads(
        t,
        note=F.when(number % 11 == 4, "surplus"),
        task=F.when(number % 7 == 2, F.repeat(F.lit("t"), 4001)).otherwise(F.col("task")),
        argument=lambda text: F.when(number % 13 == 3, F.repeat(F.lit("x"), 600)).otherwise(text),
    )
    checked = trace_audit.validate_traces(payloads)
    return checked.select("trace_id", "reject_reason", F.size("steps").alias("n_steps"))
