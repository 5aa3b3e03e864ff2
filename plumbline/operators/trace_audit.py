"""Deterministic replay of recorded tool calls.

A trace is checked call by call against pure tools: table lookup, unit conversion, date difference
and arithmetic. Nothing recorded is executed. Lookup and conversion tables are small fixed
dimensions; traces are exploded to calls once and rolled up in one shuffle by trace.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.printing import short4
from plumbline.operators.arithmetic import replay_arithmetic

# The lookup table, conversion factors and size bounds of a trace.
LOOKUP_TABLE = {
    "warehouse_a_capacity": "4200",
    "warehouse_b_capacity": "6150",
    "warehouse_c_capacity": "2875",
    "demurrage_rate_usd_per_day": "38.5",
    "handling_fee_usd": "412",
    "pallet_weight_kg": "27.5",
    "container_teu_weight_kg": "21600",
    "fuel_price_usd_per_litre": "1.42",
    "fleet_size": "58",
    "avg_route_km": "312",
    "consumption_l_per_100km": "28.4",
    "carbon_kg_per_litre": "2.68",
    "labour_rate_usd_per_hour": "31.75",
    "shift_hours": "8",
    "defect_rate_ppm": "740",
    "batch_size": "12500",
    "rework_cost_usd_per_unit": "6.4",
    "storage_usd_per_pallet_day": "2.15",
    "insurance_pct": "1.8",
    "customs_flat_usd": "265",
}
CONVERSION_FACTORS = [
    ("kg", "lb", 2.2046226218),
    ("lb", "kg", 0.45359237),
    ("km", "mi", 0.6213711922),
    ("mi", "km", 1.609344),
    ("l", "gal", 0.2641720524),
    ("gal", "l", 3.785411784),
    ("usd", "eur", 0.92),
    ("eur", "usd", 1.0869565217),
    ("t", "kg", 1000.0),
    ("kg", "t", 0.001),
    ("h", "min", 60.0),
    ("min", "h", 1 / 60.0),
]
MAX_STEPS, MAX_ARGS, MAX_NAME, MAX_ARG_TEXT = 40, 8, 80, 512
MAX_RESULT, MAX_TEXT, MAX_MAGNITUDE, MAX_PAYLOAD = 2000, 4000, 1e12, 100_000

NUMBER = r"^\s*[+-]?((\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?)\s*$"
DATE = r"^(?!0000)\d{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def to_number(text: Column) -> Column:
    """A plain decimal or scientific number, else null."""
    return F.when(text.rlike(NUMBER), F.replace(_trimmed(text), F.lit("_"), F.lit(""))).try_cast(
        "double"
    )


def validate_traces(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Parses trace payloads and says why a trace is rejected; ``reject_reason`` is null if valid.

    Unknown fields, missing fields and wrong types reject a trace, as do the size bounds.
    """
    raw = payloads.withColumn("_v", F.try_parse_json(F.col(payload)))
    top = "map<string,variant>"
    doc = raw.withColumn("_doc", F.expr(f"try_cast(_v as {top})")).withColumn(
        "_raw_steps", F.expr("try_variant_get(_v, '$.steps', 'array<map<string,variant>>')")
    )

    def text_of(path: str) -> Column:
        return F.expr(f"try_variant_get(_v, '$.{path}', 'string')")

    def kind_of(path: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(_v, '$.{path}', 'variant'))")

    steps = F.expr(
        """transform(_raw_steps, s -> named_struct(
            'tool', try_variant_get(s['tool'], '$', 'string'),
            'args', transform(map_entries(try_cast(s['args'] as map<string,variant>)), e ->
                named_struct('name', e.key, 'text', try_variant_get(e.value, '$', 'string'),
                    'number', schema_of_variant(e.value) <> 'STRING')),
            'result', try_variant_get(s['result'], '$', 'string'),
            'reasoning', ''))"""
    )
    bad_step = F.expr(
        f"""exists(_raw_steps, s -> s is null
            or size(array_except(map_keys(s), array('tool', 'args', 'result'))) > 0
            or coalesce(schema_of_variant(s['tool']) <> 'STRING', true)
            or coalesce(schema_of_variant(s['result']) <> 'STRING', true)
            or try_cast(s['args'] as map<string,variant>) is null)"""
    )
    bad_size = F.exists(
        "steps",
        lambda s: (F.length(s["tool"]) < 1)
        | (F.length(s["tool"]) > MAX_NAME)
        | (F.length(s["result"]) > MAX_RESULT)
        | (F.size(s["args"]) > MAX_ARGS),
    )
    bad_type = F.expr(
        """exists(_raw_steps, s -> exists(map_values(try_cast(s['args'] as map<string,variant>)),
            v -> not (schema_of_variant(v) rlike '^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$')))"""
    )
    bad_arg = F.exists(
        "steps",
        lambda s: F.exists(
            s["args"],
            lambda a: (F.length(a["name"]) > MAX_NAME)
            | (~a["number"] & (F.length(a["text"]) > MAX_ARG_TEXT))
            | (a["number"] & (F.abs(a["text"].try_cast("double")) > MAX_MAGNITUDE)),
        ),
    )
    allowed = F.array(*[F.lit(c) for c in ("task", "steps", "final_answer", "expected_final_answer")])
    parsed = doc.withColumns(
        {
            "task": text_of("task"),
            "steps": steps,
            "final_answer": text_of("final_answer"),
            "expected_final_answer": text_of("expected_final_answer"),
            "_expected_kind": kind_of("expected_final_answer"),
        }
    )
    no = F.lit(False)
    reason = (
        F.when(F.length(payload) > MAX_PAYLOAD, "payload too long")
        .when(F.col("_doc").isNull(), "not an object")
        .when(F.size(F.array_except(F.map_keys("_doc"), allowed)) > 0, "unknown field")
        .when(F.coalesce(kind_of("task") != "STRING", F.lit(True)), "task missing or not text")
        .when(
            F.coalesce(kind_of("final_answer") != "STRING", F.lit(True)),
            "final answer missing or not text",
        )
        .when(
            ~F.coalesce(F.col("_expected_kind"), F.lit("VOID")).isin("STRING", "VOID"),
            "expected answer not text",
        )
        .when((F.length("task") < 1) | (F.length("task") > MAX_TEXT), "task length")
        .when(F.length("final_answer") > MAX_TEXT, "final answer length")
        .when(F.coalesce(F.length("expected_final_answer") > MAX_TEXT, no), "expected answer length")
        .when(F.col("_raw_steps").isNull(), "steps missing or malformed")
        .when((F.size("_raw_steps") < 1) | (F.size("_raw_steps") > MAX_STEPS), "number of steps")
        .when(F.coalesce(bad_step, F.lit(True)), "malformed step")
        .when(F.coalesce(bad_size, no), "step bounds")
        .when(F.coalesce(bad_type, no), "argument not a scalar")
        .when(F.coalesce(bad_arg, no), "argument bounds")
    )
    return parsed.withColumn("reject_reason", reason).drop(
        "_v", "_doc", "_raw_steps", "_expected_kind"
    )


def explode_steps(traces: DataFrame) -> DataFrame:
    """One row per call with its 1-based step number and its arguments sorted by name."""
    calls = traces.select("trace_id", F.posexplode("steps").alias("at", "s"))
    return calls.select(
        "trace_id",
        (F.col("at") + 1).alias("step"),
        F.col("s.tool").alias("tool"),
        F.array_sort("s.args").alias("args"),
        F.col("s.result").alias("recorded"),
    )


def argument(name: str) -> Column:
    """An argument of the call by name: its text, or null."""
    return F.get(F.filter("args", lambda a: a["name"] == name), F.lit(0))


def _named_exactly(*names: str) -> Column:
    wanted = F.array(*[F.lit(n) for n in sorted(names)])
    return F.transform("args", lambda a: a["name"]) == wanted


def _is_text(*names: str) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & ~argument(name)["number"]
    return ok


def lookup_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOOKUP_TABLE.items()), "key string, value string")


def conversion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSION_FACTORS, "frm string, to string, factor double")


def _looked_up(calls: DataFrame, keys: list[str], table: DataFrame, small: bool) -> DataFrame:
    """Calls with the table's row for their keys.

    A built-in table is broadcast. With a caller's table, which may be of any size, calls without all keys (those of other tools)
    bypass the join, so no null key is shuffled, and the table is first cut to the keys that are asked for.
    """
    if small:
        return calls.join(F.broadcast(table), keys, "left")
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    asked = calls.where(whole)
    wanted = table.join(asked.select(*keys).distinct(), keys, "left_semi")
    found = asked.join(wanted, keys, "left")
    values = {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in keys}
    return found.unionByName(calls.where(~whole).withColumns(values))


def replay_lookup(calls: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Value of the key in a reference table; the built-in one has 20 rows."""
    values = lookup_table(calls.sparkSession) if table is None else table
    named = values.select(F.col("key").alias("_key"), F.col("value").alias("replayed"))
    key = F.when(_named_exactly("key") & _is_text("key"), argument("key")["text"])
    return _looked_up(calls.withColumn("_key", key), ["_key"], named, table is None).drop("_key")


def replay_convert(calls: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Unit conversion with four decimals, units in any case; the built-in table has 12 rows."""
    table = conversion_table(calls.sparkSession) if factors is None else factors
    named = table.withColumnsRenamed({"frm": "_frm", "to": "_to", "factor": "_factor"})
    right = _named_exactly("value", "frm", "to")
    value = F.when(argument("value")["number"], argument("value")["text"].try_cast("double"))
    keyed = (
        calls.withColumn("_frm", F.when(right, F.lower(argument("frm")["text"])))
        .withColumn("_to", F.when(right, F.lower(argument("to")["text"])))
        .withColumn("_x", F.coalesce(value, to_number(argument("value")["text"])))
    )
    return (
        _looked_up(keyed, ["_frm", "_to"], named, factors is None)
        .withColumn("_out", F.col("_x") * F.col("_factor"))
        .withColumn(
            "replayed",
            F.when(F.abs("_out") < float("inf"), short4(F.col("_out"))),
        )
        .drop("_frm", "_to", "_x", "_factor", "_out")
    )


def replay_date_diff(calls: DataFrame) -> DataFrame:
    """Whole days from d1 to d2; a date that does not exist is invalid."""

    def day(name: str) -> Column:
        text = F.when(argument(name)["text"].rlike(DATE), F.replace(argument(name)["text"], F.lit(" "), F.lit("")))
        return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")

    right = _named_exactly("d1", "d2") & _is_text("d1", "d2")
    days = F.when(right, F.date_diff(day("d2"), day("d1")))
    return calls.withColumn("replayed", days.cast("string"))


def replay_calculator(calls: DataFrame) -> DataFrame:
    """Value of the arithmetic expression."""
    right = _named_exactly("expr") & _is_text("expr")
    return calls.withColumn(
        "replayed", replay_arithmetic(F.when(right, argument("expr")["text"]))
    )


# Tools by name; a caller may pass a wider table to ``step_status``.
TOOLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "calculator": replay_calculator,
    "lookup": replay_lookup,
    "date_diff": replay_date_diff,
    "unit_convert": replay_convert,
}


def step_status(
    calls: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """Replays every call with its tool and compares: unsupported_tool, invalid_call,
    result_mismatch or passed."""
    tools = TOOLS if tools is None else tools
    known = F.col("tool").isin(*tools)
    out = calls
    parts = []
    for name, replay in tools.items():
        column = f"_r_{len(parts)}"
        mine = F.when(F.col("tool") == name, F.col("_kept_args"))
        narrowed = out.withColumnRenamed("args", "_kept_args").withColumn("args", mine)
        out = (
            replay(narrowed)
            .drop("args")
            .withColumnsRenamed({"_kept_args": "args", "replayed": column})
        )
        parts.append(F.when(F.col("tool") == name, F.col(column)))
    replayed = F.coalesce(*parts)
    scored = out.withColumn("replayed", replayed).drop(*[f"_r_{i}" for i in range(len(parts))])
    same = _trimmed(F.col("replayed")) == _trimmed(F.col("recorded"))
    status = (
        F.when(~known, "unsupported_tool")
        .when(F.col("replayed").isNull(), "invalid_call")
        .when(~F.coalesce(same, F.lit(False)), "result_mismatch")
        .otherwise("passed")
    )
    return scored.withColumn("status", status)


def with_repeats(traces: DataFrame) -> DataFrame:
    """Adds ``repeats``, the numbers of steps that make an earlier call of the trace again.

    A step list has at most 40 entries, so it is compared inside its row.
    """
    calls = F.transform(
        "steps", lambda s: F.struct(s["tool"].alias("tool"), F.array_sort(s["args"]).alias("args"))
    )
    signed = traces.withColumn("_calls", calls)
    seen = F.filter(
        F.transform(
            "_calls",
            lambda c, i: F.when(F.exists(F.slice("_calls", F.lit(1), i), lambda e: e == c), i + 1),
        ),
        lambda i: i.isNotNull(),
    )
    return signed.withColumn("repeats", seen).drop("_calls")


def audit(
    traces: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """One verdict per trace: failed, passed, or consistent when no expected answer is given."""
    checked = step_status(explode_steps(traces), tools)
    rolled = checked.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("steps_checked"),
        F.count_if(F.col("status") != "passed").alias("step_failures"),
        F.array_sort(
            F.collect_list(F.struct("step", "tool", "recorded", "replayed", "status"))
        ).alias("checked"),
    )
    outcome = _trimmed(F.col("final_answer")) == _trimmed(F.col("expected_final_answer"))
    heads = with_repeats(traces).select(
        "trace_id", outcome.alias("answer_matches_expected"), "repeats"
    )
    failed = (F.col("step_failures") > 0) | ~F.coalesce("answer_matches_expected", F.lit(True))
    return rolled.join(heads, "trace_id").withColumn(
        "status",
        F.when(failed, "failed")
        .when(F.col("answer_matches_expected"), "passed")
        .otherwise("consistent"),
    )


def audit_report(checked: DataFrame) -> DataFrame:
    """Calls by tool and status, with totals per tool, per status and over all."""
    return (
        checked.cube("tool", "status")
        .agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("calls"))
        .select(
            F.when(F.col("_set").isin(2, 3), "(all)").otherwise(F.col("tool")).alias("tool"),
            F.when(F.col("_set").isin(1, 3), "(all)").otherwise(F.col("status")).alias("status"),
            "calls",
        )
    )


def detection_by_degradation(variants: DataFrame, audits: DataFrame) -> DataFrame:
    """Share of damaged traces the audit fails, per kind of damage; ids in both are variant uids."""
    joined = variants.select(F.col("uid").alias("trace_id"), "degradation").join(audits, "trace_id")
    return joined.groupBy("degradation").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("status") == "failed", 1.0).otherwise(0.0)).alias("detection_rate"),
    )


