"""SQL functions for sessions that prefer SQL text, as plain SQL expressions the optimiser sees."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.functions.extraction import (
    REASONING_CLOSED,
    REASONING_OPEN,
    SCORE_FORMATS,
    VERDICT_FORMATS,
)
from plumbline.functions.intervals import z_value
from plumbline.operators.consistency import BANDS, LOWEST_BAND
from plumbline.operators.traces import ARGS_TYPE, STEPS_TYPE


def _cleaned(argument: str) -> str:
    closed = f"regexp_replace({argument}, r'{REASONING_CLOSED}', '')"
    opened = f"regexp_replace({closed}, r'{REASONING_OPEN}', '')"
    return f"regexp_replace({opened}, r'^\\s+|\\s+$', '')"


def register(spark: SparkSession) -> list[str]:
    """Registers judge_score, judge_verdict, score_band, wilson_low, wilson_high and flag_kappa, and the table functions
    trace_calls (the calls of a step list) and both_orders (a pair in both display orders), for use after ``lateral``.

    flag_kappa is Cohen's kappa of two flags from four counts that aggregate before the shuffle: rows, first flags, second flags, equal
    ones. All are SQL expressions, so the optimiser sees through them.
    """
    text = _cleaned("t")
    scores = ", ".join(
        f"get(filter(transform(regexp_extract_all({text}, r'{p}', 1), s -> cast(s as double)), "
        "v -> v >= 1 - 1e-9D and v <= 10 + 1e-9D), 0)"
        for p in SCORE_FORMATS
    )
    hits = ", ".join(f"nullif(regexp_extract({text}, r'{p}', 1), '')" for p in VERDICT_FORMATS)
    bands = " ".join(f"when s >= {edge} then '{name}'" for edge, name in BANDS)
    z = repr(z_value())
    share, total = "(k / cast(n as double))", "cast(n as double)"
    spread = (
        f"{z}D * sqrt({share} * (1 - {share}) / {total} + {z}D * {z}D / (4 * {total} * {total}))"
    )
    centre = f"({share} + {z}D * {z}D / (2 * {total}))"
    bottom = f"(1 + {z}D * {z}D / {total})"
    definitions = {
        "judge_score(t string) returns double": f"coalesce({scores})",
        "judge_verdict(t string) returns string": (
            f"case upper(coalesce({hits})) when 'TIE' then 'tie' else upper(coalesce({hits})) end"
        ),
        "score_band(s double) returns string": (
            f"case when s is null then null {bands} else '{LOWEST_BAND}' end"
        ),
        "wilson_low(k bigint, n bigint) returns double": (
            f"case when n > 0 then greatest(0D, ({centre} - {spread}) / {bottom}) end"
        ),
        "wilson_high(k bigint, n bigint) returns double": (
            f"case when n > 0 then least(1D, ({centre} + {spread}) / {bottom}) end"
        ),
    }
    chance = "(a / cast(n as double) * b / n + (1 - a / cast(n as double)) * (1 - b / cast(n as double)))"
    definitions["flag_kappa(n bigint, a bigint, b bigint, same bigint) returns double"] = (
        f"case when n > 0 and {chance} < 1 then (same / cast(n as double) - {chance}) / (1 - {chance}) end"
    )
    definitions[
        f"trace_calls(steps {STEPS_TYPE}) returns table (step int, tool string, args {ARGS_TYPE}, recorded string)"
    ] = "select at + 1, s.tool, array_sort(s.args), s.result from (select posexplode(trace_calls.steps) as (at, s))"
    definitions[
        "both_orders(reference string, degraded string) returns table (reference_first boolean, option_a string, option_b string)"
    ] = (
        "select first, if(first, both_orders.reference, both_orders.degraded), if(first, both_orders.degraded, both_orders.reference) "
        "from (select explode(array(true, false)) as first)"
    )
    for signature, body in definitions.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    return [s.split("(")[0] for s in definitions]
