"""Agent traces as nested rows: rendering, and copies damaged in a recorded way.

A trace is one row with trace_id, task, final_answer and
``steps array<struct<tool, args array<struct<name, text, number>>, result, reasoning>>``.
A step list is short by contract, so every kind of damage is a row-local expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.draws import at_least_one, draw, pick_indexes, shuffled
from plumbline.functions.printing import fixed4, short4

SEED = 20260731
SEVERITIES = (0.2, 0.5, 0.9)
ARGS_TYPE = "array<struct<name:string,text:string,number:boolean>>"
STEPS_TYPE = f"array<struct<tool:string,args:{ARGS_TYPE},result:string,reasoning:string>>"

# Undeclared tools, harmless extra steps, and the argument swaps.
PHANTOM_TOOLS = ["web_search", "sql_query", "currency_api", "weather_lookup", "geocode"]
REDUNDANT_STEPS = [
    (
        "lookup",
        "key",
        "handling_fee_usd",
        "412",
        "Retrieved for completeness; not used downstream.",
    ),
    (
        "lookup",
        "key",
        "insurance_pct",
        "1.8",
        "Retrieved for context; does not affect the result.",
    ),
    ("calculator", "expr", "1 * 1", "1", "Sanity check of the arithmetic backend."),
    (
        "lookup",
        "key",
        "customs_flat_usd",
        "265",
        "Noted for the record; not part of this calculation.",
    ),
]
DECLARED_TOOLS = ("calculator", "unit_convert", "date_diff", "lookup")
UNIT_SWAPS = {"kg": "lb", "lb": "kg", "usd": "eur", "eur": "usd", "km": "mi", "mi": "km"}
KEY_SWAP = ("warehouse_b_capacity", "warehouse_c_capacity")
PHANTOM_RESULT = "(result returned)"
PHANTOM_REASON = "Consulted an external source for supporting context."
UNAVAILABLE = "(unavailable)"
CARRIED_FORWARD = " Value carried forward."
QUERY_LENGTH = 48


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes unless it holds one and no double quote."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single, double = F.instr(text, "'") > 0, F.instr(text, '"') > 0
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def render_steps(steps: Column) -> Column:
    def line(step: Column, i: Column) -> Column:
        args = F.array_join(
            F.transform(
                step["args"],
                lambda a: F.concat(
                    a["name"], F.lit("="), F.when(a["number"], a["text"]).otherwise(quoted(a["text"]))
                ),
            ),
            ", ",
        )
        call = F.concat(
            F.lit("STEP "), (i + 1).cast("string"), F.lit(": call "), step["tool"], F.lit("("), args,
            F.lit(") -> "), step["result"],
        )
        why = F.coalesce(step["reasoning"], F.lit(""))
        return F.when(why != "", F.concat(call, F.lit("\n        rationale: "), why)).otherwise(call)

    return F.array_join(F.transform(steps, line), "\n")


def render(task: Column, steps: Column, answer: Column) -> Column:
    """A trace as text: task, numbered calls with their results and reasons, final answer."""
    body = F.when(F.size(steps) > 0, F.concat(render_steps(steps), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("TASK: "), task, F.lit("\n"), body, F.lit("FINAL ANSWER: "), answer)


def render_trace(traces: DataFrame) -> DataFrame:
    return traces.withColumn("text", render(F.col("task"), F.col("steps"), F.col("final_answer")))


def _identity(kind: str, seed: int) -> tuple:
    return (F.col("trace_id"), kind, F.col("severity_label"), seed)


def _step(tool: Column, name: str, value: Column, result: str, why: str) -> Column:
    return F.struct(
        tool.alias("tool"),
        F.array(
            F.struct(
                F.lit(name).alias("name"), value.alias("text"), F.lit(False).alias("number")
            )
        ).alias("args"),
        F.lit(result).alias("result"),
        F.lit(why).alias("reasoning"),
    )


def _inserted(extra: Column, last: Column, *identity) -> Column:
    """The steps with extra ones put in at drawn places between 0 and ``last``.

    An extra step drawn to place p goes in front of the original step p; extra steps of one place
    keep their order.
    """
    steps = F.col("steps")
    placed = F.transform(
        extra,
        lambda e, i: F.struct(
            (
                F.conv(F.substring(draw(*identity, "place", i), 1, 7), 16, 10).cast("int") % (last + 1)
            ).alias("place"),
            F.lit(0).alias("original"),
            i.alias("order"),
            e.alias("step"),
        ),
    )
    originals = F.transform(
        steps,
        lambda s, i: F.struct(
            i.alias("place"), F.lit(1).alias("original"), F.lit(0).alias("order"), s.alias("step")
        ),
    )
    return F.transform(
        F.array_sort(
            F.concat(placed, originals),
            lambda a, b: F.when(a["place"] != b["place"], a["place"] - b["place"])
            .when(a["original"] != b["original"], a["original"] - b["original"])
            .otherwise(a["order"] - b["order"]),
        ),
        lambda p: p["step"],
    )


def _padding_steps(seed: int) -> Column:
    extras = F.array(
        *[_step(F.lit(t), n, F.lit(v), r, why) for t, n, v, r, why in REDUNDANT_STEPS]
    ).cast(STEPS_TYPE)
    k = F.least(at_least_one(F.col("severity") * 4), F.lit(len(REDUNDANT_STEPS)))
    tagged = shuffled(F.sequence(F.lit(0), F.lit(len(REDUNDANT_STEPS) - 1)), *_identity("length_padding", seed))
    return F.transform(F.slice(tagged, 1, k), lambda i: F.get(extras, i))


def length_padding(seed: int) -> Column:
    """The probe: harmless extra steps, same correct answer."""
    return _inserted(
        F.col("padding_steps"), F.size("steps"), *_identity("length_padding", seed)
    )


def _phantom_steps(seed: int) -> Column:
    names = F.array(*[F.lit(n) for n in PHANTOM_TOOLS])
    k = F.least(at_least_one(F.col("severity") * 2), F.lit(len(PHANTOM_TOOLS)))
    picked = F.slice(shuffled(names, *_identity("phantom_tool", seed)), 1, k)
    query = F.substring(F.col("task"), 1, QUERY_LENGTH)
    return F.transform(
        picked, lambda n: _step(n, "query", query, PHANTOM_RESULT, PHANTOM_REASON)
    ).cast(STEPS_TYPE)


def phantom_tool(seed: int) -> Column:
    """Calls to tools that were never declared, in front of the last step at the latest."""
    return _inserted(
        F.col("phantom_steps"),
        F.greatest(F.size("steps") - 1, F.lit(0)),
        *_identity("phantom_tool", seed),
    )


def _is_number(token: Column) -> Column:
    return token.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def _changed_expression(expr: Column, *identity) -> Column:
    """One drawn number token moved by a share that grows with severity; text without one stays."""
    tokens = F.split(F.regexp_replace(expr, r"^\s+|\s+$", ""), r"\s+")
    at = F.filter(
        F.transform(tokens, lambda t, j: F.when(_is_number(t), j)), lambda j: j.isNotNull()
    )
    pick = F.get(
        at, F.conv(F.substring(draw(*identity, "token"), 1, 7), 16, 10).cast("int") % F.size(at)
    )
    odd = F.conv(F.substring(draw(*identity, "sign"), 1, 1), 16, 10).cast("int") % 2
    share = (F.lit(0.05) + F.lit(0.5) * F.col("severity")) * F.when(odd == 1, 1.0).otherwise(-1.0)
    moved = F.transform(
        tokens,
        lambda t, j: F.when(j == pick, short4(t.try_cast("double") * (F.lit(1.0) + share))).otherwise(t),
    )
    return F.when(F.size(at) > 0, F.array_join(moved, " ")).otherwise(expr)


def _changed_date(text: Column, *identity) -> Column:
    """Three days back or five forward inside the month, between the 1st and the 28th."""
    parts = F.split(text, "-")
    odd = F.conv(F.substring(draw(*identity, "sign"), 1, 1), 16, 10).cast("int") % 2
    day = F.get(parts, F.lit(2)).try_cast("int") + F.when(odd == 1, 5).otherwise(-3)
    kept = F.least(F.lit(28), F.greatest(F.lit(1), day))
    return F.coalesce(
        F.concat_ws(
            "-", F.lpad(F.get(parts, F.lit(0)), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"),
            F.lpad(kept.cast("string"), 2, "0"),
        ),
        text,
    )


def _mapped(text: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(text == key, value).otherwise(out)
    return out


def _wrong_args(step: Column, *identity) -> Column:
    tool = step["tool"]

    def change(arg: Column) -> Column:
        name, text = arg["name"], arg["text"]
        new = (
            F.when((tool == "calculator") & (name == "expr"), _changed_expression(text, *identity))
            .when((tool == "unit_convert") & (name == "frm"), _mapped(text, UNIT_SWAPS, "lb"))
            .when((tool == "date_diff") & (name == "d2"), _changed_date(text, *identity))
            .when(
                (tool == "lookup") & (name == "key"),
                F.when(text != KEY_SWAP[0], KEY_SWAP[0]).otherwise(KEY_SWAP[1]),
            )
            .otherwise(text)
        )
        return arg.withField("text", new)

    return step.withField("args", F.transform(step["args"], change))


def _argument_targets(seed: int) -> Column:
    declared = F.filter(
        F.sequence(F.lit(0), F.size("steps") - 1),
        lambda i: F.get(F.col("steps"), i)["tool"].isin(*DECLARED_TOOLS),
    )
    k = at_least_one(F.col("severity") * F.least(F.lit(2), F.size(declared)))
    return F.array_sort(F.slice(shuffled(declared, *_identity("wrong_argument", seed)), 1, k))


def wrong_argument(seed: int) -> Column:
    """A right tool called with a wrong argument; its recorded result stays as it was.

    A trace without a declared tool is padded instead, as in ``length_padding``.
    """
    identity, chosen = _identity("wrong_argument", seed), F.col("argument_targets")
    changed = F.transform(
        F.col("steps"),
        lambda s, i: F.when(F.array_contains(chosen, i), _wrong_args(s, *identity, i)).otherwise(s),
    )
    return F.when(F.size(chosen) > 0, changed).otherwise(length_padding(seed))


def _failure_targets(seed: int) -> Column:
    n = F.size("steps")
    k = at_least_one(F.col("severity") * F.least(F.lit(2), n))
    return pick_indexes(n, k, *_identity("silent_failure", seed))


def silent_failure(seed: int) -> Column:
    """Intermediate results corrupted while the final answer stays right."""
    chosen = F.col("failure_targets")
    factor = F.lit(1.0) + (F.lit(0.1) + F.lit(0.6) * F.col("severity"))

    def corrupt(step: Column) -> Column:
        value = F.when(_is_number(F.trim(step["result"])), F.trim(step["result"])).try_cast("double")
        result = F.coalesce(short4(value * factor), F.lit(UNAVAILABLE))
        why = F.concat(F.coalesce(step["reasoning"], F.lit("")), F.lit(CARRIED_FORWARD))
        return step.withField("result", result).withField("reasoning", why)

    return F.transform(
        F.col("steps"),
        lambda s, i: F.when(F.array_contains(chosen, i), corrupt(s)).otherwise(s),
    )


@dataclass(frozen=True)
class TraceDegradation:
    """Damage to a trace: the columns it draws, and the step list it leaves."""

    build: Callable[[int], Column]
    draws: tuple[tuple[str, Callable[[int], Column]], ...]
    introduces_error: bool = True


PADDING_DRAWS = ("padding_steps", _padding_steps)
TRACE_DEGRADATIONS: dict[str, TraceDegradation] = {
    "length_padding": TraceDegradation(length_padding, (PADDING_DRAWS,), introduces_error=False),
    "phantom_tool": TraceDegradation(phantom_tool, (("phantom_steps", _phantom_steps),)),
    "wrong_argument": TraceDegradation(
        wrong_argument, (("argument_targets", _argument_targets), PADDING_DRAWS)
    ),
    "silent_failure": TraceDegradation(silent_failure, (("failure_targets", _failure_targets),)),
}


def build_trace_variants(
    traces: DataFrame,
    degradations: Sequence[str] | None = None,
    severities: Sequence[float] = SEVERITIES,
    seed: int = SEED,
) -> DataFrame:
    """Every trace x kind of damage x severity, with its step list, length ratio and audit note."""
    kinds = list(degradations or TRACE_DEGRADATIONS)
    grid = F.array(
        *[
            F.struct(F.lit(float(s)).alias("severity"), F.lit(f"{s:g}").alias("severity_label"))
            for s in severities
        ]
    )
    base = traces.select(
        "trace_id", "task", F.col("steps").cast(STEPS_TYPE).alias("steps"), "final_answer"
    )
    cells = base.select("*", F.explode(grid).alias("g")).select(*base.columns, "g.*")
    drawn = {n: make(seed) for k in kinds for n, make in TRACE_DEGRADATIONS[k].draws}
    cells = cells.withColumns(drawn)
    no_tool = (
        F.size("argument_targets") == 0 if "argument_targets" in drawn else F.lit(False)
    )

    def entry(kind: str) -> Column:
        falls_back = no_tool if kind == "wrong_argument" else F.lit(False)
        error = TRACE_DEGRADATIONS[kind].introduces_error
        return F.struct(
            F.lit(kind).alias("requested"),
            F.when(falls_back, "length_padding").otherwise(kind).alias("degradation"),
            TRACE_DEGRADATIONS[kind].build(seed).alias("new_steps"),
            F.when(falls_back, False).otherwise(error).alias("introduces_error"),
        )

    built = cells.select(
        *base.columns,
        "severity",
        "severity_label",
        F.explode(F.array(*[entry(k) for k in kinds])).alias("v"),
    )
    before = render(F.col("task"), F.col("steps"), F.col("final_answer"))
    after = render(F.col("task"), F.col("v.new_steps"), F.col("final_answer"))
    variant_id = F.concat_ws("@", F.col("v.degradation"), F.col("severity_label"))
    added = F.size("v.new_steps") - F.size("steps")
    touched = F.size(
        F.filter(
            F.arrays_zip(F.col("steps").alias("old"), F.col("v.new_steps").alias("new")),
            lambda z: F.coalesce(z["old"] != z["new"], F.lit(True)),
        )
    )
    edit = F.when(
        added > 0, F.concat(F.lit("Steps inserted, the answer is unchanged: "), added.cast("string"))
    ).otherwise(
        F.concat(F.lit("Steps altered, the answer is unchanged: "), touched.cast("string"))
    )
    return built.select(
        "trace_id",
        variant_id.alias("variant_id"),
        F.concat_ws(":", F.col("trace_id"), variant_id).alias("uid"),
        "v.requested",
        "v.degradation",
        "severity",
        "task",
        F.col("v.new_steps").alias("steps"),
        "final_answer",
        edit.alias("edit"),
        "v.introduces_error",
        fixed4(F.length(after) / F.greatest(F.length(before), F.lit(1))).cast("double").alias("len_ratio"),
    )


def profile_traces(traces: DataFrame) -> DataFrame:
    """Number of traces, steps per trace and the tools they use."""
    sizes = F.size("steps")
    counted = traces.agg(
        F.count(F.lit(1)).alias("n_traces"),
        F.round(F.avg(sizes), 2).alias("mean_steps"),
        F.min(sizes).alias("min_steps"),
        F.max(sizes).alias("max_steps"),
    )
    tools = (
        traces.select(F.explode("steps.tool").alias("tool"))
        .distinct()
        .agg(F.array_sort(F.collect_list("tool")).alias("tools_used"))
    )
    return counted.withColumn("tools_used", tools.scalar())
