"""Pairwise verdicts asked in both display orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators.discrimination import level_name, share


def both_orders(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: the reference shown first, then the damaged copy shown first."""
    fanned = pairs.withColumn("reference_first", F.explode(F.array(F.lit(True), F.lit(False))))
    return fanned.withColumn(
        "option_a", F.when(F.col("reference_first"), F.col("reference")).otherwise(F.col("degraded"))
    ).withColumn(
        "option_b", F.when(F.col("reference_first"), F.col("degraded")).otherwise(F.col("reference"))
    )


SIDES = {1: "REF", 2: "DEG", 3: "tie"}


def side_code(verdict: Column, reference_first: Column) -> Column:
    """Which side an A/B/tie verdict favours, as a small number: numbers aggregate without sorting."""
    return (
        F.when(verdict == "A", F.when(reference_first, 1).otherwise(2))
        .when(verdict == "B", F.when(reference_first, 2).otherwise(1))
        .when(verdict == "tie", 3)
    )


def side_name(code: Column) -> Column:
    name = F.lit(None).cast("string")
    for key, text in SIDES.items():
        name = F.when(code == key, text).otherwise(name)
    return name


def coin_is_first(*identity: Column) -> Column:
    """A repeatable coin: the parity of the SHA-256 of the identity joined by '|'."""
    digest = F.sha2(F.concat_ws("|", *[c.cast("string") for c in identity]), 256)
    return F.substring(digest, -1, 1).isin("0", "2", "4", "6", "8", "a", "c", "e")


def resolve_swaps(
    answers: DataFrame, carry: tuple[str, ...] = ("degradation", "severity")
) -> DataFrame:
    """One row per comparison from its two ordered answers, in a single shuffle.

    ``answers`` has uid, judge, config, replicate, reference_first, verdict (A, B, tie or null),
    tokens, latency_ms and cost_usd. ``carry`` names attributes of the comparison, equal in both rows.
    """
    code = side_code(F.col("verdict"), F.col("reference_first"))
    merged = (
        answers.groupBy("uid", "judge", "config", "replicate", *carry)
        .agg(
            F.max(F.when(F.col("reference_first"), code)).alias("_forward"),
            F.max(F.when(~F.col("reference_first"), code)).alias("_reverse"),
            F.sum("latency_ms").alias("latency_ms"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("tokens").alias("tokens"),
        )
        .withColumn("forward", side_name(F.col("_forward")))
        .withColumn("reverse", side_name(F.col("_reverse")))
    )
    forward, reverse = F.col("forward"), F.col("reverse")
    consistent = F.coalesce(forward == reverse, F.lit(False))
    single = F.when(
        coin_is_first(F.col("uid"), F.col("judge"), F.col("config"), F.col("replicate")), forward
    ).otherwise(reverse)

    def is_reference(side: Column) -> Column:
        return F.coalesce((side == "REF").cast("int"), F.lit(0))

    return merged.select(
        "uid",
        "judge",
        "config",
        "replicate",
        *carry,
        "forward",
        "reverse",
        consistent.alias("consistent"),
        F.when(consistent, forward).otherwise("inconsistent").alias("verdict"),
        is_reference(forward).alias("correct_ref_first"),
        is_reference(reverse).alias("correct_deg_first"),
        is_reference(single).alias("correct_single_random"),
        (consistent & (forward == "REF")).cast("int").alias("correct_swapped"),
        "latency_ms",
        "cost_usd",
        "tokens",
        (forward.isNotNull() & reverse.isNotNull()).alias("parsed_ok"),
    )


def _tie() -> Column:
    return F.coalesce(F.col("forward") == "tie", F.lit(False)) | F.coalesce(
        F.col("reverse") == "tie", F.lit(False)
    )


def position_report(outcomes: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Order sensitivity per judge and per judge x defect, with Wilson limits on inconsistency."""
    counted = outcomes.groupingSets(
        [["judge"], ["judge", "degradation"]], "judge", "degradation"
    ).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(~F.col("consistent")).alias("n_inconsistent"),
        F.sum("correct_ref_first").alias("_first"),
        F.sum("correct_deg_first").alias("_second"),
        F.sum("correct_single_random").alias("_random"),
        F.sum("correct_swapped").alias("_swapped"),
        F.count_if(_tie()).alias("_ties"),
        F.count_if(~F.col("parsed_ok")).alias("_unparsed"),
        F.sum("cost_usd").alias("cost_usd_total"),
    )
    n = F.col("n_pairs")
    low, high = wilson(F.col("n_inconsistent"), n, confidence)
    return counted.select(
        level_name({0: "degradation", 1: "judge"}).alias("level"),
        "judge",
        "degradation",
        "n_pairs",
        share(F.col("n_inconsistent"), n).alias("inconsistency_rate"),
        low.alias("lo"),
        high.alias("hi"),
        share(F.col("_first"), n).alias("accuracy_reference_first"),
        share(F.col("_second"), n).alias("accuracy_degraded_first"),
        share(F.col("_random"), n).alias("accuracy_random_order"),
        share(F.col("_swapped"), n).alias("accuracy_swap_and_average"),
        share(F.col("_ties"), n).alias("tie_rate"),
        share(F.col("_unparsed"), n).alias("parse_failure_rate"),
        (share(F.col("_first"), n) - share(F.col("_random"), n)).alias("fixed_order_inflation"),
        (share(F.col("_swapped"), n) - share(F.col("_random"), n)).alias("swap_vs_single_call"),
        "cost_usd_total",
        F.lit(2).alias("calls_per_comparison"),
    )


def swap_economics(position: DataFrame) -> DataFrame:
    """What the second call buys, from the judge level of the position report."""
    return position.where(F.col("level") == "judge").select(
        "judge",
        F.col("calls_per_comparison").alias("extra_calls_multiplier"),
        F.col("swap_vs_single_call").alias("accuracy_gain_over_single_call"),
        "inconsistency_rate",
    )


# What each process defect is called in reports.
BLINDNESS_LABELS = {
    "phantom_tool": "hallucination blindness",
    "wrong_argument": "argument blindness",
    "silent_failure": "path blindness",
    "length_padding": "trajectory-length bias (probe)",
}


def trace_blindness(
    outcomes: DataFrame, labels: dict[str, str] | None = None, confidence: float = 0.95
) -> DataFrame:
    """Detection per judge, defect and severity, and which defect each judge misses most."""
    keys = ["judge", "degradation", "severity"]
    counted = outcomes.groupingSets([keys, keys[:2], keys[:1]], *keys).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("n"),
        F.sum("correct_swapped").alias("detected"),
        F.count_if(~F.col("consistent")).alias("_inconsistent"),
    )
    low, high = wilson(F.col("detected"), F.col("n"), confidence)
    label = F.col("degradation")
    for key, text in (BLINDNESS_LABELS if labels is None else labels).items():
        label = F.when(F.col("degradation") == key, text).otherwise(label)
    return counted.select(
        level_name({0: "severity", 1: "degradation", 3: "judge"}).alias("level"),
        *keys,
        label.alias("label"),
        "n",
        share(F.col("detected"), F.col("n")).alias("detection_accuracy"),
        (F.lit(1.0) - share(F.col("detected"), F.col("n"))).alias("miss_rate"),
        low.alias("lo"),
        high.alias("hi"),
        share(F.col("_inconsistent"), F.col("n")).alias("order_inconsistency"),
    )


def worst_blindness(report: DataFrame) -> DataFrame:
    """The defect each judge detects least, by name on ties."""
    return (
        report.where(F.col("level") == "degradation")
        .groupBy("judge")
        .agg(F.min(F.struct("detection_accuracy", "degradation", "label", "miss_rate")).alias("w"))
        .select("judge", "w.degradation", "w.label", "w.detection_accuracy", "w.miss_rate")
    )
