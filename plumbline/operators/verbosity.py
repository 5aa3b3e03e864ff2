"""Does padding alone raise a judge's score?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators.bootstrap import paired_diff
from plumbline.operators.discrimination import share


def padded_pairs(
    padded: DataFrame, references: DataFrame, on: tuple[str, ...] = ("judge", "item_id")
) -> DataFrame:
    """Padded score beside the reference score of the same item, where both were parsed. No side is small, so none is broadcast."""
    reference = references.select(*on, F.col("score").alias("reference_score")).hint("merge")
    joined = padded.withColumnRenamed("score", "padded_score").join(reference, list(on))
    return joined.where(F.col("padded_score").isNotNull() & F.col("reference_score").isNotNull())


def verbosity_report(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Score gain from padding per judge, configuration and severity."""
    higher = F.count_if(F.col("padded_score") > F.col("reference_score"))
    counted = pairs.groupBy("judge", "config", "severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("len_ratio").alias("mean_length_ratio"),
        F.avg("padded_score").alias("padded_mean_score"),
        F.avg("reference_score").alias("reference_mean_score"),
        F.avg(F.col("padded_score") - F.col("reference_score")).alias("delta_points"),
        higher.alias("_higher"),
    )
    low, high = wilson(F.col("_higher"), F.col("n"), confidence)
    growth = F.col("mean_length_ratio") - 1.0
    return counted.select(
        "judge",
        "config",
        "severity",
        "n",
        "mean_length_ratio",
        "delta_points",
        F.when(growth > 0, F.col("delta_points") / F.greatest(growth, F.lit(1e-9)))
        .otherwise(0.0)
        .alias("points_per_doubling"),
        share(F.col("_higher"), F.col("n")).alias("share_scored_higher"),
        low.alias("share_lo"),
        high.alias("share_hi"),
        "padded_mean_score",
        "reference_mean_score",
    )


def max_verbosity_gain(report: DataFrame) -> DataFrame:
    return report.groupBy("judge").agg(F.max("delta_points").alias("max_verbosity_gain"))


def verbosity_intervals(pairs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Paired bootstrap of padded minus reference score."""
    return paired_diff(
        pairs,
        ["judge", "config", "severity"],
        "padded_score",
        "reference_score",
        resamples=resamples,
        seed=seed,
    )


def padded_trace_pairs(padded: DataFrame, references: DataFrame) -> DataFrame:
    """The score of every padded trace beside that of its own undamaged trace by the same judge, where both were given.

    ``padded`` has judge, trace_id, severity, len_ratio and score; ``references`` has judge, trace_id and score.
    """
    return padded_pairs(padded, references, ("judge", "trace_id"))


def trace_length_bias(pairs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Paired difference of padded and reference score per judge: what length alone is worth."""
    return paired_diff(pairs, ["judge"], "padded_score", "reference_score", resamples, seed=seed)
