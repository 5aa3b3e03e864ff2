"""Latency summaries. Two percentile definitions are in use and kept apart: the nearest rank at
p(n - 1) rounded half to even, and linear interpolation between ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import values_at_ranks

NEAREST = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def _histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def latency_summary(
    df: DataFrame, by: Sequence[str], value: str, budget: float | None = None
) -> DataFrame:
    """Count, mean, nearest-rank percentiles and maximum; with a budget, whether p99 keeps it."""
    by = list(by)
    last = F.col("total") - 1
    ranks = {name: F.bround(F.lit(p) * last, 0) for name, p in NEAREST.items()}
    picked = values_at_ranks(_histogram(df, by, value), by, "_value", "_n", ranks)
    basics = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(value).cast("double")).alias("mean"),
            F.max(F.col(value).cast("double")).alias("max"),
        )
    )
    out = basics.join(picked, by).select(*by, "n", "mean", *NEAREST, "max")
    if budget is not None:
        out = out.withColumn("within_budget", F.col("p99") <= budget)
    return out


def percentile_linear(df: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """The p-quantile with linear interpolation between the two nearest ranks."""
    by = list(by)
    place = F.lit(float(p)) * (F.col("total") - 1)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    picked = values_at_ranks(
        _histogram(df, by, value),
        by,
        "_value",
        "_n",
        {"_lo": F.floor(place), "_hi": F.ceil(place)},
    )
    return picked.join(counts, by).select(
        *by,
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (place - F.floor(place))).alias("value"),
    )


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, salts: int = 32) -> DataFrame:
    """The n latest rows of each group by a unique order.

    First the n latest of each salted part of a group, which Spark limits before the shuffle; then the
    n latest of those. No group's history is ever sorted in one task.
    """
    by = list(by)
    latest = [F.col(c).desc() for c in order]
    part = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts))
    of_part = Window.partitionBy(*by, "_part").orderBy(*latest)
    some = df.withColumn("_part", part).withColumn("_nth", F.row_number().over(of_part)).where(F.col("_nth") <= n)
    of_group = Window.partitionBy(*by).orderBy(*latest)
    return (
        some.withColumn("_nth", F.row_number().over(of_group)).where(F.col("_nth") <= n).drop("_part", "_nth")
    )


def last_n_latency(
    requests: DataFrame, n: int = 5000, budget: float = 150.0
) -> DataFrame:
    """Per endpoint: all-time count and errors, and latency over the last n samples.

    ``requests`` has endpoint, ms, is_error, ts and a unique event_id.
    """
    totals = requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("is_error").alias("errors")
    )
    window = last_n(requests, ["endpoint"], ["ts", "event_id"], n)
    summary = latency_summary(window, ["endpoint"], "ms", budget)
    return totals.join(summary, "endpoint").withColumnRenamed("n", "window")
