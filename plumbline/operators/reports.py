"""Reports made of reports: findings, reliability beside verdicts, one sheet of numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(
    blindness: DataFrame, position: DataFrame, defect: str = "wrong_argument"
) -> DataFrame:
    """The worst judge of each headline metric with its numbers; ties go to the first name."""
    worst_miss = (
        blindness.where((F.col("level") == "degradation") & (F.col("degradation") == defect))
        .agg(F.min(F.struct(-F.col("miss_rate"), "judge", "miss_rate", "lo", "hi")).alias("w"))
        .select(
            F.lit("argument_blindness").alias("finding"),
            "w.judge",
            F.col("w.miss_rate").alias("value"),
            F.col("w.lo").alias("lo"),
            F.col("w.hi").alias("hi"),
        )
    )
    worst_order = (
        position.where(F.col("level") == "judge")
        .agg(
            F.min(
                F.struct(-F.col("inconsistency_rate"), "judge", "inconsistency_rate", "lo", "hi")
            ).alias("w")
        )
        .select(
            F.lit("position_bias").alias("finding"),
            "w.judge",
            F.col("w.inconsistency_rate").alias("value"),
            F.col("w.lo").alias("lo"),
            F.col("w.hi").alias("hi"),
        )
    )
    return worst_miss.unionByName(worst_order).where(F.col("judge").isNotNull())


def attach_reliability(
    verdicts: DataFrame,
    discrimination: DataFrame,
    position: DataFrame | None = None,
    consistency: DataFrame | None = None,
) -> DataFrame:
    """Each verdict with what is known of its judge under the same execution mode.

    Every report has judge and mode. Without a matching accuracy report nothing is attached.
    """
    keys = ["judge", "mode"]
    out = verdicts.join(
        discrimination.select(*keys, "accuracy", "worst_degradation").withColumn(
            "available", F.lit(True)
        ),
        keys,
        "left",
    ).withColumn("available", F.coalesce("available", F.lit(False)))
    for report, column in ((position, "inconsistency_rate"), (consistency, "accept_reject_flip_rate")):
        if report is not None:
            out = out.join(report.select(*keys, column), keys, "left").withColumn(
                column, F.when(F.col("available"), F.col(column))
            )
    return out


def numbers_sheet(reports: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """One long table of every number: report, level columns as text, metric and value.

    ``reports`` maps a name to a table, the columns that say which row it is, and its metrics.
    """

    def long(name: str, df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
        level = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("*")) for k in keys])
        return (
            df.select(level.alias("level"), *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(["level"], metrics, "metric", "value")
            .withColumn("report", F.lit(name))
        )

    parts = [long(name, *spec) for name, spec in reports.items()]
    return reduce(DataFrame.unionByName, parts).select("report", "level", "metric", "value")
