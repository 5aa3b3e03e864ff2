"""Can a judge score a known-good answer above a deliberately damaged copy of it?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson


def discrimination_rows(
    judgments: DataFrame, references: DataFrame, on: tuple[str, ...] = ("judge", "item_id")
) -> DataFrame:
    """Each variant judgment beside the reference score of the same item and judge.

    ``correct`` and ``tie`` are null when either score is missing; a tie is never correct. References grow with the items,
    and Spark takes rows exploded from a narrow table for few: the hint keeps them from being broadcast.
    """
    reference = references.select(*on, F.col("score").alias("reference_score")).hint("merge")
    joined = judgments.withColumnRenamed("score", "variant_score").join(reference, list(on), "left")
    return joined.withColumn(
        "correct", (F.col("variant_score") < F.col("reference_score")).cast("int")
    ).withColumn("tie", (F.col("variant_score") == F.col("reference_score")).cast("int"))


def share(total: Column, count: Column) -> Column:
    """A ratio whose empty denominator counts as one row."""
    return total.cast("double") / F.greatest(count, F.lit(1)).cast("double")


def level_name(names: dict[int, str]) -> Column:
    """Text for each grouping-set id."""
    out = F.lit(None).cast("string")
    for key, label in names.items():
        out = F.when(F.col("_set") == key, label).otherwise(out)
    return out


def discrimination_report(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Accuracy with a Wilson interval per judge, judge x defect, judge x defect x severity."""
    keys = ["judge", "degradation", "severity"]
    counted = rows.groupingSets([keys, keys[:2], keys[:1]], *keys).agg(
        F.grouping_id().alias("_set"),
        F.count("correct").alias("n_pairs"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("n_correct"),
        F.coalesce(F.sum("tie"), F.lit(0)).alias("n_ties"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("variant_score").alias("mean_variant_score"),
    )
    low, high = wilson(F.col("n_correct"), F.col("n_pairs"), confidence)
    return counted.select(
        level_name({0: "severity", 1: "degradation", 3: "judge"}).alias("level"),
        *keys,
        "n_pairs",
        "n_correct",
        F.when(F.col("n_pairs") > 0, F.col("n_correct") / F.col("n_pairs")).alias("accuracy"),
        low.alias("lo"),
        high.alias("hi"),
        share(F.col("n_ties"), F.col("n_pairs")).alias("tie_rate"),
        share(F.col("n_rows") - F.col("n_pairs"), F.col("n_rows")).alias("parse_failure_rate"),
        "mean_variant_score",
    )


def reference_summary(references: DataFrame) -> DataFrame:
    """Mean reference score per judge: missing scores add nothing but stay in the denominator."""
    return references.groupBy("judge").agg(
        share(F.coalesce(F.sum("score"), F.lit(0.0)), F.count(F.lit(1))).alias(
            "mean_reference_score"
        ),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_reference_cost"),
    )


def judge_summary(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Per judge: accuracy, ties, parse failures, reference mean, cost, latency, worst defect.

    Both inputs carry ``cost_usd``; the worst defect is the least accurate, by name on ties.
    """
    by_defect = rows.groupBy("judge", "degradation").agg(
        F.count("correct").alias("n_pairs"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("n_correct"),
        F.coalesce(F.sum("tie"), F.lit(0)).alias("n_ties"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("latency_ms").alias("latency"),
        F.sum("cost_usd").alias("cost"),
    )
    accuracy = F.when(F.col("n_pairs") > 0, F.col("n_correct") / F.col("n_pairs"))
    judged = by_defect.groupBy("judge").agg(
        F.sum("n_pairs").alias("n_pairs"),
        F.sum("n_correct").alias("n_correct"),
        F.sum("n_ties").alias("n_ties"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("latency").alias("latency"),
        F.sum("cost").alias("cost"),
        F.min(F.when(accuracy.isNotNull(), F.struct(accuracy, F.col("degradation"))))
        .getField("degradation")
        .alias("worst_degradation"),
    )
    return judged.join(reference_summary(references), "judge", "left").select(
        "judge",
        "n_pairs",
        F.when(F.col("n_pairs") > 0, F.col("n_correct") / F.col("n_pairs")).alias("accuracy"),
        share(F.col("n_ties"), F.col("n_pairs")).alias("tie_rate"),
        share(F.col("n_rows") - F.col("n_pairs"), F.col("n_rows")).alias("parse_failure_rate"),
        F.coalesce("mean_reference_score", F.lit(0.0)).alias("mean_reference_score"),
        (F.col("cost") + F.coalesce("_reference_cost", F.lit(0.0))).alias("cost_usd_total"),
        share(F.col("latency"), F.col("n_rows")).alias("latency_ms_mean"),
        "worst_degradation",
    )
