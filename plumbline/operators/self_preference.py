"""Does a judge score its own family's answers above what its peers give them?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.bootstrap import bootstrap_ci, paired_diff
from plumbline.operators.ordered import numbered


def loo_deviation(log: DataFrame, models: DataFrame) -> DataFrame:
    """Each score minus the mean of the other judges' scores on the same response.

    ``log`` has judge, generator, item_id and score; a response without a second judge is left out.
    """
    scored = log.where(F.col("score").isNotNull())
    response = scored.groupBy("generator", "item_id").agg(
        F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("_judges")
    )
    families = models.select("alias", "family")
    return (
        scored.join(response.where(F.col("_judges") > 1), ["generator", "item_id"])
        .join(families.withColumnsRenamed({"alias": "judge", "family": "judge_family"}), "judge")
        .join(
            families.withColumnsRenamed({"alias": "generator", "family": "generator_family"}),
            "generator",
        )
        .select(
            "judge",
            "generator",
            "item_id",
            (
                F.col("score") - (F.col("_sum") - F.col("score")) / (F.col("_judges") - 1)
            ).alias("deviation"),
            (F.col("judge_family") == F.col("generator_family")).alias("own_family"),
        )
    )


def deviation_summary(deviations: DataFrame) -> DataFrame:
    """Mean deviation per judge, by generator and by own or other family."""
    by_generator = deviations.groupBy("judge", F.col("generator").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("deviation").alias("mean_deviation")
    )
    side = F.when(F.col("own_family"), "own family").otherwise("other family")
    by_family = deviations.groupBy("judge", side.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("deviation").alias("mean_deviation")
    )
    return by_generator.withColumn("level", F.lit("generator")).unionByName(
        by_family.withColumn("level", F.lit("family"))
    )


def deviation_intervals(deviations: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    return bootstrap_ci(
        deviations, ["judge", "own_family"], "deviation", resamples=resamples, seed=seed
    )


def own_other_pairs(deviations: DataFrame) -> DataFrame:
    """Own and other deviations paired by position in (generator, item) order, both lists cut to
    the shorter one."""
    placed = numbered(deviations, ["judge", "own_family"], ["generator", "item_id"], "position")
    return (
        placed.groupBy("judge", "position")
        .agg(
            F.max(F.when(F.col("own_family"), F.col("deviation"))).alias("own"),
            F.max(F.when(~F.col("own_family"), F.col("deviation"))).alias("other"),
        )
        .where(F.col("own").isNotNull() & F.col("other").isNotNull())
    )


def self_enhancement(deviations: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Own minus other deviation with a paired bootstrap."""
    return paired_diff(
        own_other_pairs(deviations), ["judge"], "own", "other", resamples=resamples, seed=seed
    )


def self_enhancement_unpaired(deviations: DataFrame) -> DataFrame:
    """Own mean minus other mean over all rows, with no pairing assumed."""
    return deviations.groupBy("judge").agg(
        F.avg(F.when(F.col("own_family"), F.col("deviation"))).alias("own_mean"),
        F.avg(F.when(~F.col("own_family"), F.col("deviation"))).alias("other_mean"),
    ).withColumn("effect", F.col("own_mean") - F.col("other_mean"))
