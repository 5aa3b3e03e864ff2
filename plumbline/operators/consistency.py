"""How far repeated runs of one judge agree with each other.

``log`` has judge, item_id, replicate and a nullable score. A replicate is one run over all items,
so an item holds at most one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators.agreement import kappa, krippendorff
from plumbline.operators.discrimination import share

# Lower edges of the score bands, and the accept/reject cut.
BANDS = [(9.0, "excellent"), (7.0, "good"), (5.0, "adequate"), (3.0, "poor")]
LOWEST_BAND = "bad"
ACCEPT_AT = 7.0


def band(score: Column) -> Column:
    """The rubric band of a score; a missing score has none."""
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for edge, name in BANDS[1:]:
        out = out.when(score >= edge, name)
    return F.when(score.isNotNull(), out.otherwise(LOWEST_BAND))


def band_rank(score: Column) -> Column:
    """The band as a number, which aggregates without sorting."""
    rank = F.lit(0)
    for edge, _ in BANDS:
        rank = rank + F.when(score >= edge, 1).otherwise(0)
    return F.when(score.isNotNull(), rank)


def item_spread(log: DataFrame, accept_at: float = ACCEPT_AT) -> DataFrame:
    """Per judge and item: did any run change band or decision, and the spread of its scores."""
    score = F.col("score")
    return log.groupBy("judge", "item_id").agg(
        F.coalesce(
            (F.min(band_rank(score)) != F.max(band_rank(score))).cast("int"), F.lit(0)
        ).alias("band_flip"),
        F.coalesce(
            (F.min(score >= accept_at) != F.max(score >= accept_at)).cast("int"), F.lit(0)
        ).alias("decision_flip"),
        F.when(F.count(score) > 1, F.stddev_pop(score)).alias("score_sd"),
    )


def flip_rates(log: DataFrame, accept_at: float = ACCEPT_AT, confidence: float = 0.95) -> DataFrame:
    """Flip rates over items with Wilson limits, and mean and largest per-item deviation."""
    counted = item_spread(log, accept_at).groupBy("judge").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("band_flip").alias("_bands"),
        F.sum("decision_flip").alias("_decisions"),
        F.coalesce(F.avg("score_sd"), F.lit(0.0)).alias("mean_score_sd"),
        F.coalesce(F.max("score_sd"), F.lit(0.0)).alias("max_score_sd"),
    )
    n = F.col("n_items")
    band_low, band_high = wilson(F.col("_bands"), n, confidence)
    flip_low, flip_high = wilson(F.col("_decisions"), n, confidence)
    return counted.select(
        "judge",
        "n_items",
        share(F.col("_bands"), n).alias("verdict_flip_rate"),
        band_low.alias("verdict_flip_lo"),
        band_high.alias("verdict_flip_hi"),
        share(F.col("_decisions"), n).alias("accept_reject_flip_rate"),
        flip_low.alias("accept_reject_flip_lo"),
        flip_high.alias("accept_reject_flip_hi"),
        "mean_score_sd",
        "max_score_sd",
    )


def replicate_pairs(log: DataFrame, value: Column) -> DataFrame:
    """Counts of value combinations for every two runs i < j of a judge over their common items.

    A run scores an item once, so an item holds no more entries than there are runs. They sit together
    after one shuffle; what leaves the map side is a count per judge, run pair and value combination.
    """
    runs = (
        log.where(value.isNotNull())
        .groupBy("judge", "item_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("replicate").alias("run"), value.alias("value")))
            ).alias("runs")
        )
    )
    later = runs.select("judge", "runs", F.posexplode("runs").alias("at", "first")).select(
        "judge",
        "first",
        F.explode(F.slice("runs", F.col("at") + 2, F.size("runs"))).alias("second"),
    )
    return later.groupBy(
        "judge",
        F.col("first.run").alias("run_a"),
        F.col("second.run").alias("run_b"),
        F.col("first.value").alias("a"),
        F.col("second.value").alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))


def replicate_disagreement(log: DataFrame, accept_at: float = ACCEPT_AT) -> DataFrame:
    """Mean over run pairs of the share of common items the two runs decide differently."""
    pairs = replicate_pairs(log, F.col("score") >= accept_at)
    per_pair = pairs.groupBy("judge", "run_a", "run_b").agg(
        share(F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)), F.sum("n")).alias(
            "share"
        )
    )
    return per_pair.groupBy("judge").agg(
        F.count(F.lit(1)).alias("n_run_pairs"),
        F.avg("share").alias("two_run_decision_disagreement"),
    )


def agreement_report(log: DataFrame) -> DataFrame:
    """Krippendorff's alpha over all runs and the mean pairwise kappa, on score bands."""
    banded = log.withColumn("band", band(F.col("score")))
    alpha = krippendorff(banded, ["judge"], "item_id", "band")
    pairs = replicate_pairs(log, band(F.col("score")))
    kappas = kappa(pairs, ["judge", "run_a", "run_b"], "a", "b", weight="n")
    mean_kappa = kappas.groupBy("judge").agg(F.avg("kappa").alias("mean_pairwise_kappa"))
    return alpha.join(mean_kappa, "judge", "left").select(
        "judge", F.col("alpha").alias("krippendorff_alpha"), "mean_pairwise_kappa"
    )
