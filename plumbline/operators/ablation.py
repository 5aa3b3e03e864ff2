"""Does a richer prompt help, and is it worth its tokens?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators.agreement import holm, mcnemar_from_counts
from plumbline.operators.bootstrap import paired_diff
from plumbline.operators.discrimination import discrimination_rows, share


def ablation_rows(
    judgments: DataFrame, references: DataFrame, on: tuple[str, ...] = ("judge", "item_id")
) -> DataFrame:
    """Correctness with a missing score counted as a miss."""
    rows = discrimination_rows(judgments, references, on)
    return rows.withColumn("correct", F.coalesce("correct", F.lit(0)))


def config_accuracy(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Accuracy, tokens, cost and latency per judge and prompt configuration."""
    counted = rows.groupBy("judge", "config").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("_correct"),
        F.sum((F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint")).alias(
            "total_tokens"
        ),
        F.sum("cost_usd").alias("cost_usd"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    )
    low, high = wilson(F.col("_correct"), F.col("n"), confidence)
    return counted.select(
        "judge",
        "config",
        "n",
        share(F.col("_correct"), F.col("n")).alias("accuracy"),
        low.alias("lo"),
        high.alias("hi"),
        "total_tokens",
        "cost_usd",
        "mean_latency_ms",
    )


def config_cells(rows: DataFrame, task: Sequence[str], configs: Sequence[str]) -> DataFrame:
    """Counts of (correct under a, correct under b) for every two configurations a before b.

    The configurations of one task meet in one shuffle as a map of at most ``len(configs)`` flags.
    """
    flags = rows.groupBy("judge", *task).agg(
        *[
            F.max(F.when(F.col("config") == c, F.col("correct"))).alias(f"_f{i}")
            for i, c in enumerate(configs)
        ]
    )
    pairs = [
        F.struct(
            F.lit(a).alias("baseline"),
            F.lit(b).alias("candidate"),
            F.col(f"_f{i}").alias("a"),
            F.col(f"_f{j}").alias("b"),
        )
        for i, a in enumerate(configs)
        for j, b in enumerate(configs)
        if i < j
    ]
    spread = flags.select("judge", F.explode(F.array(*pairs)).alias("p")).select("judge", "p.*")
    return (
        spread.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("judge", "baseline", "candidate", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def config_comparisons(
    rows: DataFrame,
    task: Sequence[str],
    configs: Sequence[str] = ("vague", "rubric", "cot"),
    alpha: float = 0.05,
) -> DataFrame:
    """Candidate against baseline on the same tasks: accuracy change, McNemar with Holm over all
    comparisons, Cliff's delta, extra tokens and points per thousand extra tokens."""
    keys = ["judge", "baseline", "candidate"]
    n = F.col("n")
    counted = config_cells(rows, task, configs).groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(F.when((F.col("b") == 1) & (F.col("a") == 0), n).otherwise(0)).alias("b"),
        F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0), n).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("a") == 1, n).otherwise(0)).alias("_a"),
        F.sum(F.when(F.col("b") == 1, n).otherwise(0)).alias("_b"),
    )
    total = F.col("n").cast("double")
    share_a, share_b = F.col("_a") / total, F.col("_b") / total
    tested = mcnemar_from_counts(counted).withColumn("delta", share_b - share_a).withColumn(
        "cliffs_delta", share_b * (1 - share_a) - share_a * (1 - share_b)
    )
    spent = rows.groupBy("judge", "config").agg(
        F.sum((F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint")).alias("tokens")
    )
    cost_a = spent.select("judge", F.col("config").alias("baseline"), F.col("tokens").alias("_ta"))
    cost_b = spent.select("judge", F.col("config").alias("candidate"), F.col("tokens").alias("_tb"))
    priced = (
        tested.join(cost_a, ["judge", "baseline"])
        .join(cost_b, ["judge", "candidate"])
        .withColumn("extra_tokens", F.col("_tb") - F.col("_ta"))
    )
    extra = F.col("extra_tokens")
    adjusted = holm(priced, [], "p_value", keys, alpha)
    return adjusted.select(
        *keys,
        "n",
        "delta",
        "b",
        "c",
        "statistic",
        "p_value",
        "exact",
        "cliffs_delta",
        "extra_tokens",
        F.when(extra != 0, 100 * F.col("delta") / (F.when(extra != 0, extra) / 1000.0))
        .otherwise(F.lit(float("inf")))
        .alias("points_per_1k_extra_tokens"),
        F.col("p_adjusted").alias("p_adjusted_holm"),
        F.col("reject").alias("significant_after_correction"),
    )


def config_delta_intervals(
    rows: DataFrame,
    task: Sequence[str],
    configs: Sequence[str] = ("vague", "rubric", "cot"),
    resamples: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap interval of candidate minus baseline, from the cell counts."""
    cells = config_cells(rows, task, configs)
    return paired_diff(
        cells,
        ["judge", "baseline", "candidate"],
        "b",
        "a",
        resamples=resamples,
        seed=seed,
        weight="n",
    )
