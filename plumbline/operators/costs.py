"""What accuracy costs, and which judges are worth it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.bootstrap import paired_diff
from plumbline.operators.ordered import running


def token_cost(list_price: bool = True) -> Column:
    """Price of one call from its token counts and the model's price per million tokens."""
    prefix = "list_" if list_price else ""
    spent = F.col("prompt_tokens") * F.col(f"{prefix}usd_per_mtok_in") + F.col(
        "completion_tokens"
    ) * F.col(f"{prefix}usd_per_mtok_out")
    return spent / 1e6


def with_cost(log: DataFrame, models: DataFrame, list_price: bool = True) -> DataFrame:
    """The log with ``cost_usd`` at list or real prices."""
    prices = ["usd_per_mtok_in", "usd_per_mtok_out", "list_usd_per_mtok_in", "list_usd_per_mtok_out"]
    priced = log.join(models.select(F.col("alias").alias("judge"), *prices), "judge", "left")
    return priced.withColumn("cost_usd", token_cost(list_price)).drop(*prices)


def cost_accuracy(summary: DataFrame, models: DataFrame) -> DataFrame:
    """Unit costs and rates per judge; ``summary`` has judge, accuracy, n_pairs, cost_usd_total and
    latency_ms_mean."""
    dimension = models.select(F.col("alias").alias("judge"), "provider", "family", "tier")
    accuracy, cost, n = F.col("accuracy"), F.col("cost_usd_total"), F.col("n_pairs")
    latency = F.greatest(F.col("latency_ms_mean"), F.lit(1e-9))
    return summary.join(dimension, "judge").select(
        "judge",
        "provider",
        "family",
        "tier",
        "accuracy",
        cost.alias("total_cost_usd"),
        (1000 * cost / F.greatest(n, F.lit(1))).alias("cost_per_1k_usd"),
        (cost / F.greatest(accuracy * n, F.lit(1e-9))).alias("cost_per_correct_usd"),
        F.col("latency_ms_mean").alias("mean_latency_ms"),
        (1000 / latency).alias("judgments_per_second"),
        (accuracy / F.greatest(cost, F.lit(1e-12))).alias("accuracy_per_dollar"),
    )


def pareto(df: DataFrame, cost: str, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows no cheaper row beats: cost ascending, each kept row strictly above all before it.

    Rows of equal cost go by ``name``, which must be unique inside a group.
    """
    ranked = running(df, list(by), [cost, name], peaks={"_best": value})
    return ranked.where(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best")


def _leader(order: Column, keep: tuple[str, ...], when: Column | None = None) -> Column:
    row = F.struct(order.alias("o"), *[F.col(c) for c in keep])
    return F.min(row if when is None else F.when(when, row))


def headline(costs: DataFrame, open_tier: str = "open-weight") -> DataFrame:
    """Best judge, best open-weight judge and how they compare. Ties go to the first name."""
    keep = ("judge", "accuracy", "cost_per_1k_usd", "mean_latency_ms")
    best = costs.agg(
        _leader(-F.col("accuracy"), keep).alias("top"),
        _leader(-F.col("accuracy"), keep, F.col("tier") == open_tier).alias("open"),
        _leader(F.col("cost_per_correct_usd"), ("judge",)).alias("cheap"),
    )
    return best.where(F.col("open").isNotNull() & (F.col("open.judge") != F.col("top.judge"))).select(
        F.col("top.judge").alias("frontier_judge"),
        F.col("open.judge").alias("best_open_weight_judge"),
        (100 * F.col("open.accuracy") / F.col("top.accuracy")).alias("accuracy_retained_pct"),
        (F.col("open.accuracy") - F.col("top.accuracy")).alias("accuracy_gap"),
        (
            F.col("open.cost_per_1k_usd") / F.greatest(F.col("top.cost_per_1k_usd"), F.lit(1e-12))
        ).alias("open_cost_over_frontier_cost"),
        F.col("cheap.judge").alias("cheapest_per_correct_judgment"),
        (
            F.col("top.mean_latency_ms")
            / F.greatest(F.col("open.mean_latency_ms"), F.lit(1e-9))
        ).alias("latency_ratio_frontier_over_open"),
    )


def headline_gap(
    rows: DataFrame, leaders: DataFrame, task: list[str], resamples: int = 10_000, seed: int = 0
) -> DataFrame:
    """Paired difference, best open-weight judge minus best judge, on the tasks both answered."""
    pair = leaders.select(
        F.explode(
            F.array(
                F.struct(F.col("best_open_weight_judge").alias("judge"), F.lit("a").alias("side")),
                F.struct(F.col("frontier_judge").alias("judge"), F.lit("b").alias("side")),
            )
        ).alias("p")
    ).select("p.judge", "p.side")
    both = (
        rows.where(F.col("correct").isNotNull())
        .join(pair, "judge")
        .groupBy(*task)
        .agg(
            F.max(F.when(F.col("side") == "a", F.col("correct"))).alias("a"),
            F.max(F.when(F.col("side") == "b", F.col("correct"))).alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    return paired_diff(both, [], "a", "b", resamples=resamples, seed=seed)
