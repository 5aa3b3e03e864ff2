"""Agreement coefficients and paired or ranked tests as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numerics import chi_square_tail, correlation_tail
from plumbline.session import cut_lineage
from plumbline.operators.ordered import mid_ranks, running, with_chunk

NAN = float("nan")


def kappa(
    df: DataFrame, by: Sequence[str], a: str, b: str, weight: str | None = None
) -> DataFrame:
    """Cohen's kappa of two label columns; when both are constant, 1 if they are the same, else 0."""
    by = list(by)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    cells = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(amount.alias("_n"))
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("_a").alias("label"),
                    F.col("_n").alias("in_a"),
                    F.lit(0).cast("bigint").alias("in_b"),
                    F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0).alias("same"),
                ),
                F.struct(
                    F.col("_b").alias("label"),
                    F.lit(0).cast("bigint").alias("in_a"),
                    F.col("_n").alias("in_b"),
                    F.lit(0).cast("bigint").alias("same"),
                ),
            )
        ).alias("s"),
    )
    labels = sides.groupBy(*by, "s.label").agg(
        F.sum("s.in_a").alias("in_a"), F.sum("s.in_b").alias("in_b"), F.sum("s.same").alias("same")
    )
    totals = labels.groupBy(*by).agg(
        F.sum("in_a").alias("n"),
        F.sum("same").alias("_same"),
        F.sum(F.col("in_a").cast("double") * F.col("in_b").cast("double")).alias("_chance"),
    )
    n = F.col("n").cast("double")
    observed, expected = F.col("_same") / n, F.col("_chance") / (n * n)
    return totals.select(
        *by,
        "n",
        F.when(expected >= 1.0, F.lit(1.0))
        .otherwise((observed - expected) / F.when(expected < 1.0, 1.0 - expected))
        .alias("kappa"),
    )


def krippendorff(df: DataFrame, by: Sequence[str], item: str, rating: str) -> DataFrame:
    """Krippendorff's alpha for nominal ratings. Missing ratings are ignored inside an item, items
    with fewer than two ratings are left out; NaN without such items, 1 if all ratings agree."""
    by = list(by)
    counts = (
        df.where(F.col(rating).isNotNull())
        .groupBy(*by, item, F.col(rating).cast("string").alias("_r"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    per_item = counts.groupBy(*by, item).agg(
        F.sum("c").alias("m"), F.collect_list(F.struct("_r", "c")).alias("_cells")
    )
    cells = (
        per_item.where(F.col("m") > 1)
        .select(*by, "m", F.explode("_cells").alias("cell"))
        .groupBy(*by, "cell._r")
        .agg(
            F.sum("cell.c").alias("c"),
            F.sum(
                F.col("cell.c") * (F.col("m") - F.col("cell.c")) / (F.col("m") - 1).cast("double")
            ).alias("disagree"),
        )
    )
    totals = cells.groupBy(*by).agg(
        F.sum("c").cast("double").alias("_n"),
        F.sum("disagree").alias("_d"),
        F.sum(F.col("c").cast("double") * (F.col("c") - 1).cast("double")).alias("_same"),
    )
    n = F.col("_n")
    expected = 1.0 - F.col("_same") / (n * (n - 1))
    alpha = F.when(expected <= 0, 1.0).otherwise(
        1.0 - (F.col("_d") / n) / F.when(expected > 0, expected)
    )
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")) if by else None
    scored = totals.select(*by, n.cast("bigint").alias("n_ratings"), alpha.alias("alpha"))
    if groups is None:
        return scored
    return groups.join(scored, by, "left").select(
        *by,
        F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"),
        F.coalesce("alpha", F.lit(NAN)).alias("alpha"),
    )


def _binomial_tail(fewer: Column, total: Column) -> Column:
    """P(X <= fewer) for X ~ Bin(total, 1/2), by the ratio of successive coefficients."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(fewer > 0, F.sequence(F.lit(1).cast("bigint"), fewer)).otherwise(
        F.array().cast("array<bigint>")
    )

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * (total - k + 1).cast("double") / k.cast("double")
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.aggregate(steps, start, add, lambda acc: acc["sum"]) / F.pow(
        F.lit(2.0), total.cast("double")
    )


def mcnemar_counts(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Discordant counts: b where only ``a`` is correct, c where only ``b`` is correct."""
    left, right = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    return df.groupBy(*by).agg(
        F.count_if(left & ~right).alias("b"), F.count_if(right & ~left).alias("c")
    )


def mcnemar_from_counts(counts: DataFrame, exact_below: int = 25) -> DataFrame:
    """Statistic and p-value: exact binomial for few discordant pairs, else corrected chi-square."""
    b, c = F.col("b"), F.col("c")
    total = b + c
    exact = total < exact_below
    fewer = F.least(b, c)
    chi = F.when(~exact, F.pow(F.abs(b - c).cast("double") - 1.0, 2) / total.cast("double"))
    few = F.when(exact, total).otherwise(0)
    exact_p = F.least(F.lit(1.0), 2.0 * _binomial_tail(F.least(fewer, few), few))
    scored = counts.withColumn("exact", exact).withColumn(
        "statistic",
        F.when(total == 0, 0.0).when(exact, fewer.cast("double")).otherwise(chi),
    )
    return (
        scored.withColumn("_tail", chi_square_tail(F.coalesce(chi, F.lit(0.0))))
        .withColumn(
            "p_value", F.when(total == 0, 1.0).when(exact, exact_p).otherwise(F.col("_tail"))
        )
        .drop("_tail")
    )


def mcnemar(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    return mcnemar_from_counts(mcnemar_counts(df, by, a, b))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, p_values: bool = True) -> DataFrame:
    """Rank correlation with average ranks; NaN where one side is constant."""
    by = list(by)
    joint = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    def ranks(column: str, name: str) -> DataFrame:
        histogram = joint.groupBy(*by, column).agg(F.sum("_n").alias("_w"))
        return mid_ranks(histogram, by, column, "_w").select(
            *by, column, F.col("mid_rank").alias(name)
        )

    ranked = joint.join(ranks("_x", "_rx"), [*by, "_x"]).join(ranks("_y", "_ry"), [*by, "_y"])
    w, rx, ry = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.sum(w * rx).alias("sx"),
        F.sum(w * ry).alias("sy"),
        F.sum(w * rx * rx).alias("sxx"),
        F.sum(w * ry * ry).alias("syy"),
        F.sum(w * rx * ry).alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy)))
    out = sums.select(*by, "n", F.coalesce(rho, F.lit(NAN)).alias("rho"))
    if p_values:
        out = out.withColumn("p_value", correlation_tail(F.col("rho"), F.col("n").cast("double")))
    return out


def holm(
    df: DataFrame,
    family: Sequence[str],
    p: str,
    tie_break: Sequence[str],
    alpha: float = 0.05,
) -> DataFrame:
    """Step-down adjusted p-values inside each family, with the rejection and family counts.

    The table of tests is read several times and is the end of a long plan, so it is written once.
    """
    family, order = list(family), [p, *tie_break]
    tagged = with_chunk(cut_lineage(df), family, order)
    sizes = tagged.groupBy(*family, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*family).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spans = sizes.select(
        *family,
        "_chunk",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*family)).alias("n_tests"),
    )
    inside = Window.partitionBy(*family, "_chunk").orderBy(*order)
    rank = F.col("_before") + F.row_number().over(inside)
    scaled = tagged.join(spans, [*family, "_chunk"]).withColumn(
        "_scaled", (F.col("n_tests") - rank + 1) * F.col(p)
    )
    tops = scaled.groupBy(*family, "_chunk").agg(F.max("_scaled").alias("_top"))
    peaks = tops.select(*family, "_chunk", F.max("_top").over(earlier).alias("_peak"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    highest = F.greatest(F.max("_scaled").over(upto), F.col("_peak"))
    return (
        scaled.join(peaks, [*family, "_chunk"])
        .withColumn("p_adjusted", F.least(F.lit(1.0), highest))
        .withColumn("reject", F.col("p_adjusted") <= alpha)
        .drop("_chunk", "_before", "_scaled", "_peak")
    )


def holm_summary(adjusted: DataFrame, family: Sequence[str]) -> DataFrame:
    return adjusted.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if("reject").alias("n_significant")
    )


def cliffs_delta(df: DataFrame, by: Sequence[str], side: Column, value: str) -> DataFrame:
    """P(a > b) - P(a < b) over all pairs of the two sides, from cumulative counts.

    ``side`` is true for the first sample. NaN when a side is empty.
    """
    by = list(by)
    histogram = df.groupBy(*by, F.col(value).alias("_v")).agg(
        F.count_if(side).alias("_a"), F.count_if(~side).alias("_b")
    )
    ranked = running(histogram, by, ["_v"], {"_b_upto": "_b"})
    sums = ranked.groupBy(*by).agg(
        F.sum("_a").alias("n_a"),
        F.sum("_b").alias("n_b"),
        F.sum(F.col("_a").cast("double") * (F.col("_b_upto") - F.col("_b"))).alias("_gt"),
        F.sum(F.col("_a").cast("double") * F.col("_b_upto")).alias("_le"),
    )
    pairs = F.col("n_a").cast("double") * F.col("n_b").cast("double")
    less = pairs - F.col("_le")
    return sums.select(
        *by,
        "n_a",
        "n_b",
        F.coalesce((F.col("_gt") - less) / F.when(pairs > 0, pairs), F.lit(NAN)).alias("delta"),
    )
