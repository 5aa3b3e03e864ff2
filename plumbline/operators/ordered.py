"""Running totals and ranks over an order, without one task per group.

A plain window puts a whole group into one task. Here every group is first cut into ranges of its
order key. The cut points are the keys whose hash falls on one of ``range_rows`` values: a fixed sample of
the distinct keys that any retry reproduces, and that grows with the group, so a range holds about
``range_rows`` keys however large the group is. Totals per range are small, so the offsets are cheap, and
the window inside one range sees only a fraction of the group. Results are exact whatever the cut points are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 200_000
CUT_STEPS = [1 << k for k in range(40, -1, -1)]


def _key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def _cuts_up_to(key: Column, cuts: Column) -> Column:
    """How many of the sorted cut points are at or below the key, by halving."""
    steps = F.filter(F.array(*[F.lit(s).cast("bigint") for s in CUT_STEPS]), lambda s: s <= F.size(cuts))
    return F.aggregate(
        steps,
        F.lit(0).cast("bigint"),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.get(cuts, (at + step - 1).cast("int")) <= key), at + step
        ).otherwise(at),
    )


def _cut_points(df: DataFrame, by: Sequence[str], order: Sequence[str], range_rows: int, salt: str) -> DataFrame:
    identity = F.xxhash64(F.lit(salt), *[F.col(c) for c in order])
    drawn = df.where(F.pmod(identity, F.lit(range_rows)) == 0)
    return drawn.groupBy(*by).agg(F.array_sort(F.collect_set(_key(order))).alias("_cuts"))


def with_chunk(
    df: DataFrame, by: Sequence[str], order: Sequence[str], range_rows: int | None = None, salt: str = "cut"
) -> DataFrame:
    """Adds ``_chunk``, an order-preserving range number inside each group. Another salt cuts elsewhere."""
    cuts = _cut_points(df, by, order, range_rows or RANGE_ROWS, salt)
    if by:
        tagged = df.join(cuts, list(by), "left")
    else:
        tagged = df.withColumn("_cuts", cuts.scalar())
    chunk = F.when(F.size("_cuts") > 0, _cuts_up_to(_key(order), F.col("_cuts"))).otherwise(F.lit(0).cast("bigint"))
    return tagged.withColumn("_chunk", chunk).drop("_cuts")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    peaks: dict[str, str] | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Running aggregates along ``order`` inside each group of ``by``.

    ``sums`` maps a new column to the column added up, the current row included; ``peaks`` maps a
    new column to the column whose maximum over the rows before the current one is wanted (null on
    the first row). ``order`` must name columns that are unique inside the group.
    """
    sums, peaks = sums or {}, peaks or {}
    by = list(by)
    tagged = with_chunk(df, by, order, range_rows)
    totals = tagged.groupBy(*by, "_chunk").agg(
        *[F.sum(src).alias(f"_s_{new}") for new, src in sums.items()],
        *[F.max(src).alias(f"_m_{new}") for new, src in peaks.items()],
    )
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_chunk",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
        *[F.max(f"_m_{c}").over(before).alias(f"_m_{c}") for c in peaks],
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = tagged.join(offsets, [*by, "_chunk"])
    return joined.select(
        *df.columns,
        *[(F.sum(src).over(upto) + F.col(f"_s_{new}")).alias(new) for new, src in sums.items()],
        *[
            F.greatest(F.max(src).over(earlier), F.col(f"_m_{new}")).alias(new)
            for new, src in peaks.items()
        ],
    )


def numbered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    range_rows: int | None = None,
) -> DataFrame:
    """Row numbers from 1 inside each group; ``order`` must be unique inside the group."""
    return running(
        df.withColumn("_one", F.lit(1).cast("bigint")), by, order, {name: "_one"}, range_rows=range_rows
    ).drop("_one")


def take_first(df: DataFrame, order: Sequence[str], n: int, small: int = 10_000) -> DataFrame:
    """The first n rows by a unique order. Large n is cut by rank instead of in one task."""
    if n <= small:
        return df.orderBy(*order).limit(n)
    return numbered(df, [], order, "_position").where(F.col("_position") <= n).drop("_position")


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Average ranks of the distinct values of a histogram (by, value, weight)."""
    ranked = running(df, by, [value], {"_upto": weight})
    return ranked.withColumn(
        "mid_rank", F.col("_upto") - F.col(weight) + (F.col(weight) + F.lit(1.0)) / 2
    ).drop("_upto")


def values_at_ranks(
    histogram: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str,
    ranks: dict[str, Column],
) -> DataFrame:
    """Values at 0-based ranks, one row per group with one column per rank.

    A rank is a column expression over ``total``, the group's row count. Only the ranges that hold
    a wanted rank are sorted.
    """
    by = list(by)
    tagged = with_chunk(histogram, by, [value])
    totals = tagged.groupBy(*by, "_chunk").agg(F.sum(weight).alias("_rows"))
    upto = Window.partitionBy(*by).orderBy("_chunk")
    spans = totals.select(
        *by,
        "_chunk",
        (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(upto).alias("_after"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("total"),
    )
    targets = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
                for name, rank in ranks.items()
            ]
        ),
        lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_after")),
    )
    wanted = spans.withColumn("_targets", targets).where(F.size("_targets") > 0)
    near = tagged.join(wanted, [*by, "_chunk"])
    inside = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = near.withColumn("_upto", F.col("_before") + F.sum(weight).over(inside))
    hits = placed.select(
        *by,
        value,
        F.explode(
            F.filter(
                "_targets",
                lambda t: (t["rank"] < F.col("_upto"))
                & (t["rank"] >= F.col("_upto") - F.col(weight)),
            )
        ).alias("_hit"),
    )
    return hits.groupBy(*by).agg(
        *[F.max(F.when(F.col("_hit.name") == name, F.col(value))).alias(name) for name in ranks]
    )
