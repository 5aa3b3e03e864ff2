"""Bootstrap intervals for grouped means, paired differences and clustered ratios.

Rows are first counted into cells of equal value, which shrinks 0/1 flags and rounded scores to a
handful of rows whatever the table size. The method is the same for every group: multinomial draws over
its cells. The cells of a group are dealt into blocks; a replicate's total is split over the blocks by
binomial draws down a tree, which every block repeats for its own path alone, and then over the cells
of the block. That is one multinomial draw, made without gathering the group; only the replicate totals
meet, in two steps. A block gets its path, two numbers per level of the tree, once; its cells carry nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from plumbline.functions.intervals import z_value
from plumbline.functions.numerics import NORMAL
from plumbline.operators.ordered import numbered
from plumbline.session import cut_lineage

RESAMPLES = 10_000
BLOCK_CELLS = 4096
DRAW_BLOCK = 2_000_000
UNIT_DRAWS = 131_072  # drawn at once, so that they stay in a core's cache
FEW_UNITS = 6  # up to so many units a cell, drawing units costs less than a binomial per cell


def _moments(x: np.ndarray, size: np.ndarray, count: np.ndarray) -> dict[str, float]:
    n = float((size * count).sum())
    mean = float((x * count).sum() / n)
    spread = x - mean * size
    return {
        "n": n,
        "mean": mean,
        "square": float((count * spread**2).sum()),
        "cube": float((count * spread**3).sum()),
        "low": float(x.min()),
        "high": float(x.max()),
        "flags": bool(np.isin(x, (0.0, 1.0)).all()),
    }


def _generator(seed: int, *place: int) -> np.random.Generator:
    return np.random.default_rng([seed % 2**63, *(p % 2**63 for p in place)])


def _block_units(path: Sequence[dict], total: int, resamples: int, seed: int, group: int) -> np.ndarray:
    """How many units each replicate draws from one block, given the nodes from the root to it."""
    units = np.full(resamples, total, np.int64)
    for node in path:
        left, whole = node["left"], node["whole"]
        # the draw belongs to the node, so all blocks below it see the same numbers
        drawn = _generator(seed, group, 1, node["lo"], node["hi"]).binomial(units, left / whole if whole else 0.0)
        units = drawn if node["goes_left"] else units - drawn
    return units


def _unit_sums(
    x: np.ndarray, size: np.ndarray, count: np.ndarray, units: np.ndarray, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """The same sums where most cells stand for few units: every unit drawn by its number, all equally likely."""
    count = count.astype(np.int64)
    whole = int(count.sum())
    x, size = np.repeat(x, count), np.repeat(size, count)
    even = bool((size == size[0]).all())
    step = max(1, UNIT_DRAWS // whole)
    top, bottom = np.zeros(len(units)), units * size[0] if even else np.zeros(len(units))
    for start in range(0, len(units), step):
        many = units[start : start + step]
        at = rng.integers(0, whole, int(many.sum()))
        some = np.flatnonzero(many)  # reduceat would give an empty stretch its next value
        if not len(some):
            continue
        begins = (np.cumsum(many) - many)[some]
        top[start + some] = np.add.reduceat(x[at], begins)
        if not even:
            bottom[start + some] = np.add.reduceat(size[at], begins)
    return top, bottom


def _block_sums(
    x: np.ndarray, size: np.ndarray, count: np.ndarray, units: np.ndarray | int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate the sums of x and of size over the units drawn from a block's cells.

    ``units`` is what each replicate draws from the block; a plain number of replicates asks for Poisson weights instead: each
    unit counts Poisson(1) times, a cell of equal units as often as the Poisson number of their count.
    """
    if not isinstance(units, int) and count.sum() <= FEW_UNITS * len(count):
        return _unit_sums(x, size, count, units, rng)
    share = count / count.sum()
    resamples = units if isinstance(units, int) else len(units)
    step = max(1, DRAW_BLOCK // len(x))
    top, bottom = [], []
    for start in range(0, resamples, step):
        if isinstance(units, int):
            weights = rng.poisson(count, (min(step, resamples - start), len(count)))
        else:
            weights = rng.multinomial(units[start : start + step], share)
        top.append(weights @ x)
        bottom.append(weights @ size)
    return np.concatenate(top), np.concatenate(bottom)


def _wilson(successes: float, n: float, confidence: float) -> tuple[float, float]:
    z = z_value(confidence)
    p = successes / n
    bottom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / bottom
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / bottom
    return max(0.0, centre - half), min(1.0, centre + half)


def bca_limits(
    replicates: np.ndarray, moments: dict[str, float], confidence: float
) -> tuple[float, float, str]:
    """Bias-corrected and accelerated limits; ties with the estimate count half."""
    n, mean = moments["n"], moments["mean"]
    if n < 3 or np.allclose([moments["low"], moments["high"]], moments["low"]):
        if moments["flags"]:
            return *_wilson(mean * n, n, confidence), "wilson"
        return mean, mean, "degenerate"
    tail = (1 - confidence) / 2
    below = ((replicates < mean).mean() + (replicates <= mean).mean()) / 2
    if 0.0 < below < 1.0 and moments["square"] > 0:
        bias = NORMAL.inv_cdf(float(below))
        acceleration = moments["cube"] / (6 * moments["square"] ** 1.5)
        limits = []
        for z in (NORMAL.inv_cdf(tail), NORMAL.inv_cdf(1 - tail)):
            shifted = bias + (bias + z) / (1 - acceleration * (bias + z))
            limits.append(np.quantile(replicates, NORMAL.cdf(shifted)))
        if np.isfinite(limits).all():
            return float(limits[0]), float(limits[1]), "bca"
    low, high = np.quantile(replicates, [tail, 1 - tail])
    return float(low), float(high), "percentile"


def _bca_row(reps: np.ndarray, moments: dict[str, float], confidence: float) -> list:
    low, high, method = bca_limits(reps, moments, confidence)
    return [moments["mean"], low, high, int(moments["n"]), method, confidence]


def _paired_row(reps: np.ndarray, moments: dict[str, float], confidence: float) -> list:
    tail = (1 - confidence) / 2
    low, high = np.quantile(reps, [tail, 1 - tail])
    centred = np.abs(reps - reps.mean())
    p = float((centred >= abs(moments["mean"])).mean())
    return [moments["mean"], float(low), float(high), p, int(moments["n"]), bool(low > 0 or high < 0)]


def _poisson_row(reps: np.ndarray, moments: dict[str, float], confidence: float) -> list:
    tail = (1 - confidence) / 2
    low, high = np.quantile(reps, [tail, 1 - tail]) if len(reps) else (None, None)
    return [moments["mean"], low, high]


def _ratio_row(reps: np.ndarray, moments: dict[str, float], confidence: float) -> list:
    tail = (1 - confidence) / 2
    low, high = np.quantile(reps, [tail, 1 - tail])
    return [moments["mean"], float(low), float(high), int(moments["n"]), int(moments["units"])]


def _field(name: str, kind) -> StructField:
    return StructField(name, kind, True)


FINISHERS = {
    "bca": (
        _bca_row,
        [
            _field("value", DoubleType()),
            _field("lo", DoubleType()),
            _field("hi", DoubleType()),
            _field("n", LongType()),
            _field("method", StringType()),
            _field("confidence", DoubleType()),
        ],
    ),
    "paired": (
        _paired_row,
        [
            _field("diff", DoubleType()),
            _field("lo", DoubleType()),
            _field("hi", DoubleType()),
            _field("p_value", DoubleType()),
            _field("n", LongType()),
            _field("significant", BooleanType()),
        ],
    ),
    "poisson": (
        _poisson_row,
        [_field("value", DoubleType()), _field("lo", DoubleType()), _field("hi", DoubleType())],
    ),
    "ratio": (
        _ratio_row,
        [
            _field("value", DoubleType()),
            _field("lo", DoubleType()),
            _field("hi", DoubleType()),
            _field("n_rows", LongType()),
            _field("n_clusters", LongType()),
        ],
    ),
}


def _attached(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """The rows with their group's facts; without groups the one row of facts is a scalar."""
    names = [c for c in facts.columns if c not in by]
    if by:
        return rows.join(facts, by)
    one = facts.select(F.struct(*names)).scalar()
    return rows.withColumn("_facts", one).select("*", "_facts.*").drop("_facts")


def _paths(filled: DataFrame, by: list[str]) -> DataFrame:
    """(by, _block, place, path) for blocks (by, _block, _units): the nodes from the root of the group's tree to each block.

    A node is a run of blocks [lo, hi), split in the middle. Nodes are summed level by level and meet their blocks by their
    borders, so a row holds as many nodes as the tree is deep.
    """
    placed = numbered(filled, by, ["_block"], "_place").withColumn("_place", F.col("_place") - 1)
    counts = filled.groupBy(*by).agg(F.count(F.lit(1)).alias("_many"))
    placed = _attached(placed, counts, by)
    node = "struct<level:int,lo:bigint,hi:bigint>"

    def deeper(way: Column, level: Column) -> Column:
        last = F.element_at(way, -1)
        middle = F.floor((last["lo"] + last["hi"]) / 2)
        left = F.col("_place") < middle
        below = F.struct(
            level.cast("int").alias("level"),
            F.when(left, last["lo"]).otherwise(middle).alias("lo"),
            F.when(left, middle).otherwise(last["hi"]).alias("hi"),
        )
        return F.when(last["hi"] - last["lo"] > 1, F.array_append(way, below.cast(node))).otherwise(way)

    root = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("lo"), F.col("_many").alias("hi")).cast(node))
    depth = F.greatest(F.ceil(F.log2("_many")).cast("int"), F.lit(0)) + 1
    way = F.aggregate(F.sequence(F.lit(1), depth), root, deeper)
    steps = placed.select(*by, "_block", "_place", "_units", F.inline(way))
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    nodes = (
        steps.where("hi - lo > 1")
        .groupBy(*by, "lo", "hi")
        .agg(F.sum(F.when(F.col("_place") < middle, F.col("_units")).otherwise(0)).alias("left"), F.sum("_units").alias("whole"))
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*by, "lo", "hi")]
    met = steps.alias("s").join(nodes.alias("n"), reduce(and_, same), "left").select(
        *[F.col(f"s.{c}") for c in (*by, "_block", "_place", "level", "lo", "hi")], "left", "whole", (F.col("s._place") < F.floor((F.col("s.lo") + F.col("s.hi")) / 2)).alias("goes_left")
    )
    entry = F.when(F.col("whole").isNotNull(), F.struct("level", "lo", "hi", "left", "whole", "goes_left"))
    return met.groupBy(*by, "_block", F.col("_place").alias("place")).agg(F.array_sort(F.collect_list(entry)).alias("path"))


def _resampled(
    cells: DataFrame, by: Sequence[str], kind: str, resamples: int, confidence: float, seed: int, block_cells: int
) -> DataFrame:
    """Intervals for cells (by, x, size, count) of the statistic sum(x) / sum(size)."""
    by = list(by)
    finish, fields = FINISHERS[kind]
    cells = cut_lineage(cells)  # counted once, read for sizes, moments, paths and draws
    units = F.sum("count").cast("long")
    sized = cells.groupBy(*by).agg(
        F.ceil(F.count(F.lit(1)) / block_cells).alias("_blocks"),
        F.sum(F.col("size") * F.col("count")).alias("n"),
        (F.sum(F.col("x") * F.col("count")) / F.sum(F.col("size") * F.col("count"))).alias("mean"),
        units.alias("units"),
    )
    joined = _attached(cells, sized, by).withColumn(
        "_block", F.pmod(F.xxhash64("x", "size"), F.col("_blocks"))
    )
    centred = F.col("x") - F.col("mean") * F.col("size")
    moments = joined.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("n", "mean", "units")],
        F.sum(F.col("count") * centred * centred).alias("square"),
        F.sum(F.col("count") * centred * centred * centred).alias("cube"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.min(F.col("x").isin(0.0, 1.0)).alias("flags"),
    )
    # a block is little data and much work: as many partitions as there is work, which adaptive execution must not merge
    deals = max(1, math.ceil(cells.count() / BLOCK_CELLS))
    filled = joined.groupBy(*by, "_block").agg(units.alias("_units"))
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    blocks = _attached(_paths(filled, by), sized.select(*by, "_blocks", F.col("units").alias("total")), by).select(
        *[F.col(c).alias(f"_of_{c}") for c in by], F.col("_block").alias("_own"), F.pmod("_block", F.ceil(F.sqrt("_blocks"))).alias("_lane"), "place", "path", "total", group.alias("group")
    )
    dealt = joined.select(*by, "_block", "x", "size", F.col("count").cast("long").alias("count"))
    key_fields = [cells.schema[c] for c in by]
    sums_schema = StructType(
        key_fields + [_field("_lane", LongType()), _field("_top", BinaryType()), _field("_bottom", BinaryType())]
    )

    def draw(cell: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        named, first = cell.iloc[0], block.iloc[0]
        if cell["x"].isna().any():
            raise ValueError("a paired test needs both values in every row")
        cell = cell.sort_values(["x", "size"])
        x, size, count = (cell[c].to_numpy(dtype=float) for c in ("x", "size", "count"))
        place, own = int(first["place"]), int(first["group"])
        if kind == "poisson":
            drawn = resamples
        else:
            drawn = _block_units(first["path"], int(first["total"]), resamples, seed, own)
        top, bottom = _block_sums(x, size, count, drawn, _generator(seed, own, 2, place))
        return pd.DataFrame(
            [[*(named[c] for c in by), first["_lane"], top.tobytes(), bottom.tobytes()]],
            columns=[*by, "_lane", "_top", "_bottom"],
        )

    def add(part: pd.DataFrame) -> pd.DataFrame:
        out = part.iloc[:1].copy()
        for c in ("_top", "_bottom"):
            out[c] = [sum(np.frombuffer(v) for v in part[c]).tobytes()]
        return out

    def conclude(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, row in batch.iterrows():
                top, bottom = np.frombuffer(row["_top"]), np.frombuffer(row["_bottom"])
                facts = {k: row[k] for k in ("n", "mean", "units", "square", "cube", "low", "high", "flags")}
                rows.append([row[c] for c in by] + finish(top[bottom > 0] / bottom[bottom > 0], facts, confidence))
            yield pd.DataFrame(rows, columns=by + [f.name for f in fields])

    of = [f"_of_{c}" for c in by]
    ours = dealt.repartition(deals, *by, "_block").groupBy(*by, "_block")
    theirs = blocks.repartition(deals, *of, "_own").groupBy(*of, "_own")
    by_block = ours.cogroup(theirs).applyInPandas(draw, sums_schema)
    by_lane = by_block.groupBy(*by, "_lane").applyInPandas(add, sums_schema)
    whole = by_lane.groupBy(*by).applyInPandas(add, sums_schema).drop("_lane")
    return _attached(whole, moments, by).mapInPandas(conclude, StructType(key_fields + fields))


def _rows(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def bootstrap_ci(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    block_cells: int = BLOCK_CELLS,
    weight: str | None = None,
) -> DataFrame:
    """BCa interval of a mean per group. ``weight`` says how many rows a row stands for.

    Constant or tiny groups get a Wilson interval if their values are 0/1, else the point itself.
    ``block_cells`` bounds the values drawn from in one task; it changes the draws, not the method.
    """
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("x"))
        .agg(_rows(weight).alias("count"))
        .withColumn("size", F.lit(1.0))
    )
    return _resampled(cells, by, "bca", resamples, confidence, seed, block_cells)


def paired_diff(
    df: DataFrame,
    by: Sequence[str],
    a: str,
    b: str,
    resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    block_cells: int = BLOCK_CELLS,
    weight: str | None = None,
) -> DataFrame:
    """Mean of a - b with the pairing kept, percentile limits and a centred two-sided p-value.

    A row with only one of the two values is an error; a row with neither is ignored.
    """
    present = F.col(a).isNotNull() | F.col(b).isNotNull()
    cells = (
        df.where(present)
        .groupBy(*by, (F.col(a).cast("double") - F.col(b).cast("double")).alias("x"))
        .agg(_rows(weight).alias("count"))
        .withColumn("size", F.lit(1.0))
    )
    return _resampled(cells, by, "paired", resamples, confidence, seed, block_cells)


def cluster_cells(df: DataFrame, by: Sequence[str], cluster: str, value: str) -> DataFrame:
    clusters = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, cluster)
        .agg(
            F.sum(F.col(value).cast("double")).alias("x"),
            F.count(F.lit(1)).cast("double").alias("size"),
        )
    )
    return clusters.groupBy(*by, "x", "size").agg(F.count(F.lit(1)).alias("count"))


def cluster_ci(
    df: DataFrame,
    by: Sequence[str],
    cluster: str,
    value: str,
    resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 20260731,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Percentile interval of a ratio of totals when whole clusters are resampled."""
    cells = cluster_cells(df, by, cluster, value)
    return _resampled(cells, by, "ratio", resamples, confidence, seed, block_cells)


def poisson_ci(
    units: DataFrame,
    by: Sequence[str],
    unit: str,
    x: Column,
    size: Column,
    resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Percentile interval of sum(x) / sum(size) when each unit counts Poisson(1) times.

    Rows are added up per unit, and units with equal sums are one cell, whose weight is one Poisson draw with their
    count as mean. Draws of different cells do not depend on each other, so blocks need no tree.
    """
    by = list(by)
    named = units.select(*by, F.col(unit).alias("_unit"), x.cast("double").alias("x"), size.cast("double").alias("size"))
    summed = named.groupBy(*by, "_unit").agg(F.sum("x").alias("x"), F.sum("size").alias("size"))
    cells = summed.groupBy(*by, "x", "size").agg(F.count(F.lit(1)).alias("count"))
    return _resampled(cells, by, "poisson", resamples, confidence, seed, block_cells)
