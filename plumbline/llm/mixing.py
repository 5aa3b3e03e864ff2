"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of documents in seeded random order, served up to ``max_epochs`` times. A
document's virtual finish time is the number of words its source has sent when it is done, divided by
the source's weight. All queues together, in the order of finish times, are the mix; it is cut where
the next document would exceed the budget. Sources that run dry leave their share to the others by
weight, so the mix meets the water-filling targets to within about one document a source.

No queue is ever sorted in one task: a queue is cut into ranges of its random order, ranges are summed
first, and documents are numbered inside their range only. The place of the cut is found the same way,
from sums over intervals of finish time, and then document by document inside one interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import ROW, field, null_safe, packed, stored, unpacked, word_count

RANGE_ROWS = 2_000
DECLARED_WEIGHTS = (5, 2, 1)


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = DECLARED_WEIGHTS) -> DataFrame:
    """Weights dealt in turn to the rows of ``sources`` (source_key) in code point order, null last.

    One row per source: the single ordered task holds source names, never documents.
    """
    at = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights)
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sources.select("source_key", F.element_at(table, at + 1).alias("weight"))


def source_key(source: Column) -> Column:
    """A name that orders by code point with null last and never is null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">"))


def water_fill(sources: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """Targets: the budget by weight, none above ``max_epochs`` times its size, excess reshared.

    ``sources`` has (source_key, weight, source_size). Sources saturate in the order of capacity over
    weight, so one pass in that order finds the common level. Adds ``level`` (a target is the smaller
    of capacity and weight times level) and ``target``.
    """
    order = Window.orderBy(F.col("capacity") / F.col("weight"), "source_key")
    through = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    capped = sources.withColumn("capacity", F.col("source_size").cast("double") * max_epochs)
    tried = (budget - F.coalesce(F.sum("capacity").over(through), F.lit(0.0))) / F.sum("weight").over(from_here)
    levels = capped.withColumn("tried", tried)
    # tried levels rise up to the first source that is not filled, whose level holds, and fall after it
    open_from = F.max(F.when(F.col("tried") * F.col("weight") <= F.col("capacity"), F.col("tried"))).over(
        Window.partitionBy()
    )
    level = F.coalesce(open_from, F.max(F.col("capacity") / F.col("weight")).over(Window.partitionBy()))
    return levels.withColumn("level", level).select(
        "source_key",
        "weight",
        "source_size",
        "level",
        F.least("capacity", F.col("weight") * F.col("level")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: str | None = None,
    weights: DataFrame | None = None,
    budget: int | None = None,
    max_epochs: int = 3,
    seed: int = 0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Every input row with how often the mix takes it.

    Adds ``size`` (words of the text, or the column named by ``size``), ``source_size``, ``weight``,
    ``target``, ``copies`` (times taken, 0 to ``max_epochs``), ``taken`` (words taken, copies counted) and
    ``finish`` (virtual finish time of the first copy). ``weights`` has (source_key, weight); by default
    5, 2 and 1 are dealt in turn. ``budget`` defaults to all words. Sources missing from ``weights`` get
    nothing. Reruns agree: the order comes from a hash of seed and id.

    A null source is a source of its own, null text and null sizes count 0 words; rows without words
    are kept with 0 copies. Rows equal in id, source, size and text are taken together. An empty table
    gives no rows. Input columns with the names of added ones are kept as ``<name>_in``.
    """
    names = docs.columns
    row_size = F.coalesce(field(size).cast("long"), F.lit(0).cast("long")) if size else word_count(field(text))
    content = F.xxhash64(field(text)) if text in names else F.lit(0).cast("long")
    keyed = packed(docs).select(
        ROW,
        field(id_col).cast("string").alias("k_id"),
        source_key(field(source)).alias("k_source"),
        row_size.alias("k_size"),
        content.alias("k_content"),
    )
    keys = ["k_id", "k_source", "k_size", "k_content"]
    ledger = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("k_id", F.lit(""))))
    ledger = stored(
        ledger.withColumn("digest", digest).withColumn(
            "draw", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
        ),
        "mix-ledger",
    )
    planned = stored(_finish_times(ledger, weights, budget, max_epochs, range_rows), "mix-plan")
    cut = _cut(planned, budget, max_epochs, range_rows)
    copies = F.lit(0)
    for epoch in range(1, max_epochs + 1):
        copies = copies + F.when(_before(epoch, cut), 1).otherwise(0)
    copies = F.when(F.col("weight").isNull() | (F.col("k_size") <= 0), 0).otherwise(copies)
    decided = planned.select(
        *keys,
        F.col("source_size"),
        F.col("weight"),
        F.col("target"),
        copies.cast("int").alias("copies"),
        F.col("finish"),
    )
    left, right = keyed.alias("d"), decided.alias("p")
    joined = left.join(
        right, null_safe([F.col(f"d.{k}") for k in keys], [F.col(f"p.{k}") for k in keys]), "inner"
    ).select(
        ROW,
        F.col("d.k_size").alias("size"),
        "source_size",
        "weight",
        "target",
        "copies",
        (F.col("copies") * F.col("d.k_size")).cast("long").alias("taken"),
        "finish",
    )
    added = ["size", "source_size", "weight", "target", "copies", "taken", "finish"]
    return joined.select(*unpacked(joined, names, added))


def in_mix_order(mixed: DataFrame, names: list[str], max_epochs: int = 3) -> DataFrame:
    """The mix itself: the named columns, one row per taken copy, range-sorted by finish time."""
    step = F.col("source_size") / F.col("weight")
    return (
        mixed.where(F.col("copies") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("epoch_finish", F.col("finish") + (F.col("epoch") - 1) * step)
        .orderBy("epoch_finish", "epoch")
        .select(*[F.col(f"`{n}`") for n in names])
    )


def _finish_times(
    ledger: DataFrame, weights: DataFrame | None, budget: int | None, max_epochs: int, range_rows: int
) -> DataFrame:
    count = ledger.agg(F.count(F.lit(1))).first()[0]
    ranges = max(1, -(-count // range_rows))
    cut_to_ranges = ledger.withColumn("words", F.col("k_size") * F.col("rows")).withColumn(
        "part", F.shiftright(F.col("draw") * ranges, 32)
    )
    sums = cut_to_ranges.groupBy("k_source", "part").agg(F.sum("words").alias("part_words"))
    by_source = Window.partitionBy("k_source")
    before = by_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "k_source",
        "part",
        F.coalesce(F.sum("part_words").over(before), F.lit(0)).alias("offset"),
        F.sum("part_words").over(by_source).alias("source_size"),
    )
    sources = offsets.select(F.col("k_source").alias("source_key"), "source_size").distinct()
    weights = cycle_weights(sources) if weights is None else weights
    weighted = sources.join(weights.select("source_key", F.col("weight").cast("double")), "source_key")
    total = F.sum("source_size").over(Window.partitionBy()) if budget is None else F.lit(budget)
    targets = water_fill(weighted.where(F.col("weight") > 0), total.cast("double"), max_epochs)
    offsets = offsets.join(
        targets.select(F.col("source_key").alias("k_source"), "weight", "level", "target"), "k_source", "left"
    )
    inside = Window.partitionBy("k_source", "part").orderBy("draw", "digest", "k_id", "k_size", "k_content")
    sent = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        cut_to_ranges.withColumn("sent", sent)
        .join(offsets, ["k_source", "part"])
        .withColumn("sent", F.col("offset") + F.col("sent"))
        .withColumn("target", F.coalesce("target", F.lit(0.0)))
        .withColumn("finish", F.col("sent") / F.col("weight"))
        .drop("offset", "part")
    )


def _served(epoch: Column) -> Column:
    return (F.col("sent") + (epoch - 1) * F.col("source_size")) / F.col("weight")


def _rank(at: Column, epoch: Column) -> Column:
    return F.struct(
        at.alias("at"),
        F.col("k_source"),
        epoch.cast("int").alias("epoch"),
        F.col("digest"),
        F.coalesce("k_id", F.lit("")).alias("k_id"),
        F.col("k_size"),
        F.col("k_content"),
    )


def _before(epoch: int, cut: dict | None) -> Column:
    """Is this copy served before the first one that no longer fits?"""
    if cut is None:
        return F.lit(True)
    if not cut:
        return F.lit(False)
    limit = F.struct(
        F.lit(cut["at"]).cast("double").alias("at"),
        F.lit(cut["k_source"]).alias("k_source"),
        F.lit(cut["epoch"]).cast("int").alias("epoch"),
        F.lit(cut["digest"]).alias("digest"),
        F.lit(cut["k_id"]).alias("k_id"),
        F.lit(cut["k_size"]).cast("long").alias("k_size"),
        F.lit(cut["k_content"]).cast("long").alias("k_content"),
    )
    return _rank(_served(F.lit(epoch)), F.lit(epoch)) < limit


def _cut(planned: DataFrame, budget: int | None, max_epochs: int, range_rows: int) -> dict | None:
    """The first copy in the order of finish times that the budget does not hold; one row.

    None if all copies fit, empty if none does.
    """
    served = (
        planned.where(F.col("weight").isNotNull() & (F.col("words") > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs))))
        .withColumn("at", _served(F.col("epoch")))
    )
    facts = planned.agg(
        F.count(F.lit(1)), F.max("level"), F.sum("words").cast("long")
    ).first()
    if not facts[1]:
        return {}
    budget = facts[2] if budget is None else budget
    width = facts[1] / max(1, -(-facts[0] // range_rows))
    interval = F.floor(F.col("at") / width)
    sums = served.groupBy(interval.alias("interval")).agg(F.sum("words").alias("words"))
    running = F.sum("words").over(Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, 0))
    over = (
        sums.withColumn("running", running)
        .where(F.col("running") > budget)
        .orderBy("interval")
        .select("interval", (F.col("running") - F.col("words")).alias("before"))
        .first()
    )
    if over is None:
        return None
    order = _rank(F.col("at"), F.col("epoch"))
    inside = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first = (
        served.where(interval == over["interval"])
        .select(order.alias("rank"), "words")
        .withColumn("running", F.sum("words").over(inside) + F.lit(over["before"]))
        .where(F.col("running") > budget)
        .orderBy("rank")
        .select("rank.*")
        .first()
    )
    return first.asDict()
