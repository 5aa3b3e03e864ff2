"""Exact dedup by deterministic block naming.

Texts are cut into blocks of fixed size. Equal blocks get one integer name by sorting: a name says in
which range of the name space a block was sorted and which place it took there, so different blocks
have different names whatever their hashes are. Adjacent names are then named in pairs, and those names
in pairs again, until each text has one name, its identity. Hashes only decide where work is done.

A block or pair that very many rows share is spread over several tasks: each ranks its part, and only
the distinct contents of those parts meet again. The list of such blocks is bounded (one entry has at
least the ``hot_share`` of all blocks) and is the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import ROW, ascii_lower, field, null_safe, packed, stored, text_or_empty, unpacked

BLOCK_BYTES = 16_384
NAME_RANGES = 1 << 20
RANK_BITS = 42  # name = range * 2^42 + place; the bit below separates spread blocks from the others
SPREAD_BIT = 41
HOT_SHARE = 1 / 4096


def normalised(text: Column) -> Column:
    """What texts are compared by: null as empty, A-Z lower-cased, nothing else."""
    return ascii_lower(text_or_empty(text))


def _blocks(text: Column, block_bytes: int) -> Column:
    """A text's UTF-8 bytes in fixed-size blocks; the empty text is one empty block."""
    data = text.cast("binary")
    count = F.greatest(F.ceil(F.octet_length(text) / block_bytes), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)),
    )


def _range(hash_of_content: Column) -> Column:
    return F.pmod(hash_of_content, F.lit(NAME_RANGES)).cast("long")


def _name(space: Column, spread: Column, place: Column) -> Column:
    flag = F.when(spread, F.lit(1 << SPREAD_BIT)).otherwise(F.lit(0)).cast("long")
    return space * F.lit(1 << RANK_BITS) + flag + place.cast("long")


def name_blocks(
    docs: DataFrame, ids: DataFrame, block_bytes: int, hot_share: float, fewest_hot: int
) -> DataFrame:
    """(k_id, k_sha, blocks, at, name): one row per block of every text; ``blocks`` counts them.

    ``docs`` has (k_id, k_sha, norm), ``ids`` the narrow (k_id, k_sha, hashes) of the same rows.
    """
    hashes = ids.select(F.explode("hashes").alias("h"))
    least = max(fewest_hot, int(hot_share * (ids.agg(F.sum(F.size("hashes"))).first()[0] or 0)))
    # at most 1 / hot_share rows: each holds that share of all blocks
    hot = (
        hashes.groupBy("h")
        .count()
        .where(F.col("count") > least)
        .select("h", F.ceil(F.col("count") / least).alias("parts"))
    )
    blocks = _blocks(F.col("norm"), block_bytes)
    cut = docs.select("k_id", "k_sha", F.size(blocks).alias("blocks"), F.posexplode(blocks).alias("at", "block"))
    rows = (
        cut.withColumn("h", F.xxhash64("block"))
        .join(F.broadcast(hot), "h", "left")
        .withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("k_id", "k_sha"), F.col("parts"))))
        .withColumn("space", _range(F.col("h")))
        .drop("h", "parts")
    )
    sort = Window.partitionBy("space", "part").orderBy("block")
    spread = F.col("part").isNotNull()
    new = F.col("before").isNull() | (F.col("before") != F.col("place"))
    placed = rows.withColumn("place", F.dense_rank().over(sort)).withColumn("before", F.lag("place").over(sort))
    placed = stored(
        placed.withColumn("content", F.when(spread & new, F.col("block"))).drop("block", "before"), "block-names"
    )
    again = Window.partitionBy("space").orderBy("content")
    merged = (
        placed.where(F.col("content").isNotNull())
        .select("space", "part", "place", F.dense_rank().over(again).alias("merged"))
    )
    return placed.join(merged, ["space", "part", "place"], "left").select(
        "k_id",
        "k_sha",
        "blocks",
        "at",
        F.when(F.col("part").isNull(), _name(F.col("space"), F.lit(False), F.col("place")))
        .otherwise(_name(F.col("space"), F.lit(True), F.col("merged")))
        .alias("name"),
    )


def name_pairs(names: DataFrame) -> DataFrame:
    """One level up: each adjacent pair of names gets one name, a last single one pairs with nothing.

    Pairs are made distinct before they are sorted, so equal pairs never gather.
    """
    side = F.col("at") % 2
    pairs = names.groupBy("k_id", "k_sha", "blocks", F.shiftright("at", 1).alias("at")).agg(
        F.max(F.when(side == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = stored(pairs, "name-pairs")
    distinct = pairs.select("left", "right").distinct().withColumn("space", _range(F.xxhash64("left", "right")))
    sort = Window.partitionBy("space").orderBy("left", "right")
    named = distinct.select(
        "left", "right", _name(F.col("space"), F.lit(False), F.row_number().over(sort)).alias("name")
    )
    return pairs.join(named, ["left", "right"]).select("k_id", "k_sha", "blocks", "at", "name")


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hot_share: float = HOT_SHARE,
    fewest_hot: int = 1000,
) -> DataFrame:
    """(k_id, k_sha, rows, blocks, name): one row per id and normalised text.

    Two texts are equal exactly if ``blocks`` and ``name`` are. ``rows`` counts input rows with that id
    and text. ``k_sha`` is the digest of the normalised text, carried for the reader, never compared
    between ids.
    """
    docs = docs.select(F.col(id_col).alias("k_id"), normalised(F.col(text)).alias("norm"))
    keyed = docs.withColumn("k_sha", F.sha2("norm", 256))
    hashes = F.transform(_blocks(F.col("norm"), block_bytes), lambda b: F.xxhash64(b))
    ids = stored(
        keyed.select("k_id", "k_sha", hashes.alias("hashes")), "dedup-ids"
    )
    names = name_blocks(keyed, ids, block_bytes, hot_share, fewest_hot)
    widest = ids.agg(F.max(F.size("hashes"))).first()[0] or 0
    rows = ids.groupBy("k_id", "k_sha").agg(F.count(F.lit(1)).alias("rows"))
    level = stored(names.distinct(), "block-names")
    done = level.where("blocks = 1")
    width = 1
    while width < widest:
        width *= 2
        level = stored(name_pairs(level.where(F.col("blocks") > width // 2)), "pair-names")
        done = done.unionByName(level.where(F.col("blocks") <= width))
    left, right = rows.alias("s"), done.alias("n")
    return left.join(
        right,
        null_safe([F.col("s.k_id"), F.col("s.k_sha")], [F.col("n.k_id"), F.col("n.k_sha")]),
    ).select("s.k_id", "s.k_sha", "rows", "n.blocks", "n.name")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of texts equal after lower-casing A-Z, the row with the largest id stays; null text counts as empty
    and a null id is the smallest. Of fully repeated rows exactly one is marked as kept. Other columns
    are ignored; an empty table gives no rows.
    """
    found = stored(identities(docs, id_col, text, **options), "identities")
    # written before the join, which then can split a group that holds very many rows
    groups = stored(
        found.groupBy("blocks", "name").agg(F.max("k_id").alias("keep_id"), F.sum("rows").alias("group_size")),
        "groups",
    )
    return (
        found.join(groups, ["blocks", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select(
            F.col("k_id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("k_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("k_sha").alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = (
        duplicate_report(docs, id_col, text, **options)
        .where("kept")
        .select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    )
    rows = packed(docs).select(
        ROW, field(id_col).alias("k_id"), F.sha2(normalised(field(text)), 256).alias("k_sha")
    )
    stay = rows.alias("d").join(
        kept.alias("k"),
        null_safe([F.col("d.k_id"), F.col("d.k_sha")], [F.col("k.k_id"), F.col("k.k_sha")]),
        "left_semi",
    )
    one = Window.partitionBy("k_id", "k_sha").orderBy(field(text))
    stay = stay.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return stay.select(*unpacked(stay, docs.columns, []))
