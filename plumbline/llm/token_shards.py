"""Token-id shards in training order.

Token sequences are cut into records of a fixed number of tokens. A keyed Feistel permutation, walked
along its cycles until it lands inside the range, gives record number i its global slot: a random order
of all records that needs no sorting key per record, is the same in every run, and can be inverted. Slots
are cut into shards; a shard is one file of records of equal length in slot order, so a reader finds
slot s at a byte offset, reads on from there, and can resume at any slot.

The files are padded, so they are most of the disk that this takes. Beside them there is one compressed copy
of the tokens at a time, and the shuffle of one wave of shards.

A record is 16 bytes of head (id, part, number of tokens; big-endian), the token ids (little-endian, 1,
2 or 4 bytes each, zero padded) and one line end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import field, packed, remove_stored, shared_path, shuffles_removed
from plumbline.llm.hashing import draws, mix

HEAD_BYTES = 16
RECORD_TOKENS = 2048
SHARD_BYTES = 16 << 20
NUMBER_ROWS = 2_000
WAVES = 8
WAVE_SHARDS = 8
PAGE_ROWS = 500
ROUNDS = 6


class SlotPermutation:
    """A keyed permutation of 0 to size - 1, either way, for whole arrays."""

    def __init__(self, size: int, key: int) -> None:
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = draws(key, ROUNDS)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._forward)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._backward)

    def _walk(self, values: np.ndarray, step) -> np.ndarray:
        out = step(values.astype(np.uint64))
        outside = np.flatnonzero(out >= np.uint64(self.size))
        while len(outside):
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def _forward(self, values: np.ndarray) -> np.ndarray:
        left, right = values >> np.uint64(self.half), values & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix(right ^ key) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _backward(self, values: np.ndarray) -> np.ndarray:
        left, right = values >> np.uint64(self.half), values & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (mix(left ^ key) & self.mask), left
        return (left << np.uint64(self.half)) | right


def record_bytes(record_tokens: int = RECORD_TOKENS, token_bytes: int = 1) -> int:
    """Distance between the starts of two records."""
    return HEAD_BYTES + record_tokens * token_bytes + 1


def training_order(
    docs: DataFrame,
    ids: str = "ids",
    id_col: str = "doc_id",
    token_bytes: int = 4,
    record_tokens: int = RECORD_TOKENS,
    shard_bytes: int = SHARD_BYTES,
    key: int = 0,
) -> DataFrame:
    """One row per record, in partitions of whole shards in slot order.

    ``ids`` is a binary column of little-endian token ids. Columns: ``doc_id``, ``part`` (from 0),
    ``n_tokens``, ``slot`` (0 to the number of records - 1, each once), ``shard``, ``offset`` (byte in its
    shard file), ``record`` (bytes without the line end).

    A row without tokens (null or empty) has one empty record. A null id is written as the smallest
    64-bit integer. Repeated rows have records of their own. Other columns are ignored; an empty table
    gives no rows. The ids have to be integers.

    ``docs`` is read once, by this call. The records are stored in the shared folder with their slots, in slot
    order per file, and the frame reads them from there.
    """
    spark = docs.sparkSession
    size = record_tokens * token_bytes
    stride = record_bytes(record_tokens, token_bytes)
    per_shard = max(1, shard_bytes // stride)
    data = F.coalesce(field(ids), F.lit(b""))
    parts = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("long")
    rows = packed(docs).select(field(id_col).cast("long").alias("k_id"), data.alias("data"), parts.alias("parts"))
    rows = rows.withColumn("draw", F.xxhash64("k_id", "data"))
    given = shared_path(spark, "token-ids")
    rows = _compressed(rows, given)  # numbering reads them more than once
    facts = rows.agg(F.sum("parts"), F.count(F.lit(1))).first()
    total, ranges = facts[0] or 0, max(1, -(-facts[1] // NUMBER_ROWS))
    # records are numbered inside ranges of equal hash, after the ranges' own totals
    ranged = rows.withColumn("range", F.pmod("draw", F.lit(ranges)))
    starts = ranged.groupBy("range").agg(F.sum("parts").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy("draw", "k_id", "data").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        ranged.withColumn("first", F.coalesce(F.sum("parts").over(inside), F.lit(0)))
        .join(starts, "range")
        .select(
            "k_id", "data", (F.col("start") + F.col("first")).alias("first"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        )
        .select(
            "k_id",
            "part",
            (F.col("first") + F.col("part")).alias("number"),
            F.substring("data", (F.col("part") * size + 1).cast("int"), F.lit(size)).alias("tokens"),
        )
    )
    order = SlotPermutation(max(total, 1), key)

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(order.slots(numbers.to_numpy()))

    placed = numbered.withColumn("slot", slot_of("number")).withColumn("shard", F.expr(f"slot div {per_shard}"))
    with shuffles_removed(spark):
        placed = _compressed(placed.drop("number").sortWithinPartitions("slot"), shared_path(spark, "token-records"))
    remove_stored(spark, given)
    sorted_ = placed.repartitionById(max(1, -(-total // per_shard)), F.col("shard").cast("int"))
    sorted_ = sorted_.sortWithinPartitions("shard", "slot")
    count = (F.octet_length("tokens") / token_bytes).cast("long")
    known = F.coalesce("k_id", F.lit(-(1 << 63)).cast("long"))
    head = F.concat(_wide(known, 16), _wide(F.col("part"), 8), _wide(count, 8))
    return sorted_.select(
        F.col("k_id").alias("doc_id"),
        "part",
        count.alias("n_tokens"),
        "slot",
        "shard",
        ((F.col("slot") % per_shard) * stride).alias("offset"),
        F.concat(head, F.rpad("tokens", F.lit(size), F.lit(b"\x00"))).alias("record"),
    )


def _compressed(df: DataFrame, path: str) -> DataFrame:
    # a filter skips pages, which have 20,000 rows otherwise
    df.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _wide(value: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), digits, "0"))


def write_shards(records: DataFrame, path: str | None = None) -> str:
    """Writes each shard as one file ``shard=<n>/part-*`` of fixed-length records; returns the path.

    Spark's own writer commits the files, so a lost executor leaves no partial shard. Shards are written in
    up to ``WAVES`` waves, each with a shuffle of its own that goes when the wave is written.
    """
    spark = records.sparkSession
    path = path or shared_path(spark, "token-shards")
    with shuffles_removed(spark):
        shards = (records.agg(F.max("shard")).first()[0] or 0) + 1
        wave = max(WAVE_SHARDS, -(-shards // WAVES))
        for first in range(0, shards, wave):
            some = records.where(F.col("shard").between(first, first + wave - 1)).sortWithinPartitions("shard", "slot")
            lines = some.select("shard", F.col("record").cast("string").alias("value"))
            mode = "append" if first else "errorifexists"
            lines.write.partitionBy("shard").option("lineSep", "\n").mode(mode).text(path)
    return path


def stored_records(
    spark: SparkSession, path: str, token_bytes: int = 4, record_tokens: int = RECORD_TOKENS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The rows of :func:`training_order`, read from the files of :func:`write_shards`.

    A shard file is cut at its fixed distances; its name says which slot it starts with. The smallest 64-bit
    integer reads as a null id.
    """
    stride = record_bytes(record_tokens, token_bytes)
    per_shard = max(1, shard_bytes // stride)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    count = (F.octet_length("content") / stride).cast("int")

    def records(content: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(i.alias("i"), F.substring(content, i * stride + 1, F.lit(stride - 1)).alias("record")),
        )

    # as an array's only value the content is taken out of its row once, not once a record
    cut = F.flatten(F.transform(F.array("content"), records))
    rows = files.where(count > 0).select(
        F.regexp_extract("path", r"shard=(\d+)/[^/]*$", 1).cast("long").alias("shard"), F.explode(cut).alias("at")
    )
    known = F.conv(F.hex(F.substring("at.record", 1, 8)), 16, -10).cast("long")
    return rows.select(
        F.nullif(known, F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        F.conv(F.hex(F.substring("at.record", 9, 4)), 16, 10).cast("long").alias("part"),
        F.conv(F.hex(F.substring("at.record", 13, 4)), 16, 10).cast("long").alias("n_tokens"),
        (F.col("shard") * per_shard + F.col("at.i")).alias("slot"),
        "shard",
        (F.col("at.i").cast("long") * stride).alias("offset"),
        F.col("at.record").alias("record"),
    )


def read_records(file: Iterator | object, slot: int, count: int, per_shard: int, record_tokens: int, token_bytes: int):
    """(id, part, token ids) of ``count`` records from ``slot`` on, out of an open shard file.

    ``slot`` has to lie in that shard; reading stops at its end.
    """
    stride = record_bytes(record_tokens, token_bytes)
    file.seek((slot % per_shard) * stride)
    for _ in range(count):
        record = file.read(stride)
        if len(record) < stride:
            return
        n = int.from_bytes(record[12:16], "big")
        tokens = np.frombuffer(record[HEAD_BYTES : HEAD_BYTES + n * token_bytes], f"<u{token_bytes}")
        yield int.from_bytes(record[:8], "big", signed=True), int.from_bytes(record[8:12], "big"), tokens
