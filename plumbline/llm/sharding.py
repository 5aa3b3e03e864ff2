"""Sharding by a two-pass external shuffle.

Pass one scatters records by a seeded hash into buckets that fit in memory; pass two makes a Fisher-Yates shuffle of each
bucket and writes it. The buckets, end to end, are one random order of all records; it is cut into
shards whose row counts differ by at most one.

What is shuffled is a bucket's row numbers, with the built-in ``shuffle``, which is Fisher-Yates in linear work; each record then
takes the place drawn for its number. The built-in draws by partition number and row order, so the buckets are dealt to a fixed number
of partitions and sorted there first: the order comes out the same in every run and after every retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import ROW, field, packed, shared_path, stored, text_or_empty, unpacked

BUCKET_BYTES = 8 << 20
TASK_BUCKETS = 2
LAW = "rows"


def record_bytes(text) -> F.Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def external_shuffle(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every input row with ``size`` (bytes), ``law`` (``rows``), ``shard`` and ``slot`` (from 0, gapless).

    Rows are scattered by id and text, so copies with different ids spread; null ids and texts are
    values like others, and fully repeated rows are all kept. Shard counts differ by at most one; with
    fewer rows than shards some shards are empty. Input columns with the names of added ones are kept
    as ``<name>_in``.
    """
    names = docs.columns
    rows = packed(docs).select(ROW, record_bytes(field(text)).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    keyed = rows.withColumn("draw", F.xxhash64(F.lit(seed), field(id_col), field(text))).withColumn(
        "bucket", F.pmod("draw", F.lit(buckets))
    )
    tasks = buckets // TASK_BUCKETS + 1
    by_bucket = Window.orderBy("bucket")
    # one row per bucket; a bucket's place is known before its records are sorted
    places = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).select(
        "bucket",
        "rows",
        F.coalesce(F.sum("rows").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    counted = places.select("bucket", "rows", "start", "total").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    numbers = F.sequence(F.lit(0), (F.col("rows") - 1).cast("int"))
    drawn = stored(counted.select("bucket", "start", "total", F.shuffle(numbers, seed + 1).alias("order")), "bucket-orders")
    inside = Window.partitionBy("bucket").orderBy("draw", field(id_col), field(text))
    shuffled = (
        keyed.repartition(tasks, "bucket")
        .withColumn("nth", F.row_number().over(inside))
        .join(drawn, "bucket")
        .withColumn("at", F.col("start") + F.get("order", F.col("nth") - 1))
        .drop("order")
        .withColumn("shard", F.expr(f"at * {shards} div total").cast("int"))
        .withColumn("slot", F.col("at") - F.ceil(F.col("shard") * F.col("total") / shards))
        .withColumn("law", F.lit(LAW))
    )
    return shuffled.select(*unpacked(shuffled, names, ["size", "law", "shard", "slot"]))


def write_shards(shuffled: DataFrame, path: str | None = None) -> str:
    """Writes one folder per shard, each file ordered by slot; returns the path.

    A bucket lies in one shard, or in two at a border, so a task writes about as many files as it has
    buckets. The default path is a new folder in the shared place.
    """
    path = path or shared_path(shuffled.sparkSession, "shards")
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
