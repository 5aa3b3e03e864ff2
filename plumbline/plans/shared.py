"""Small helpers for query definitions and their SQL twins."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions.intervals import z_value
from plumbline.session import ensure_checkpoint_dir

if TYPE_CHECKING:
    from plumbline.plans.registry import Inputs


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Every double column rounded, so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sql_wilson(k: str, n: str, side: str, confidence: float = 0.95) -> str:
    """Wilson limit as SQL text."""
    z = repr(z_value(confidence))
    share = f"({k} * 1.0::double / {n})"
    centre = f"({share} + {z}::double * {z}::double / (2.0::double * {n}))"
    spread = (
        f"{z}::double * sqrt({share} * (1 - {share}) / {n}"
        f" + {z}::double * {z}::double / (4.0::double * {n} * {n}))"
    )
    bottom = f"(1 + {z}::double * {z}::double / {n})"
    if side == "lo":
        return f"greatest(0.0, ({centre} - {spread}) / {bottom})"
    return f"least(1.0, ({centre} + {spread}) / {bottom})"


SPREAD_ROWS = 500_000


def spread(df: DataFrame, keys: list[str], rows: int = SPREAD_ROWS) -> DataFrame:
    """The rows dealt by ``keys`` to as many partitions as keep each at about ``rows`` rows, for a sort that must not grow with the table.

    Where the session's own number of partitions is enough, dealing is left to Spark.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as compressed columns and read back; a checkpoint of wide rows takes several times the space."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_stream(t: Inputs, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files.

    The brackets match the name itself: a file source takes a pattern that finds one file, but not the bare path of one.
    """
    return t.spark.readStream.schema(t.table(name).schema).parquet(f"{t.folder}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is stored now, and reads what it wrote."""
    spark = stream.sparkSession
    base = shared_folder(spark, "streams")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode(mode)
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        writer = stream.writeStream.foreachBatch(replace).outputMode(mode)
    run = writer.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")
