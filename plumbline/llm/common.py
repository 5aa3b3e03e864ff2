"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ensure_checkpoint_dir, shuffles_removed

# Fixed value: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
ROW = "row"


def packed(df: DataFrame) -> DataFrame:
    """Every input row as one struct, so that no input column can clash with a working column."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW))


def field(name: str) -> Column:
    """An input column of a packed frame."""
    return F.col(ROW).getField(name)


def unpacked(df: DataFrame, names: Sequence[str], added: Sequence[str]) -> list[Column]:
    """The input columns and then the operator's own.

    An input column named like one of the operator's (in any case) is kept as ``<name>_in``, with
    more ``_in`` as needed.
    """
    taken = {c.lower() for c in added}
    out = []
    for name in names:
        alias = name
        while alias.lower() in taken or (alias != name and alias.lower() in {n.lower() for n in names}):
            alias += "_in"
        out.append(field(name).alias(alias))
    return out + [F.col(c) for c in added]


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words as the contracts define them; null counts as no word."""
    return F.size(F.array_remove(F.split(text_or_empty(text), _GAP), "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Plain ASCII takes the fast built-in, which does the same there."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & a.eqNullSafe(b)
    return on


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share; runs never meet in one folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{re.sub(r'[^a-z0-9-]', '-', name)}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again.

    Cuts the lineage like ``checkpoint()``, in a compressed, column-wise form.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession, path: str) -> None:
    """Deletes a folder of :func:`shared_path` that no frame reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
