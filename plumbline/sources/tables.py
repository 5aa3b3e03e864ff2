"""Readers and writers: items, pairs, models, results and the judgment view."""

from __future__ import annotations

import platform
import re
import sys
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from plumbline.operators.ordered import take_first

FACT_TYPE = "struct<key:string,value:string,kind:string,unit:string,required:boolean,clause:string>"
ITEM_SCHEMA = (
    "id string, domain string, context string, question string, reference string, "
    f"facts array<{FACT_TYPE}>"
)
PAIR_SCHEMA = (
    "id string, source_id string, context string, question string, reference string, "
    "candidate string, degradation string, split string, metadata struct<source_url:string,"
    "license:string,source_split:string,answer_spans:array<struct<text:string,answer_start:int>>,"
    "edit:string,label_origin:string,review_status:string>"
)
RESULT_NAME = re.compile(r"[A-Za-z0-9_-]+")
SMOKE_FOLDER = "_smoke"


def read_items(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Items from JSON lines with a fixed schema; with n, the first n by id."""
    items = spark.read.schema(ITEM_SCHEMA).json(path, mode="FAILFAST")
    return items if n is None else take_first(items, ["id"], n)


def write_items(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    items.select("id", "domain", "context", "question", "reference", "facts").write.mode(mode).json(
        path, ignoreNullFields=False
    )


def pair_violations(pairs: DataFrame) -> DataFrame:
    """What makes a pair table unusable: empty fields, reference equal to candidate, repeated ids."""
    empty = F.lit(False)
    for column in ("context", "question", "reference", "candidate"):
        empty = empty | F.coalesce(F.length(column) < 1, F.lit(True))
    reason = F.when(empty, "empty field").when(
        F.col("reference") == F.col("candidate"), "reference equals candidate"
    )
    rows = pairs.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())
    repeated = pairs.groupBy("id").count().where(F.col("count") > 1)
    return rows.unionByName(repeated.select("id", F.lit("repeated id").alias("reason")))


def checked_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs, or an error naming a few violations if there are any or the table is empty."""
    found = pair_violations(pairs).limit(5).collect()
    if found:
        raise ValueError("unusable pairs: " + "; ".join(f"{r.id}: {r.reason}" for r in found))
    if pairs.isEmpty():
        raise ValueError("the pair table is empty")
    return pairs


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return checked_pairs(spark.read.schema(PAIR_SCHEMA).json(path, mode="FAILFAST"))


def content_checksum(df: DataFrame) -> Column:
    """An aggregate that identifies the rows whatever their order: XOR of per-row hash prefixes."""
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    return F.bit_xor(F.conv(F.substring(F.md5(body), 1, 8), 16, 10).cast("bigint"))


def manifest(df: DataFrame, source: str = "source_id", seed: int = 20260731) -> DataFrame:
    """Row counts, distinct sources, seed and checksum of a pair table."""
    return df.agg(
        F.count(F.lit(1)).alias("pairs"),
        (2 * F.count(F.lit(1))).alias("candidate_answers"),
        F.count_distinct(source).alias("sources"),
        F.lit(seed).alias("seed"),
        content_checksum(df).alias("checksum"),
    )


def read_models(nested: DataFrame) -> DataFrame:
    """One row per model alias from rows of (provider, models array of structs)."""
    return nested.select("provider", F.explode("models").alias("m")).select("provider", "m.*")


def register_judgments(df: DataFrame, name: str = "judgments") -> DataFrame:
    """Flattens rows that hold an array of record structs and registers them for SQL."""
    flat = df.select(F.explode("records").alias("r")).select("r.*")
    flat.createOrReplaceTempView(name)
    return flat


def _finite(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(~bad, value)
    if isinstance(kind, ArrayType) and _has_float(kind):
        return F.transform(value, lambda v: _finite(v, kind.elementType))
    if isinstance(kind, MapType) and _has_float(kind.valueType):
        return F.transform_values(value, lambda _, v: _finite(v, kind.valueType))
    if isinstance(kind, StructType) and _has_float(kind):
        fields = [_finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_float(kind: DataType) -> bool:
    if isinstance(kind, (DoubleType, FloatType)):
        return True
    if isinstance(kind, ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, MapType):
        return _has_float(kind.valueType)
    return isinstance(kind, StructType) and any(_has_float(f.dataType) for f in kind.fields)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in every float column, nested ones included."""
    return df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def provenance(mode: str, seed: int, version: str) -> dict[str, str | int]:
    return {
        "mode": mode,
        "seed": seed,
        "version": version,
        "python": sys.version.split()[0],
        "platform": platform.platform(),
        "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }


def _result_path(base: str, name: str, smoke: bool) -> str:
    if not RESULT_NAME.fullmatch(name):
        raise ValueError("a result name has letters, digits, '_' and '-' only")
    folder = f"{base.rstrip('/')}/{SMOKE_FOLDER}" if smoke else base.rstrip("/")
    return f"{folder}/{name}"


def save(
    df: DataFrame,
    base: str,
    name: str,
    stamp: dict[str, str | int],
    smoke: bool = False,
    partition_by: tuple[str, ...] = (),
) -> str:
    """Writes a result with its provenance. Smoke results go to a folder of their own, so they never
    replace full ones."""
    path = _result_path(base, name, smoke)
    stamped = json_safe(df).withColumns({f"provenance_{k}": F.lit(v) for k, v in stamp.items()})
    stamped.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def load(spark: SparkSession, base: str, name: str, smoke: bool = False) -> DataFrame:
    path = _result_path(base, name, smoke)
    if not exists(spark, base, name, smoke):
        raise FileNotFoundError(f"no result {name} under {base}")
    return spark.read.parquet(path)


def exists(spark: SparkSession, base: str, name: str, smoke: bool = False) -> bool:
    """Whether a result was completely written."""
    location = spark._jvm.org.apache.hadoop.fs.Path(f"{_result_path(base, name, smoke)}/_SUCCESS")
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """A new small text file; FileExistsError if there is one already."""
    system, location = _file_system(spark, path)
    try:
        out = system.create(location, False)
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            raise FileExistsError(path) from problem
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small text file, null if there is none."""
    system, location = _file_system(spark, path)
    if not system.exists(location):
        return None
    source = system.open(location)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    system, location = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(location)] if system.exists(location) else []
