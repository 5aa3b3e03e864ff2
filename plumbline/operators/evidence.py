"""Pointwise evidence runs: planning what is left, appending, summarising, checking, publishing.

A run scores the reference and the candidate of every pair; its log has pair_id, source_id, role,
text, score, prompt_tokens, completion_tokens, model_served, simulated, cached and finish_reason.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.extraction import score_of
from plumbline.operators.bootstrap import cluster_ci
from plumbline.operators.ordered import take_first
from plumbline.sources.tables import create_file, exists, list_files, load, read_file, save

ROLES = ("reference", "candidate")


def planned_calls(pairs: DataFrame) -> DataFrame:
    """Two calls per pair."""
    roles = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(ROLES)])
    return pairs.withColumn("c", F.explode(roles)).select(
        F.col("id").alias("pair_id"), "source_id", "c.turn", "c.role"
    )


def plan_resume(pairs: DataFrame, done: DataFrame, max_new: int) -> DataFrame:
    """The next calls of a run: planned minus done, at most ``max_new``, in pair order."""
    if max_new < 0:
        raise ValueError("the call budget must not be negative")
    left = planned_calls(pairs).join(done.select("pair_id", "role"), ["pair_id", "role"], "left_anti")
    return take_first(left, ["pair_id", "turn"], max_new)


def check_resumable(log: DataFrame, signature: str) -> None:
    """Refuses a log made with other settings or from simulated answers."""
    bad = log.where((F.col("signature") != signature) | F.col("simulated")).limit(1).collect()
    if bad:
        raise ValueError("the log belongs to other settings or holds simulated answers")


def append_log(new: DataFrame, path: str, signature: str) -> None:
    """Appends answers to the log. An existing log must carry the same signature."""
    spark = new.sparkSession
    folder, name = path.rstrip("/").rsplit("/", 1)
    if exists(spark, folder, name):
        check_resumable(spark.read.parquet(path), signature)
    stamped = new.withColumn("signature", F.lit(signature))
    check_resumable(stamped, signature)
    stamped.write.mode("append").parquet(path)


def by_role(log: DataFrame) -> DataFrame:
    """One row per pair with both roles' scores; a repeated answer of a role counts once."""
    reference = F.col("role") == "reference"
    return log.groupBy("pair_id").agg(
        F.count_if(reference).alias("n_reference"),
        F.count_if(~reference).alias("n_candidate"),
        F.max(F.when(reference, F.col("score"))).alias("reference_score"),
        F.max(F.when(~reference, F.col("score"))).alias("candidate_score"),
    )


def pair_flags(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs with both roles answered: correct only if both scores were read and the reference is
    higher. A pair that misses a role is left out."""
    joined = pairs.select(F.col("id").alias("pair_id"), "source_id").join(by_role(log), "pair_id")
    parsed = F.col("reference_score").isNotNull() & F.col("candidate_score").isNotNull()
    better = parsed & (F.col("reference_score") > F.col("candidate_score"))
    return joined.where((F.col("n_reference") > 0) & (F.col("n_candidate") > 0)).select(
        "pair_id",
        "source_id",
        "reference_score",
        "candidate_score",
        parsed.alias("parsed"),
        F.coalesce(better, F.lit(False)).cast("int").alias("correct"),
    )


def summarize_pairs(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Counts, accuracy, tokens and models of a run, in one row."""
    flags = pair_flags(pairs, log).agg(
        F.count(F.lit(1)).alias("completed_pairs"),
        F.count_distinct("source_id").alias("n_clusters"),
        F.avg("correct").alias("accuracy"),
        F.count_if(~F.col("parsed")).alias("pairs_with_parse_failure"),
    )
    totals = log.agg(
        F.count(F.lit(1)).alias("provider_calls_recorded"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.array_join(F.array_sort(F.collect_set("model_served")), ",").alias("models_served"),
    )
    planned = pairs.agg(F.count(F.lit(1)).alias("planned_pairs"))
    columns = [F.struct(*c.columns) for c in (planned, totals)]
    wide = flags.withColumn("_p", planned.select(columns[0]).scalar()).withColumn(
        "_t", totals.select(columns[1]).scalar()
    )
    return wide.select("_p.*", *flags.columns, "_t.*").withColumn(
        "complete", F.col("completed_pairs") == F.col("planned_pairs")
    )


def accuracy_interval(
    pairs: DataFrame, log: DataFrame, resamples: int = 10_000, seed: int = 20260731
) -> DataFrame:
    """Accuracy with whole sources resampled."""
    return cluster_ci(pair_flags(pairs, log), [], "source_id", "correct", resamples, seed=seed)


def evidence_view(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Both answers beside their pair with a ranking status; sort by (ok, id) for failures first."""
    reference = F.col("role") == "reference"
    answers = log.groupBy("pair_id").agg(
        F.max(F.when(reference, F.col("score"))).alias("reference_score"),
        F.max(F.when(~reference, F.col("score"))).alias("candidate_score"),
        F.max(F.when(reference, F.col("text"))).alias("reference_text"),
        F.max(F.when(~reference, F.col("text"))).alias("candidate_text"),
    )
    ok = F.coalesce(F.col("reference_score") > F.col("candidate_score"), F.lit(False))
    return (
        pairs.join(answers, pairs["id"] == answers["pair_id"])
        .drop("pair_id")
        .withColumn("ok", ok)
        .withColumn(
            "status",
            F.when(ok, "Correct ranking").otherwise("Failure: tied or reversed ranking"),
        )
    )


def verify_evidence(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Violations of an evidence log by kind: missing, unexpected or repeated calls, simulated or
    cached answers, cut-off answers, and saved scores that differ from re-reading the text."""
    expected = planned_calls(pairs).select("pair_id", "role")
    counted = log.groupBy("pair_id", "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("simulated") | F.col("cached")).alias("_fresh"),
        F.count_if(F.col("finish_reason") != "stop").alias("_cut"),
        F.count_if(~score_of(F.col("text")).eqNullSafe(F.col("score"))).alias("_reread"),
    )
    matched = expected.withColumn("_expected", F.lit(True)).join(
        counted.withColumn("_seen", F.lit(True)), ["pair_id", "role"], "full"
    )
    checks = {
        "missing": F.count_if(F.col("_seen").isNull()),
        "unexpected": F.count_if(F.col("_expected").isNull()),
        "repeated": F.count_if(F.col("n") > 1),
        "simulated or cached": F.coalesce(F.sum("_fresh"), F.lit(0)),
        "not finished": F.coalesce(F.sum("_cut"), F.lit(0)),
        "score differs from text": F.coalesce(F.sum("_reread"), F.lit(0)),
    }
    counts = matched.agg(*[c.cast("bigint").alias(n) for n, c in checks.items()])
    return counts.unpivot([], list(checks), "violation", "n_rows")


def summary_matches(summary: DataFrame, published: DataFrame) -> bool:
    """Whether a recomputed one-row summary equals the published one."""
    shared = summary.columns
    return summary.exceptAll(published.select(*shared)).isEmpty() and published.select(
        *shared
    ).exceptAll(summary).isEmpty()


class Conflict(RuntimeError):
    """Another writer published first."""


def publish(
    pairs: DataFrame,
    log: DataFrame,
    base: str,
    name: str,
    stamp: dict[str, str | int],
    expected_version: int | None = None,
) -> int:
    """Writes the summary, its evidence and a manifest as the next version, only if every integrity check passes and the
    run is complete. ``stamp`` carries the run, model and dataset identity. Returns the version.

    Everything goes to a folder of its own first. Readers see it when the file of the next version number is created, which
    the store lets one writer do alone; it names the folder. A writer that loses gets :class:`Conflict`, as does one
    whose ``expected_version`` is no longer the latest, and what it wrote is never read.
    """
    broken = [r for r in verify_evidence(pairs, log).collect() if r.n_rows]
    if broken:
        raise ValueError("; ".join(f"{r.violation}: {r.n_rows}" for r in broken))
    summary = summarize_pairs(pairs, log)
    if not summary.first().complete:
        raise ValueError("the run is not complete")
    spark = log.sparkSession
    latest = published_version(spark, base, name)
    if expected_version is not None and latest != expected_version:
        raise Conflict(f"{name} is at version {latest}, not {expected_version}")
    folder = f"run-{uuid.uuid4().hex}"
    place = f"{base.rstrip('/')}/{name}/{folder}"
    save(log, place, "evidence", stamp)
    save(summary, place, "summary", stamp)
    manifest = {
        "version": latest + 1,
        "parts": {"evidence": log.count(), "summary": 1},
        "stamp": stamp,
    }
    create_file(spark, f"{place}/manifest.json", json.dumps(manifest, sort_keys=True))
    try:
        create_file(spark, _pointer(base, name, latest + 1), folder)
    except FileExistsError as taken:
        raise Conflict(f"version {latest + 1} of {name} was published by another writer") from taken
    return latest + 1


def _pointer(base: str, name: str, version: int) -> str:
    return f"{base.rstrip('/')}/{name}/versions/{version:010d}"


def published_version(spark: SparkSession, base: str, name: str) -> int:
    """The latest version, 0 if there is none. A pointer that is still being written does not count."""
    found = [int(f) for f in list_files(spark, f"{base.rstrip('/')}/{name}/versions") if f.isdigit()]
    return max((v for v in found if read_file(spark, _pointer(base, name, v))), default=0)


def published(spark: SparkSession, base: str, name: str, version: int | None = None) -> dict[str, DataFrame | dict]:
    """``manifest``, ``summary`` and ``evidence`` of a version, the latest by default."""
    at = published_version(spark, base, name) if version is None else version
    folder = read_file(spark, _pointer(base, name, at)) if at else None
    if not folder:
        raise FileNotFoundError(f"no version {at} of {name} under {base}")
    place = f"{base.rstrip('/')}/{name}/{folder}"
    manifest = json.loads(read_file(spark, f"{place}/manifest.json"))
    return {"manifest": manifest, **{part: load(spark, place, part) for part in manifest["parts"]}}


def published_summary(spark: SparkSession, base: str, name: str) -> DataFrame:
    return published(spark, base, name)["summary"]
