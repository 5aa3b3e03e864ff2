"""The operators on streams of requests, judgments and traces.

Aggregates keep running totals in the state store; event time and watermarks bound what is kept.
Operators that need a whole-table form reuse it per micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.operators.accounting import (
    DAY_OFFSET_HOURS,
    MAX_FAILURE_RATE,
    MIN_FAILURES,
    error_class,
)
from plumbline.operators.latency import last_n, latency_summary
from plumbline.operators.student import Student, guard
from plumbline.operators.trace_audit import audit, validate_traces
from plumbline.sources.tables import exists

BUDGET_MS = 150.0
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
SKETCH_SIZE = 1024
RANK_ERROR = 0.01
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = "ts timestamp, event_id bigint, ms double"
SUMMARY = (
    "endpoint string, count bigint, errors bigint, window bigint, mean double, p50 double, p90 double, p95 double, "
    "p99 double, max double, within_budget boolean, idle boolean"
)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a UTC timestamp, which watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_latency(
    requests: DataFrame,
    window: str = "1 minute",
    slide: str | None = None,
    watermark: str = "10 minutes",
    budget: float = BUDGET_MS,
) -> DataFrame:
    """Request counts, errors and latency per endpoint in event-time windows.

    Percentiles come from a mergeable sketch per window (KLL, ``SKETCH_SIZE`` items a level), whose state is a few kilobytes however many
    requests a window has: the rank of each lies within ``RANK_ERROR`` of the one asked for. ``latency_windows`` gives exact ones
    for stored requests.
    """
    timed = with_event_time(requests).withWatermark("ts", watermark)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    ms = F.col("ms").cast("double")
    counted = timed.groupBy(span.alias("w"), "endpoint").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("is_error").alias("errors"),
        F.avg(ms).alias("mean"),
        F.kll_sketch_agg_double(ms, SKETCH_SIZE).alias("_sketch"),
        F.max(ms).alias("max"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "endpoint",
        "count",
        "errors",
        "mean",
        *[F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(n) for n, p in PERCENTILES.items()],
        "max",
    ).withColumn("within_budget", F.col("p99") <= budget)


def latency_windows(
    requests: DataFrame, window: str = "1 minute", slide: str | None = None, budget: float = BUDGET_MS
) -> DataFrame:
    """The batch twin of ``stream_latency`` with exact nearest-rank percentiles."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    placed = with_event_time(requests).withColumn("w", span)
    keyed = placed.select(
        F.col("w.start").alias("window_start"), "endpoint", "ms", "is_error"
    )
    keys = ["window_start", "endpoint"]
    errors = keyed.groupBy(*keys).agg(F.count_if("is_error").alias("errors"))
    return latency_summary(keyed, keys, "ms", budget).join(errors, keys)


def stream_last_n(
    requests: DataFrame, folder: str, checkpoint: str, n: int = 5000, budget: float = BUDGET_MS
) -> StreamingQuery:
    """Keeps the last n samples of every endpoint, exactly, and writes their latency summary.

    Each micro-batch writes a new version under ``folder`` from the version before it, so a batch
    that is run again writes the same version again. No endpoint ever has to fit into one task.
    """
    spark = requests.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch
        if batch_id > 0 and exists(spark, f"{folder}/samples", str(batch_id - 1)):
            kept = batch.unionByName(spark.read.parquet(f"{folder}/samples/{batch_id - 1}"))
        target = f"{folder}/samples/{batch_id}"
        last_n(kept, ["endpoint"], ["ts", "event_id"], n).write.mode("overwrite").parquet(target)
        window = spark.read.parquet(target)
        latency_summary(window, ["endpoint"], "ms", budget).write.mode("overwrite").parquet(
            f"{folder}/summary/{batch_id}"
        )

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


class LastSamples(StatefulProcessor):
    """The last n samples of one endpoint, by event time and id, as a ring in the state store."""

    def __init__(self, n: int, budget: float, idle_ms: int | None) -> None:
        self.n, self.budget, self.idle_ms = n, budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", SAMPLE)
        self.totals = handle.getValueState("totals", "count bigint, errors bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.ring.get()], columns=["ts", "event_id", "ms"])
        count, errors = tuple(self.totals.get()) if self.totals.exists() else (0, 0)
        for batch in rows:
            count += len(batch)
            errors += int(batch["is_error"].sum())
            parts = [p for p in (held, batch[["ts", "event_id", "ms"]]) if len(p)]
            held = pd.concat(parts).sort_values(["ts", "event_id"]).tail(self.n) if parts else held
        self.ring.put([(t.to_pydatetime(), int(e), None if pd.isna(m) else float(m)) for t, e, m in held.itertuples(index=False)])
        self.totals.update((count, errors))
        if self.idle_ms is not None:
            for timer in [t for t in self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, held["ms"], count, errors, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle endpoint is told once; its window is let go, its totals stay."""
        count, errors = tuple(self.totals.get()) if self.totals.exists() else (0, 0)
        self.ring.clear()
        yield self._row(key, pd.Series(dtype=float), count, errors, True)

    def close(self) -> None:
        pass

    def _row(self, key, ms: pd.Series, count: int, errors: int, idle: bool) -> pd.DataFrame:
        ms = ms.dropna().astype(float).sort_values().to_numpy()
        # nearest rank, half to even, as in the batch form
        picked = [float(ms[round(p * (len(ms) - 1))]) if len(ms) else None for p in (0.50, 0.90, 0.95, 0.99)]
        mean, top = (float(ms.mean()), float(ms[-1])) if len(ms) else (None, None)
        within = picked[3] <= self.budget if len(ms) else None
        row = [key[0], count, errors, len(ms), mean, *picked, top, within, idle]
        return pd.DataFrame([row], columns=[c.split()[0] for c in SUMMARY.split(", ")])


def stream_last_samples(
    requests: DataFrame, n: int = 5000, budget: float = BUDGET_MS, idle_ms: int | None = None
) -> DataFrame:
    """Latency over the last n samples of each endpoint, exactly, as a stream of new values (update mode).

    Rows whose ``idle`` is true tell that an endpoint had no request for ``idle_ms`` of processing time. A state holds n samples, so
    memory is bounded by the endpoints; a restart goes on from the checkpoint. Needs the RocksDB state store (``ROCKS``).
    """
    shaped = requests.select("endpoint", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("ms").cast("double").alias("ms"), "is_error")
    return shaped.groupBy("endpoint").transformWithStateInPandas(
        LastSamples(n, budget, idle_ms), SUMMARY, "Update", "None" if idle_ms is None else "ProcessingTime"
    )


def stream_guard(requests: DataFrame, student: Student, **options) -> DataFrame:
    """Scores and decides every request as it arrives."""
    return guard(requests, student, **options)


def stream_audit(payloads: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Validates and audits trace payloads per micro-batch. Verdicts and rejected traces go to
    folders of their batch, so a batch that is run again replaces its own output. With ``available_now`` it ends when all that is there is done."""

    def step(batch: DataFrame, batch_id: int) -> None:
        checked = validate_traces(batch)
        valid = checked.where(F.col("reject_reason").isNull())
        audit(valid).write.mode("overwrite").parquet(f"{sink}/verdicts/batch={batch_id}")
        checked.where(F.col("reject_reason").isNotNull()).select(
            "trace_id", "reject_reason"
        ).write.mode("overwrite").parquet(f"{sink}/rejected/batch={batch_id}")

    writer = payloads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_ingest(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Judgments with each (pair_id, role) once inside the watermark. With a file sink and a
    checkpoint every call is stored exactly once."""
    return with_event_time(log, "created_at").withWatermark(
        "created_at", watermark
    ).dropDuplicatesWithinWatermark(["pair_id", "role"])


def stream_failures(log: DataFrame) -> DataFrame:
    """Failed and total calls per judge so far, and whether to stop calling it (update mode)."""
    kind = error_class(F.col("error"))
    counted = log.groupBy("judge").agg(
        F.count(kind).alias("failed_calls"),
        F.count(F.lit(1)).alias("total_calls"),
        F.coalesce(F.max(kind == "QuotaExhaustedError"), F.lit(False)).alias("quota_exhausted"),
    )
    rate = F.col("failed_calls") / F.col("total_calls")
    return counted.withColumn("failure_rate", rate).withColumn(
        "stop", (F.col("failed_calls") >= MIN_FAILURES) & (rate > MAX_FAILURE_RATE)
    )


def stream_usage(
    log: DataFrame, window: str = "1 minute", slide: str | None = "10 seconds", watermark: str | None = "10 minutes"
) -> DataFrame:
    """Requests and tokens per model in sliding windows. With window '1 day' and no slide, days
    start at the provider's fixed offset."""
    timed = with_event_time(log)
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    span = (
        F.window("ts", window, slide)
        if slide
        else F.window("ts", window, startTime=f"{DAY_OFFSET_HOURS} hours")
    )
    return (
        timed.groupBy(span.alias("w"), "judge")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
        .select(F.col("w.start").alias("window_start"), "judge", "requests", "tokens")
    )
