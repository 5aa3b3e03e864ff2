"""Keyed stream state, sketched percentiles, large lookup tables and SQL functions against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.sql_functions import register
from plumbline.operators import trace_audit
from plumbline.streaming import operators as streams

REQUESTS = "event_id long, endpoint string, ms double, is_error boolean, ts timestamp"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def requests(spark, rows):
    return spark.createDataFrame(rows, "event_id long, endpoint string, ms double, is_error boolean, at long").select(
        "event_id", "endpoint", "ms", "is_error", F.timestamp_seconds("at").alias("ts")
    )


def drain(stream, base, **options):
    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = (
        streams.stream_last_samples(stream, **options).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    run.awaitTermination()


def test_last_samples_survive_restarts_and_late_rows(spark, rocks, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "b", None]), None if i % 11 == 0 else float(rng.randint(1, 90)), i % 5 == 0, rng.randint(0, 300)) for i in range(400)]
    for part in range(4):
        requests(spark, rows[part * 100 : part * 100 + 100]).write.mode("append").parquet(f"{tmp_path}/in")
        drain(spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in"), tmp_path, n=30)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    for name in ("a", "b", None):
        last = max((r for r in out if r.endpoint == name), key=lambda r: r.batch)
        own = [r for r in rows if r[1] == name]
        kept = sorted(own, key=lambda r: (r[4], r[0]))[-30:]
        ms = sorted(r[2] for r in kept if r[2] is not None)
        assert (last["count"], last.errors, last.window, last.idle) == (len(own), sum(r[3] for r in own), len(ms), False)
        assert last.mean == pytest.approx(np.mean(ms)) and last.max == ms[-1] and last.p95 == ms[round(0.95 * (len(ms) - 1))]


def test_idle_endpoints_are_told_once(spark, rocks, tmp_path):
    requests(spark, [(1, "quiet", 5.0, False, 1)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in")
    run = (
        streams.stream_last_samples(stream, n=3, idle_ms=1).writeStream.outputMode("update").format("memory").queryName("idle_samples")
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(processingTime="1 second").start()
    )
    try:
        for _ in range(60):
            if run.awaitTermination(1) or spark.table("idle_samples").where("idle").count():
                break
    finally:
        run.stop()
    told = spark.table("idle_samples").collect()
    assert [(r["count"], r.window, r.idle) for r in told] == [(1, 1, False), (1, 0, True)]


def test_sketched_percentiles_keep_their_rank_error(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = rng.lognormal(3, 1, 20_000)
    df = spark.createDataFrame([(i, "e", float(v), False, 60) for i, v in enumerate(values)], "event_id long, endpoint string, ms double, is_error boolean, at long")
    df.select("event_id", "endpoint", "ms", "is_error", F.timestamp_seconds("at").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = streams.stream_latency(spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("sketched").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    row = spark.table("sketched").first()
    for name, p in streams.PERCENTILES.items():
        assert abs((values <= row[name]).mean() - p) <= streams.RANK_ERROR
    assert row["count"] == 20_000 and row.max == values.max()


def test_large_lookup_tables_give_the_same_and_shuffle_no_null_key(spark):
    step = "struct<tool:string,args:array<struct<name:string,text:string,number:boolean>>,result:string,reasoning:string>"
    steps = [
        [("lookup", [("key", f"k{i}", False)], "v", ""), ("calculator", [("expr", "1+1", False)], "2", ""), ("lookup", [("key", f"k{i}", True)], "v", "")]
        + [("unit_convert", [("value", "2", True), ("frm", f"u{i}", False), ("to", "m", False)], "4", ""), ("lookup", [], "", "")]
        for i in range(50)
    ]
    traces = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(steps)], f"trace_id string, steps array<{step}>")
    calls = trace_audit.explode_steps(traces)
    million = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    found = trace_audit.replay_lookup(calls, million.where("id % 2 = 0"))
    assert found.columns == [*calls.columns, "replayed"] and found.count() == calls.count()
    got = {(r.trace_id, r.step): r.replayed for r in found.collect()}
    for i in range(50):
        assert got[f"t{i}", 1] == (f"v{i}" if i % 2 == 0 else None)
        assert got[f"t{i}", 2] is got[f"t{i}", 3] is got[f"t{i}", 5] is None
    factors = spark.range(100_000).select(F.concat(F.lit("u"), "id").alias("frm"), F.lit("m").alias("to"), F.lit(2.5).alias("factor"))
    converted = trace_audit.replay_convert(calls, factors)
    assert {r.replayed for r in converted.where("step = 4").collect()} == {"5"}
    assert converted.where("step <> 4 and replayed is not null").isEmpty() and converted.count() == calls.count()
    tools = {**trace_audit.TOOLS, "lookup": lambda c: trace_audit.replay_lookup(c, million)}
    status = trace_audit.step_status(calls, tools).where("tool = 'lookup' and step = 1")
    assert {r.replayed for r in status.collect()} == {f"v{i}" for i in range(50)}


def test_table_functions_in_sql(spark):
    names = register(spark)
    assert {"trace_calls", "both_orders", "flag_kappa"} <= set(names)
    rows = spark.sql("select o.* from values ('r', 'd'), (null, 'x') t(a, b), lateral both_orders(t.a, t.b) o").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(True, "r", "d"), (False, "d", "r"), (True, None, "x"), (False, "x", None)], key=str
    )
    assert spark.sql("select flag_kappa(100, 50, 60, 70) as k").first().k == pytest.approx((0.7 - 0.5) / 0.5)
    assert spark.sql("select flag_kappa(0, 0, 0, 0) as k").first().k is None
    assert spark.sql("select flag_kappa(5, 5, 5, 5) as k").first().k is None
