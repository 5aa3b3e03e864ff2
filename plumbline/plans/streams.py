"""Batch twins of the streaming operators, and streams run over the stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.registry import Inputs, query
from plumbline.plans.shared import drained, rounded, shared_folder, table_stream
from plumbline.plans.stats import CALLS_SQL, calls
from plumbline.plans.traces import STATUS_SQL, trace_payloads
from plumbline.streaming import operators as streams


LAST_SQL = """with b as (select *, row_number() over (partition by endpoint order by ts desc, event_id desc) as back from fx_requests),
w as (select endpoint, ms, row_number() over (partition by endpoint order by ms) - 1 as i, count(*) over (partition by endpoint) as n
  from b where back <= __N__ and ms is not null),
s as (select endpoint, any_value(n) as window, round(avg(ms), 6) as mean,
  max(ms) filter (i = round_even(0.5 * (n - 1), 0)) as p50, max(ms) filter (i = round_even(0.9 * (n - 1), 0)) as p90,
  max(ms) filter (i = round_even(0.95 * (n - 1), 0)) as p95, max(ms) filter (i = round_even(0.99 * (n - 1), 0)) as p99,
  max(ms) as max from w group by endpoint),
c as (select endpoint, count(*) as count, count(*) filter (is_error) as errors from fx_requests group by 1)
select s.*, count, errors, p99 <= 150 as within_budget from s join c using (endpoint)"""


@query(
    "latency_windows",
    """with r as (select date_trunc('hour', ts) as w, event_type as endpoint, value as ms,
  event_type = 'error' as is_error, row_number() over (partition by date_trunc('hour', ts), event_type
  order by value) - 1 as i, count(*) over (partition by date_trunc('hour', ts), event_type) as n
  from events)
select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, endpoint, any_value(n) as n,
  round(avg(ms), 6) as mean, max(ms) filter (i = round_even(0.5 * (n - 1), 0)) as p50,
  max(ms) filter (i = round_even(0.95 * (n - 1), 0)) as p95,
  max(ms) filter (i = round_even(0.99 * (n - 1), 0)) as p99, max(ms) as max,
  count(*) filter (is_error) as errors from r group by w, endpoint""",
)
def _(t: Inputs) -> DataFrame:
    out = streams.latency_windows(t.view("requests"), "1 hour")
    text = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return rounded(out.withColumn("window_start", text).drop("within_budget", "p90"))


@query(
    "usage_windows",
    f"""with {CALLS_SQL},
w as (select *, unnest([0, 1, 2]) as back from calls)
select strftime(time_bucket(interval 10 minutes, ts) - back * interval 10 minutes,
  '%Y-%m-%d %H:%M:%S') as window_start, judge, count(*) as requests, sum(tokens)::bigint as tokens
from w group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    out = streams.stream_usage(calls(t), "30 minutes", "10 minutes", None)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "usage_days",
    f"""with {CALLS_SQL} select strftime((ts - interval 8 hours)::date + interval 8 hours,
  '%Y-%m-%d %H:%M:%S') as window_start, judge, count(*) as requests, sum(tokens)::bigint as tokens
from calls group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    out = streams.stream_usage(calls(t), "1 day", None, None)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "streamed_failures",
    """select 'j' || (user_id % 4) as judge, count(*) filter (event_type = 'error') as failed_calls,
  count(*) as total_calls, false as quota_exhausted,
  round(count(*) filter (event_type = 'error') / count(*), 6) as failure_rate,
  count(*) filter (event_type = 'error') >= 25
    and count(*) filter (event_type = 'error') / count(*) > 0.2 as stop from events group by 1""",
)
def _(t: Inputs) -> DataFrame:
    log = table_stream(t, "events").select(
        F.concat(F.lit("j"), (F.col("user_id") % 4).cast("string")).alias("judge"),
        F.when(F.col("event_type") == "error", "HTTPError: bad").otherwise("").alias("error"),
    )
    return rounded(drained(streams.stream_failures(log), "complete"))


@query(
    "streamed_unique_calls",
    """select 'p' || (event_id // 3) as pair_id, case event_id % 3 when 0 then 'reference' else
  'candidate' end as role from events group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    log = table_stream(t, "events").select(
        F.concat(F.lit("p"), F.expr("event_id div 3").cast("string")).alias("pair_id"),
        F.when(F.col("event_id") % 3 == 0, "reference").otherwise("candidate").alias("role"),
        F.col("ts").alias("created_at"),
    )
    return drained(streams.stream_ingest(log, "30 days"), "append").select("pair_id", "role")


def _streamed_latency(t: Inputs) -> DataFrame:
    requests = table_stream(t, "events").select(
        "event_id",
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("ms"),
        (F.col("event_type") == "error").alias("is_error"),
        "ts",
    )
    # complete: a table that ends never moves the watermark past its last windows
    return drained(streams.stream_latency(requests, "1 hour", watermark="1 hour"), "complete")


@query(
    "streamed_latency",
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as endpoint,
  count(*) as count, count(*) filter (event_type = 'error') as errors, round(avg(value), 6) as mean,
  max(value) as max from events group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    text = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    out = _streamed_latency(t).withColumn("window_start", text)
    return rounded(out.select("window_start", "endpoint", "count", "errors", "mean", "max"))


@query(
    "streamed_latency_percentiles",
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as endpoint,
  count(value) as count, true as p50_near, true as p95_near, true as p99_near from events group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    """Sketched percentiles of the stream beside the stored requests: is each one's rank within the stated error?"""
    sketched = _streamed_latency(t).select("window_start", "endpoint", *streams.PERCENTILES)
    stored = t.view("requests").select(F.date_trunc("hour", "ts").alias("window_start"), "endpoint", F.col("ms").cast("double").alias("ms"))
    ranked = sketched.join(stored.where("ms is not null"), ["window_start", "endpoint"]).groupBy("window_start", "endpoint").agg(
        F.count("ms").alias("count"),
        *[F.count_if(F.col("ms") < F.col(n)).alias(f"{n}_below") for n in streams.PERCENTILES],
        *[F.count_if(F.col("ms") <= F.col(n)).alias(f"{n}_upto") for n in streams.PERCENTILES],
    )
    error = streams.RANK_ERROR
    near = [
        F.lit(p).between(F.col(f"{n}_below") / F.col("count") - error, F.col(f"{n}_upto") / F.col("count") + error).alias(f"{n}_near")
        for n, p in streams.PERCENTILES.items()
    ]
    return ranked.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint", "count", *near)


LAST_SAMPLES = 5000


@query(
    "streamed_last_samples",
    LAST_SQL.replace("__N__", str(LAST_SAMPLES)),
    "requests",
)
def _(t: Inputs) -> DataFrame:
    """The last samples of each endpoint from a stream in three runs, each of which starts from the checkpoint of the one before."""
    base = shared_folder(t.spark, "streams")
    requests = t.view("requests").select("event_id", "endpoint", "ms", "is_error", "ts")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    try:
        for part in range(3):
            requests.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
            stream = t.spark.readStream.schema(requests.schema).parquet(f"{base}/in")

            def keep(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

            run = (
                streams.stream_last_samples(stream, LAST_SAMPLES)
                .writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
            )
            run.awaitTermination()
    finally:
        t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = t.spark.read.parquet(f"{base}/out")
    newest = rows.groupBy("endpoint").agg(F.max(F.struct("batch", *rows.drop("batch", "endpoint").columns)).alias("r"))
    return rounded(newest.select("endpoint", "r.*").drop("batch", "idle"))


@query(
    "streamed_audit",
    f"""with {STATUS_SQL},
rpt as (select trace_id, step, row_number() over (partition by trace_id, tool, name1, arg1,
  coalesce(arg2, ''), coalesce(arg3, '') order by step) as rn from fx_trace_calls),
roll as (select st.trace_id, count(*) as steps_checked, count(*) filter (status <> 'passed')
  as step_failures, string_agg(st.status, ',' order by st.step) as statuses,
  case any_value(answer_kind) when 0 then true when 1 then true when 2 then false end as ok,
  coalesce(string_agg(st.step, ',' order by st.step) filter (rn > 1), '') as repeats
  from st join rpt on rpt.trace_id = st.trace_id and rpt.step = st.step group by 1)
select trace_id, null::varchar as reject_reason, steps_checked, step_failures, ok as answer_matches_expected, statuses, repeats,
  case when step_failures > 0 or not coalesce(ok, true) then 'failed' when ok then 'passed'
    else 'consistent' end as status from roll where trace_id::bigint % 11 <> 4
union all select distinct trace_id, 'unknown field', null, null, null, null, null, null from fx_trace_calls
where trace_id::bigint % 11 = 4""",
    "trace_calls",
)
def _(t: Inputs) -> DataFrame:
    """Trace payloads as a stream in two runs over one checkpoint; every eleventh has a field too many."""
    base = shared_folder(t.spark, "streams")
    number = F.col("trace_id").cast("bigint")
    payloads = trace_payloads(t, note=F.when(number % 11 == 4, "surplus"))
    for part in range(2):
        payloads.where(F.pmod(number, F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema("trace_id string, payload string").parquet(f"{base}/in")
        run = streams.stream_audit(stream, f"{base}/out", f"{base}/progress", available_now=True)
        run.awaitTermination()
    verdicts = t.spark.read.parquet(f"{base}/out/verdicts").select(
        "trace_id",
        F.lit(None).cast("string").alias("reject_reason"),
        "steps_checked",
        "step_failures",
        "answer_matches_expected",
        "status",
        F.array_join("checked.status", ",").alias("statuses"),
        F.array_join(F.col("repeats").cast("array<string>"), ",").alias("repeats"),
    )
    rejected = t.spark.read.parquet(f"{base}/out/rejected").select("trace_id", "reject_reason")
    return verdicts.unionByName(rejected, allowMissingColumns=True)
