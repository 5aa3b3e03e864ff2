"""What a judging run used up, what failed, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import numbered

# Failure share and count that stop a run, token budgets, required headroom, the
# provider day's offset from UTC, and the history a reservation looks at.
MAX_FAILURE_RATE = 0.20
MIN_FAILURES = 25
BASE_TOKENS = {"cot": 512}
DEFAULT_TOKENS = 160
REASONING_FACTOR = 10
MIN_HEADROOM = 0.15
DAY_OFFSET_HOURS = 8
RATE_RESERVE = 0.9
HISTORY = 64
MIN_HISTORY = 8
RESERVE_FACTOR = 1.15
TRUNCATED = ("length", "max_tokens", "empty")


def is_truncated(finish_reason: Column) -> Column:
    return F.lower(F.trim(F.coalesce(finish_reason, F.lit("")))).isin(*TRUNCATED)


def token_budget(config: Column, reasoning: Column) -> Column:
    base = F.lit(DEFAULT_TOKENS)
    for name, tokens in BASE_TOKENS.items():
        base = F.when(config == name, tokens).otherwise(base)
    return base * F.when(reasoning, REASONING_FACTOR).otherwise(1)


def headroom(log: DataFrame, models: DataFrame) -> DataFrame:
    """Output budget, the share left over, and what is wrong with a call, if anything.

    ``log`` has judge, config, completion_tokens, finish_reason and a nullable score.
    """
    known = log.join(models.select(F.col("alias").alias("judge"), "reasoning"), "judge")
    budgeted = known.withColumn("budget", token_budget(F.col("config"), F.col("reasoning")))
    left = 1 - F.col("completion_tokens") / F.col("budget")
    return budgeted.withColumn("headroom", left).withColumn(
        "status",
        F.when(
            F.col("score").isNull(),
            F.when(is_truncated(F.col("finish_reason")), "truncated").otherwise("unparseable"),
        )
        .when(left < MIN_HEADROOM, "too tight")
        .otherwise("ok"),
    )


def error_class(error: Column) -> Column:
    """The class name in front of an error message; a text that starts otherwise is ``other``.

    A class is one identifier, so free texts do not become classes of their own.
    """
    name = F.regexp_extract(error, r"^([A-Za-z_][A-Za-z0-9_.]*)(:|$)", 1)
    return F.when(error != "", F.when(name != "", name).otherwise("other"))


def failure_report(log: DataFrame) -> DataFrame:
    """Failed and total calls per judge, failures by error class, and whether to stop."""
    kinds = log.groupBy("judge", error_class(F.col("error")).alias("kind")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    failed = F.sum(F.when(F.col("kind").isNotNull(), F.col("calls")).otherwise(0))
    entries = F.collect_list(
        F.when(F.col("kind").isNotNull(), F.struct(F.col("kind"), F.col("calls")))
    )
    counted = kinds.groupBy("judge").agg(
        failed.alias("failed_calls"),
        F.sum("calls").alias("total_calls"),
        F.map_from_entries(F.array_sort(entries)).alias("errors"),
        F.coalesce(F.max(F.col("kind") == "QuotaExhaustedError"), F.lit(False)).alias(
            "quota_exhausted"
        ),
    )
    rate = F.col("failed_calls") / F.greatest(F.col("total_calls"), F.lit(1))
    return counted.withColumn("failure_rate", rate).withColumn(
        "stop", (F.col("failed_calls") >= MIN_FAILURES) & (rate > MAX_FAILURE_RATE)
    )


def coverage(log: DataFrame, panel: DataFrame) -> DataFrame:
    """The judges of the panel each experiment lacks, as an array; complete experiments are left
    out. ``panel`` has one judge per row and is small."""
    wanted = panel.select("judge").distinct().agg(F.array_sort(F.collect_list("judge")).alias("all"))
    seen = log.groupBy("experiment").agg(F.collect_set("judge").alias("seen"))
    missing = seen.withColumn("panel", wanted.scalar()).select(
        "experiment", F.array_except("panel", "seen").alias("missing")
    )
    return missing.where(F.size("missing") > 0)


def provider_day(ts: Column) -> Column:
    """The calendar day at a fixed offset of eight hours behind UTC."""
    return F.to_date(ts - F.expr(f"INTERVAL {DAY_OFFSET_HOURS} HOURS"))


def usage_vs_allowance(log: DataFrame, models: DataFrame, calls_left: int) -> DataFrame:
    """Requests and tokens per model and day against the daily allowance.

    ``log`` has judge, ts, tokens and error. A day with a quota error has nothing left.
    """
    used = log.groupBy("judge", provider_day(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("day_requests"),
        F.sum("tokens").alias("day_tokens"),
        F.coalesce(
            F.max(error_class(F.col("error")) == "QuotaExhaustedError"), F.lit(False)
        ).alias("exhausted"),
    )
    limits = models.select(F.col("alias").alias("judge"), "rpd")
    return used.join(limits, "judge", "left").select(
        "judge",
        "day",
        "day_requests",
        "day_tokens",
        "rpd",
        "exhausted",
        F.when(F.col("exhausted"), 0).otherwise(F.col("rpd") - F.col("day_requests")).alias(
            "remaining"
        ),
        (F.lit(calls_left) / F.when(F.col("rpd") > 0, F.col("rpd"))).alias("days_of_work_left"),
    )


def rate_windows(
    log: DataFrame, models: DataFrame, seconds: int = 60, reserve: float = RATE_RESERVE
) -> DataFrame:
    """Requests and tokens of the last minute at every call, and whether either is over its limit.

    ``log`` has judge, ts, tokens and a unique call id in ``call_id``. Each call is copied into the
    next time slice as history, so a slice of one model sees all it needs and no task ever holds a
    whole model.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slice_of = F.floor(F.col("_us") / span)
    copies = (
        log.withColumn("_us", at)
        .withColumn("_own_slice", slice_of)
        .withColumn(
            "_slice", F.explode(F.array(F.col("_own_slice"), F.col("_own_slice") + 1))
        )
    )
    recent = Window.partitionBy("judge", "_slice").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = copies.withColumn("requests_in_window", F.count(F.lit(1)).over(recent)).withColumn(
        "tokens_in_window", F.sum("tokens").over(recent)
    )
    limits = models.select(F.col("alias").alias("judge"), "rpm", "tpm")
    over = (F.col("requests_in_window") >= F.col("rpm") * reserve) | (
        F.col("tokens_in_window") > F.col("tpm") * reserve
    )
    return (
        counted.where(F.col("_slice") == F.col("_own_slice"))
        .join(limits, "judge", "left")
        .withColumn("over_limit", F.coalesce(over, F.lit(False)))
        .select(
            "call_id", "judge", "ts", "requests_in_window", "tokens_in_window", "over_limit"
        )
    )


def token_reservation(log: DataFrame, order: list[str], block: int = 4096) -> DataFrame:
    """Tokens to hold for each call, from what the last 64 calls of its model used.

    ``log`` has judge, prompt_tokens, max_tokens, used_tokens and the unique ``order`` columns.
    Calls are numbered per model and cut into blocks that carry the 64 calls before them, so the
    look-back never needs a whole model in one task.
    """
    placed = numbered(log, ["judge"], order, "_at").withColumn(
        "_own_block", F.floor((F.col("_at") - 1) / block)
    )
    ahead = F.floor((F.col("_at") - 1 + HISTORY) / block)
    copies = placed.withColumn(
        "_block", F.explode(F.sequence(F.col("_own_block"), ahead))
    )
    before = Window.partitionBy("judge", "_block").orderBy("_at").rowsBetween(-HISTORY, -1)
    history = copies.withColumn("_used", F.sort_array(F.collect_list("used_tokens").over(before)))
    size = F.size("_used")
    index = F.least(size - 1, F.floor(size * F.lit(0.9)).cast("int"))
    ninetieth = F.get(F.col("_used"), F.greatest(index, F.lit(0)))
    held = F.when(
        size >= MIN_HISTORY,
        F.floor(
            F.col("prompt_tokens")
            + F.least(F.col("max_tokens").cast("double"), ninetieth * F.lit(RESERVE_FACTOR))
        ),
    ).otherwise(F.col("prompt_tokens") + F.col("max_tokens"))
    return (
        history.where(F.col("_block") == F.col("_own_block"))
        .withColumn("reserved_tokens", held.cast("bigint"))
        .drop("_at", "_own_block", "_block", "_used")
    )
