"""Labels, splits, calibration, thresholds and operating points of the student."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.draws import draw
from plumbline.functions.intervals import wilson
from plumbline.operators.features import render_example
from plumbline.operators.ordered import mid_ranks, numbered, running

# Acceptance score, smallest class, probability clip, thresholds and margins tried.
ACCEPT_AT = 7.0
MIN_PER_CLASS = 6
MIN_GROUPS = 10
CLIP = 1e-6
THRESHOLDS = [float(c) for c in np.linspace(0.01, 0.99, 197)]
MARGINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.01]
MIN_CLASS_ROWS = 5


def label_from_scores(log: DataFrame, accept_at: float = ACCEPT_AT) -> DataFrame:
    """Teacher labels from scores, truth kept beside; rows without a score are dropped."""
    scored = log.where(F.col("score").isNotNull())
    return scored.select(
        "uid",
        "item_id",
        render_example(F.col("question"), F.col("answer"), F.col("context")).alias("text"),
        (F.col("score") >= accept_at).cast("int").alias("teacher_label"),
        F.col("is_reference").cast("int").alias("truth_label"),
        "degradation",
        "severity",
        F.col("score").alias("teacher_score"),
    )


def stratification_level(df: DataFrame, group: str, label: str) -> DataFrame:
    """The finest of (group and label, group, label) whose smallest class has enough rows."""
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    fine = cells.agg(F.min("n").alias("m"))
    by_group = cells.groupBy(group).agg(F.sum("n").alias("n")).agg(F.min("n").alias("m"))
    by_label = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(F.min("n").alias("m"))
    return fine.select(
        F.col("m").alias("min_group_label"),
        by_group.scalar().alias("min_group"),
        by_label.scalar().alias("min_label"),
    ).withColumn(
        "level",
        F.when(F.col("min_group_label") >= MIN_PER_CLASS, "group and label")
        .when(F.col("min_group") >= MIN_PER_CLASS, "group")
        .otherwise("label"),
    )


def group_split(
    df: DataFrame,
    group: str,
    seed: int = 20260731,
    test_size: float = 0.20,
    calibration_size: float = 0.20,
) -> DataFrame:
    """Adds ``split``: whole groups go to test, calibration or train, in hash order of the group.

    Test takes the share rounded up, calibration its share of the rest rounded up. Fewer than ten
    groups is an error.
    """
    groups = df.select(group).distinct().withColumn("_rank", draw(F.col(group), "split", seed))
    total = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = numbered(groups, [], ["_rank", group], "_at").withColumn("_n", total)
    enough = F.when(
        F.col("_n") < MIN_GROUPS, F.raise_error(F.lit(f"a split needs at least {MIN_GROUPS} groups"))
    ).otherwise(F.col("_n"))
    n_test = F.ceil(F.lit(test_size) * enough)
    n_calibration = F.ceil(F.lit(calibration_size / (1.0 - test_size)) * (F.col("_n") - n_test))
    named = placed.select(
        group,
        F.when(F.col("_at") <= n_test, "test")
        .when(F.col("_at") <= n_test + n_calibration, "calibration")
        .otherwise("train")
        .alias("split"),
    )
    return df.join(named, group)


def row_split(
    df: DataFrame,
    stratum: str,
    uid: str,
    seed: int = 20260731,
    test_size: float = 0.20,
    calibration_size: float = 0.20,
) -> DataFrame:
    """Adds ``split`` row by row, with the same shares inside every stratum."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(df.withColumn("_rank", draw(F.col(uid), "split", seed)), [stratum], ["_rank", uid], "_at")
    n_test = F.bround(F.lit(test_size) * F.col("_n"), 0)
    n_calibration = F.bround(F.lit(calibration_size) * F.col("_n"), 0)
    return (
        ranked.join(sizes, stratum)
        .withColumn(
            "split",
            F.when(F.col("_at") <= n_test, "test")
            .when(F.col("_at") <= n_test + n_calibration, "calibration")
            .otherwise("train"),
        )
        .drop("_rank", "_at", "_n")
    )


def calibration_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Rows, confidence and accuracy per probability bin. The first bin is closed on both sides, the
    others on the right; empty bins stay, with nulls."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    number = F.greatest(
        F.lit(1), sum((F.when(F.col(p) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    )
    counted = (
        df.where(F.col(p).isNotNull())
        .groupBy(number.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("confidence"),
            F.avg(F.col(y).cast("double")).alias("accuracy"),
        )
    )
    rows = [(i + 1, edges[i], edges[i + 1]) for i in range(bins)]
    dimension = df.sparkSession.createDataFrame(rows, "bin int, bin_lo double, bin_hi double")
    return dimension.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(table: DataFrame) -> DataFrame:
    """Expected calibration error of a calibration table."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return table.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def binary_metrics(df: DataFrame, p: str, y: str) -> DataFrame:
    """Brier score, log loss, AUC, accuracy at one half; AUC is NaN with a single class."""
    truth, prob = F.col(y).cast("double"), F.col(p)
    clipped = F.least(F.greatest(prob, F.lit(CLIP)), F.lit(1 - CLIP))
    basics = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((prob - truth) * (prob - truth)).alias("brier"),
        F.avg(-(truth * F.ln(clipped) + (1 - truth) * F.ln(1 - clipped))).alias("log_loss"),
        F.avg(F.when((prob >= 0.5).cast("int") == F.col(y), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    histogram = df.groupBy(prob.alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("bigint")).alias("_pos")
    )
    ranked = mid_ranks(histogram, [], "_p", "_n")
    sums = ranked.agg(
        F.sum("_pos").cast("double").alias("pos"),
        F.sum("_n").cast("double").alias("all"),
        F.sum(F.col("_pos") * F.col("mid_rank")).alias("ranks"),
    )
    pairs = F.col("pos") * (F.col("all") - F.col("pos"))
    wins = F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2
    auc = sums.select(F.coalesce(wins / F.when(pairs > 0, pairs), F.lit(float("nan"))).alias("auc"))
    return basics.withColumn("auc", auc.scalar())


def threshold_table(df: DataFrame, p: str, y: str, cuts: list[float] | None = None) -> DataFrame:
    """Allowed and blocked rows by truth at every candidate threshold.

    Each probability is first counted under the number of thresholds it reaches, so what is summed
    up per threshold is at most one row per threshold and truth.
    """
    values = THRESHOLDS if cuts is None else cuts
    reached = F.size(F.filter(F.array(*[F.lit(c) for c in values]), lambda c: c <= F.col("_p")))
    by_p = df.groupBy(F.col(p).alias("_p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    counted = by_p.groupBy(reached.alias("at")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = [(i, c) for i, c in enumerate([float("nan"), *values])]
    dimension = df.sparkSession.createDataFrame(rows, "at int, threshold double")
    filled = dimension.join(counted, "at", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return filled.select(
        "at",
        "threshold",
        F.sum("pos").over(above).alias("allowed_good"),
        F.sum("neg").over(above).alias("allowed_bad"),
        F.sum("pos").over(everything).alias("good"),
        F.sum("neg").over(everything).alias("bad"),
    ).where(F.col("at") > 0).drop("at")


def choose_threshold(
    df: DataFrame, p: str, y: str, max_false_allow: float = 0.10
) -> DataFrame:
    """The threshold with the best balanced accuracy among those that let at most the given share of
    bad rows through; the lowest on ties, one half if none is feasible."""
    table = threshold_table(df, p, y)
    allowed = F.col("allowed_good") + F.col("allowed_bad")
    false_allow = F.col("allowed_bad") / F.when(allowed > 0, allowed)
    tpr = F.coalesce(F.col("allowed_good") / F.when(F.col("good") > 0, F.col("good")), F.lit(0.0))
    tnr = F.coalesce(
        (F.col("bad") - F.col("allowed_bad")) / F.when(F.col("bad") > 0, F.col("bad")), F.lit(0.0)
    )
    scored = table.withColumn("score", (tpr + tnr) / 2).withColumn(
        "feasible", F.coalesce(false_allow <= max_false_allow, F.lit(False))
    )
    best = scored.agg(
        F.min(F.when(F.col("feasible"), F.struct(-F.col("score"), F.col("threshold")))).alias("b")
    )
    return best.select(
        F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
        F.col("b").isNotNull().alias("feasible"),
    )


def oracle_cut(df: DataFrame, score: str, y: str, default: float = ACCEPT_AT) -> DataFrame:
    """The observed score that separates best as a cut, the lowest on ties, and its accuracy."""
    histogram = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("cut"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    totals = histogram.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("t"))
    ranked = running(histogram, [], ["cut"], {"_pos": "pos", "_neg": "neg"}).withColumn(
        "_t", totals.scalar()
    )
    right = (F.col("_neg") - F.col("neg")) + (F.col("_t.pos") - F.col("_pos") + F.col("pos"))
    accuracy = right / (F.col("_t.pos") + F.col("_t.neg"))
    best = ranked.withColumn("acc", accuracy).agg(
        F.min(F.when(F.col("acc") > 0, F.struct(-F.col("acc"), F.col("cut"), F.col("acc")))).alias("b")
    )
    return best.select(
        F.coalesce("b.cut", F.lit(default)).alias("cut"),
        F.coalesce("b.acc", F.lit(0.0)).alias("accuracy"),
    )


def operating_point(df: DataFrame, p: str, y: str, threshold: float | Column) -> DataFrame:
    """Block precision, false blocks, caught output, false allows, block rate, accuracies."""
    at = F.lit(threshold) if isinstance(threshold, float) else threshold
    allow, good = F.col(p) >= at, F.col(y) == 1
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(good).alias("good"),
        F.count_if(~allow).alias("blocked"),
        F.count_if(~allow & ~good).alias("blocked_bad"),
        F.count_if(allow & ~good).alias("allowed_bad"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.greatest(bottom, F.lit(1)).cast("double")

    n, good_n, blocked, hit, leak = (
        F.col(c) for c in ("n", "good", "blocked", "blocked_bad", "allowed_bad")
    )
    bad_n, false_block = n - good_n, blocked - hit
    nan = F.lit(float("nan"))
    tpr = F.when(good_n > 0, ratio(good_n - false_block, good_n)).otherwise(nan)
    tnr = F.when(bad_n > 0, ratio(hit, bad_n)).otherwise(nan)
    return counted.select(
        "n",
        ratio(hit, blocked).alias("block_precision"),
        ratio(false_block, good_n).alias("false_block_rate"),
        ratio(hit, bad_n).alias("bad_output_caught"),
        ratio(leak, n - blocked).alias("false_allow_rate"),
        ratio(blocked, n).alias("block_rate"),
        ratio(n - false_block - leak, n).alias("accuracy"),
        ((tpr + tnr) / 2).alias("balanced_accuracy"),
        ratio(F.greatest(good_n, bad_n), n).alias("majority_baseline"),
    )


def fidelity(
    df: DataFrame, student: str, teacher: str, y: str, group: str = "degradation"
) -> DataFrame:
    """Accuracy of student and teacher decisions per class with at least five rows, and whether a
    class is the student's weakest (first name on ties)."""
    right = (F.col(student) == F.col(y)).cast("int")
    taught = (F.col(teacher) == F.col(y)).cast("int")
    counted = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("_s"), F.sum(taught).alias("_t")
    ).where(F.col("n") >= MIN_CLASS_ROWS)
    low, high = wilson(F.col("_s"), F.col("n"))
    report = counted.select(
        group,
        "n",
        (F.col("_s") / F.col("n")).alias("student_accuracy"),
        low.alias("lo"),
        high.alias("hi"),
        (F.col("_t") / F.col("n")).alias("teacher_accuracy"),
    )
    weakest = report.agg(F.min(F.struct("student_accuracy", group)).getField(group).alias("w"))
    return report.withColumn("blind_spot", F.col(group) == weakest.scalar())


def cascade(
    df: DataFrame,
    p: str,
    student_correct: str,
    teacher_correct: str,
    threshold: float,
    cost_per_1k: float = 0.0,
    student_ms: float = 0.0,
    teacher_ms: float = 0.0,
    margins: list[float] | None = None,
) -> DataFrame:
    """What it takes to send unsure rows to the teacher, per confidence margin; ``viable`` margins
    keep the teacher's own accuracy inside their interval, ``recommended`` escalates least."""
    confidence = F.abs(F.col(p) - threshold) / max(threshold, 1 - threshold)
    margin = F.explode(F.array(*[F.lit(float(m)) for m in (margins or MARGINS)])).alias("margin")
    local = F.col("_confidence") >= F.col("margin")
    answer = F.when(local, F.col(student_correct)).otherwise(F.col(teacher_correct))
    spread = df.select(
        confidence.alias("_confidence"), student_correct, teacher_correct
    ).select("*", margin)
    counted = spread.groupBy("margin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~local).alias("_sent"),
        F.sum(answer).alias("_right"),
        F.avg(F.col(teacher_correct).cast("double")).alias("_judge_only"),
    )
    low, high = wilson(F.col("_right"), F.col("n"))
    sent = F.col("_sent") / F.col("n")
    rows = counted.select(
        "margin",
        sent.alias("escalation_rate"),
        (F.col("_right") / F.col("n")).alias("combined_accuracy"),
        low.alias("lo"),
        high.alias("hi"),
        (sent * cost_per_1k).alias("cost_per_1k_usd"),
        (F.lit(student_ms) + sent * teacher_ms).alias("mean_latency_ms"),
        ((low <= F.col("_judge_only")) & (F.col("_judge_only") <= high)).alias("viable"),
    )
    best = rows.where("viable").agg(
        F.min(F.struct("escalation_rate", "margin")).getField("margin").alias("m")
    )
    return rows.withColumn(
        "recommended", F.coalesce(F.col("margin") == best.scalar(), F.lit(False))
    )


def pick_teacher(ablation: DataFrame, discrimination: DataFrame, panel: DataFrame) -> DataFrame:
    """The (judge, config) to learn from: best of the ablation, else best of the discrimination
    report, else the first of the panel. Ties go to the first name.

    Reports have judge, config and accuracy; the panel has judge, config and position.
    """
    ranked = (
        ablation.select("judge", "config", F.lit(0).alias("priority"), (-F.col("accuracy")).alias("order"))
        .unionByName(
            discrimination.select(
                "judge", "config", F.lit(1).alias("priority"), (-F.col("accuracy")).alias("order")
            )
        )
        .unionByName(
            panel.select(
                "judge", "config", F.lit(2).alias("priority"), F.col("position").cast("double").alias("order")
            )
        )
    )
    known = ranked.where(F.col("order").isNotNull())
    return known.agg(F.min(F.struct("priority", "order", "judge", "config")).alias("b")).select(
        "b.judge", "b.config", "b.priority"
    )
