import json

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import calibration, features, student
from plumbline.operators.latency import last_n_latency
from plumbline.streaming import operators as streams


SMALL = {"word_features": 256, "char_features": 128}


def small_features(df):
    return features.hashing_features(df, **SMALL)


def small_predict(df, model):
    return student.predict_texts(df, model, **SMALL)


def examples(spark):
    rows = []
    for g in range(30):
        for good in (0, 1):
            answer = f"The dose was {g}.5 mg at site {g}." if good else "It was generally a modest amount, perhaps."
            rows.append((f"g{g}:{good}", f"g{g}", f"QUESTION: What dose?\n[SEP]\nANSWER: {answer}", good, good))
    return spark.createDataFrame(
        rows, "uid string, item_group string, text string, teacher_label int, truth_label int"
    )


def test_student_learns_saves_and_guards_a_stream(spark, tmp_path):
    split = calibration.group_split(small_features(examples(spark)), "item_group").persist()
    sides = split.groupBy("item_group").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").isEmpty()
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count_distinct("item_group").alias("n")).collect()} == {
        "test": 6, "calibration": 6, "train": 18,
    }
    model = student.fit_student(split.where("split = 'train'"), size=256 + 128 + 18)
    model = student.recalibrate(model, split.where("split = 'calibration'"))
    test = model.predict(split.where("split = 'test'"))
    point = calibration.operating_point(test, "p", "truth_label", model.threshold).first()
    assert point.accuracy == 1.0
    student.save_student(model, spark, f"{tmp_path}/model")
    loaded = student.load_student(spark, f"{tmp_path}/model")
    (tmp_path / "in").mkdir()
    requests = [
        {"question": "What dose?", "answer": "It was generally a modest amount, perhaps.", "context": ""},
        {"question": "What dose?", "answer": "The dose was 7.5 mg at site 7.", "context": ""},
    ]
    (tmp_path / "in" / "r.json").write_text("\n".join(json.dumps(r) for r in requests))
    stream = spark.readStream.schema("question string, answer string, context string").json(f"{tmp_path}/in")
    run = (
        streams.stream_guard(stream, loaded, predict=small_predict)
        .writeStream.format("memory").queryName("guarded").start()
    )
    run.processAllAvailable()
    run.stop()
    out = {r.answer[:3]: r for r in spark.table("guarded").collect()}
    assert out["It "].decision == "block" and "hedge" in out["It "].reason
    assert out["The"].decision == "allow"
    split.unpersist()


def test_threshold_brute_force(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    p = np.clip(y * 0.3 + rng.random(300) * 0.7, 0, 1).round(3)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    best, best_score = 0.5, -1.0
    for cut in np.linspace(0.01, 0.99, 197):
        allow = p >= cut
        if not allow.any() or ((y == 0) & allow).sum() / allow.sum() > 0.2:
            continue
        score = (allow[y == 1].mean() + (~allow)[y == 0].mean()) / 2
        if score > best_score:
            best, best_score = float(cut), score
    assert calibration.choose_threshold(df, "p", "y", 0.2).first().threshold == best
    none = df.withColumn("y", F.lit(0))
    assert calibration.choose_threshold(none, "p", "y", 0.2).first().threshold == 0.5


def test_last_n_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    schema = "event_id long, endpoint string, ms double, is_error boolean, ts timestamp"
    df = spark.range(0, 600).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("endpoint"),
        (F.col("id") * 37 % 101).cast("double").alias("ms"),
        F.lit(False).alias("is_error"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
    )
    for i in range(3):
        df.where(F.col("event_id").between(200 * i, 200 * i + 199)).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run = streams.stream_last_n(stream, f"{tmp_path}/state", f"{tmp_path}/progress", n=50)
    run.processAllAvailable()
    run.stop()
    want = {r.endpoint: r for r in last_n_latency(df, 50).collect()}
    got = spark.read.parquet(f"{tmp_path}/state/summary/2").collect()
    assert len(got) == 2
    for row in got:
        assert row.n == 50 and row.p95 == want[row.endpoint].p95 and row.mean == want[row.endpoint].mean


def test_stream_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {
        "task": "t", "final_answer": "58",
        "steps": [{"tool": "lookup", "args": {"key": "fleet_size"}, "result": "58"}],
    }
    rows = [{"trace_id": "a", "payload": json.dumps(good)}, {"trace_id": "b", "payload": "[]"}]
    (tmp_path / "in" / "t.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("trace_id string, payload string").json(f"{tmp_path}/in")
    run = streams.stream_audit(stream, f"{tmp_path}/out", f"{tmp_path}/progress")
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(f"{tmp_path}/out/verdicts").first().status == "consistent"
    assert spark.read.parquet(f"{tmp_path}/out/rejected").first().trace_id == "b"


def test_split_needs_ten_groups(spark):
    few = examples(spark).where(F.col("item_group").isin("g1", "g2"))
    try:
        calibration.group_split(few, "item_group").collect()
    except Exception as problem:
        assert "10 groups" in str(problem)
    else:
        raise AssertionError("a split of two groups must fail")
