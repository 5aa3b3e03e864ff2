import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.extraction import score_of, verdict_of
from plumbline.functions.sql_functions import register
from plumbline.operators import evidence, judging, swaps
from plumbline.sources import tables

SCORES = [
    ("SCORE: 7.5", 7.5),
    ("**SCORE:** 3", 3.0),
    ("REASONING: blah\nSCORE: 9.1", 9.1),
    ("8", 8.0),
    ("I rate this 6/10", 6.0),
    ("no number here", None),
    ("SCORE: 42", None),
    ("<think>SCORE: 9", None),
    ("<think>SCORE: 9</think>", None),
    ("<think>SCORE: 9</think>\nSCORE: 4", 4.0),
]
VERDICTS = [
    ("VERDICT: A", "A"),
    ("verdict: b", "B"),
    ("VERDICT: tie", "tie"),
    ("Answer A is better overall", "A"),
    ("nothing", None),
    ("<think>VERDICT: A", None),
]


def test_score_table(spark):
    df = spark.createDataFrame(SCORES, "t string, want double")
    for row in df.withColumn("got", score_of(F.col("t"))).collect():
        assert row.got == row.want, row.t


def test_verdict_table(spark):
    df = spark.createDataFrame(VERDICTS, "t string, want string")
    for row in df.withColumn("got", verdict_of(F.col("t"))).collect():
        assert row.got == row.want, row.t


def test_sql_functions_agree_with_columns(spark):
    names = register(spark)
    assert "judge_score" in names
    spark.createDataFrame(SCORES, "t string, want double").createOrReplaceTempView("score_texts")
    for row in spark.sql("select want, judge_score(t) as got from score_texts").collect():
        assert row.got == row.want


def tasks(spark):
    rows = [
        ("u1", "j", "vague", "text", "ctx", "q", "good", "SECRET"),
        ("u2", "j", "rubric", "text", "ctx", "q", "long", "SECRET"),
        ("u3", "j", "cot", "trajectory", "ctx", "q", "bad", "SECRET"),
    ]
    schema = (
        "uid string, judge string, config string, kind string, context string, question string, "
        "answer string, reference string"
    )
    return spark.createDataFrame(rows, schema).withColumn("reasoning", F.lit(False))


def test_prompts_never_show_the_reference(spark):
    for row in judging.with_prompt(tasks(spark)).collect():
        assert "SECRET" not in row.prompt and row.answer in row.prompt
        assert ("DECLARED ACTION SPACE" in row.prompt) == (row.kind == "trajectory")


def test_batch_judging_keeps_errors_apart_and_retries_once(spark):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["answer"] == "bad").any():
            raise RuntimeError("broken row")
        short = (batch["answer"] == "long") & (batch["max_tokens"] < 300)
        return pd.DataFrame(
            {
                "text": ["" if s else "SCORE: 8" for s in short],
                "finish_reason": ["length" if s else "stop" for s in short],
            }
        )

    prompts = judging.with_prompt(tasks(spark)).drop("reference")
    out = {r.uid: r for r in judging.judge(prompts, scorer).collect()}
    assert len(out) == 3
    assert out["u1"].score == 8.0 and not out["u1"].retried
    assert out["u2"].score == 8.0 and out["u2"].retried and out["u2"].max_tokens == 320
    assert out["u3"].score is None and out["u3"].error.startswith("RuntimeError")


def test_request_key_holds_every_input(spark):
    base = dict(
        provider="p", model="m", prompt="x", base_url="", max_tokens=10, temperature=0.0, replicate=0
    )
    rows = [base] + [{**base, k: v} for k, v in dict(provider="q", model="n", prompt="y", base_url="u", max_tokens=11, temperature=0.5, replicate=1).items()]
    df = spark.createDataFrame([tuple(r[k] for k in base) for r in rows],
        "provider string, model string, prompt string, base_url string, max_tokens int, temperature double, replicate int")
    keyed = judging.with_request_key(df)
    assert keyed.select("request_key").distinct().count() == len(rows)
    store = keyed.limit(1).select("request_key", F.lit("SCORE: 5").alias("text"))
    hits, misses = judging.reuse(keyed.unionByName(keyed), store)
    assert hits.count() == 2 and misses.count() == len(rows) - 1


def test_swap_resolution_invariants(spark):
    rows = [
        (uid, "j", "pairwise", 0, first, v, 10, 1.0, 0.1, "d", 0.5)
        for uid, fwd, rev in [("a", "A", "B"), ("b", "A", "A"), ("c", "tie", "tie"), ("d", None, "B")]
        for first, v in ((True, fwd), (False, rev))
    ]
    schema = (
        "uid string, judge string, config string, replicate int, reference_first boolean, verdict string, "
        "tokens int, latency_ms double, cost_usd double, degradation string, severity double"
    )
    df = spark.createDataFrame(rows, schema)
    for parts in (1, 5):
        out = {r.uid: r for r in swaps.resolve_swaps(df.repartition(parts)).collect()}
        assert out["a"].verdict == "REF" and out["a"].correct_swapped == 1 and out["a"].tokens == 20
        assert out["b"].verdict == "inconsistent" and out["b"].correct_swapped == 0
        assert out["b"].correct_ref_first == 1 and out["b"].correct_deg_first == 0
        assert out["c"].consistent and out["c"].correct_swapped == 0
        assert not out["d"].parsed_ok and not out["d"].consistent


def evidence_tables(spark):
    pairs = spark.createDataFrame([(f"p{i}", f"s{i}") for i in range(3)], "id string, source_id string")
    scores = [(9.0, 2.0), (9.0, 9.0), (None, 2.0)]
    rows = [
        (f"p{i}", f"s{i}", role, s, "" if s is None else f"SCORE: {s:g}", 5, 1, "m", False, False, "stop")
        for i, pair in enumerate(scores)
        for role, s in zip(("reference", "candidate"), pair)
    ]
    log = spark.createDataFrame(
        rows,
        "pair_id string, source_id string, role string, score double, text string, prompt_tokens int, "
        "completion_tokens int, model_served string, simulated boolean, cached boolean, finish_reason string",
    )
    return pairs, log


def test_ties_and_parse_failures_count_as_failures(spark):
    pairs, log = evidence_tables(spark)
    out = evidence.summarize_pairs(pairs, log).first()
    assert out.accuracy == pytest.approx(1 / 3) and out.pairs_with_parse_failure == 1 and out.complete


def test_resume_publish_and_refusal(spark, tmp_path):
    pairs, log = evidence_tables(spark)
    assert evidence.plan_resume(pairs, log.limit(0), 4).count() == 4
    assert evidence.plan_resume(pairs, log, 10).count() == 0
    path = f"{tmp_path}/log"
    evidence.append_log(log, path, "settings-1")
    with pytest.raises(ValueError):
        evidence.append_log(log, path, "settings-2")
    assert evidence.publish(pairs, log, str(tmp_path), "run", {"mode": "live"}) == 1
    again = evidence.published_summary(spark, str(tmp_path), "run")
    assert evidence.summary_matches(evidence.summarize_pairs(pairs, log), again)
    # a writer that is still at work is not seen, and its number is taken
    tables.create_file(spark, f"{tmp_path}/run/versions/0000000002", "")
    assert evidence.published_version(spark, str(tmp_path), "run") == 1
    with pytest.raises(evidence.Conflict, match="another writer"):
        evidence.publish(pairs, log, str(tmp_path), "run", {"mode": "live"})
    with pytest.raises(evidence.Conflict, match="not 0"):
        evidence.publish(pairs, log, str(tmp_path), "run", {"mode": "live"}, expected_version=0)
    assert evidence.published(spark, str(tmp_path), "run", 1)["manifest"]["parts"] == {"evidence": log.count(), "summary": 1}
    with pytest.raises(FileNotFoundError):
        evidence.published(spark, str(tmp_path), "nothing")
    with pytest.raises(ValueError, match="missing"):
        evidence.publish(pairs, log.limit(5), str(tmp_path), "other", {"mode": "live"})
