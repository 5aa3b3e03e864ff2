"""No caps, no repeated calls, ranges that follow the data."""

import json
import random
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import accounting, judging, latency, ordered
from plumbline.operators import text_variants as tv
from plumbline.operators.arithmetic import evaluate
from plumbline.sources import qa_mining

FACT = "array<struct<key:string,value:string,kind:string,unit:string,required:boolean,clause:string>>"
ITEM = f"item_id string, domain string, context string, question string, facts {FACT}"


def item(name, domain, size):
    facts = [(f"k{i}", f"{name} {i}", "claim", "", True, "It says {value}.") for i in range(size)]
    return (name, domain, "c", "q", facts)


def test_a_long_item_among_short_ones_loses_no_replacement(spark):
    rows = [item("long", "d", 20)] + [item(f"s{i}", "d", 6) for i in range(11)]
    base = tv.with_source_record(spark.createDataFrame(rows, ITEM))
    out = {(r.item_id, r.severity): r for r in tv.build_variants(base, ["topic_drift"], (0.9, 1.0)).collect()}
    assert len(out["long", 0.9].facts_corrupted) == 18 and len(out["long", 1.0].facts_corrupted) == 20


def test_donors_grow_with_the_items(spark):
    rows = [item(f"i{i}", f"d{i % 2}", 4) for i in range(200)] + [item("lone", "alone", 4)]
    base = tv.with_source_record(spark.createDataFrame(rows, ITEM))
    donors = tv.with_donors(base).select("item_id", "domain", F.explode("donors.near").alias("near")).collect()
    served = Counter(r.near.item_id for r in donors if r.domain != "alone")
    assert len(served) == 200 and set(served.values()) == {tv.DONORS}
    assert all(r.near.item_id != r.item_id for r in donors)
    assert sum(r.item_id == "lone" for r in donors) == tv.DONORS
    variants = tv.build_variants(base, ["topic_drift"], (1.0,)).collect()
    assert all(len(r.facts_corrupted) == 4 for r in variants)


def test_rings_cut_into_chunks_give_the_same_donors(spark, monkeypatch):
    rows = [item(f"i{i}", f"d{i % 2}", 4) for i in range(120)] + [item(f"n{i}", None, 4) for i in range(3)]
    base = tv.with_source_record(spark.createDataFrame(rows, ITEM))

    def donors():
        found = tv.with_donors(base).select("item_id", F.col("donors.near.item_id").alias("near")).collect()
        return {r.item_id: r.near for r in found}

    whole = donors()
    monkeypatch.setattr(tv, "CHUNK_ROWS", 5)
    assert donors() == whole and whole["n0"] is None and len(whole["i0"]) == tv.DONORS


def test_a_sample_is_drawn_before_the_texts_are_made(spark):
    words = [("a", "alpha", "claim", "", True, "It was {value}."), ("b", "beta", "claim", "", True, "Then {value}.")]
    rows = [item(f"i{i}", "d", 4) for i in range(40)] + [("w", "d", "c", "q", words)]
    base = tv.with_source_record(spark.createDataFrame(rows, ITEM))
    drawn = tv.build_variants(base, sample_seed=tv.SEED)
    assert drawn.count() < 4 * 41
    for one, other in zip(tv.balanced_sample(base, drawn), tv.balanced_sample(base, tv.build_variants(base)), strict=True):
        assert sorted(one.collect()) == sorted(other.collect())


def test_references_beside_the_variants_make_the_same_pairs(spark):
    base = tv.with_source_record(spark.createDataFrame([item("i", "d", 3), item("i", "d", 4), item("k", "e", 2)], ITEM))
    kinds = ["omission", "fabrication", "verbosity"]
    beside = tv.gold_pairs(base, tv.build_variants(base, kinds, beside=tv.references(base)))
    assert sorted(beside.collect()) == sorted(tv.gold_pairs(base, tv.build_variants(base, kinds)).collect())
    assert beside.count() == 2 * 3 * 5


def test_any_nesting_of_arithmetic():
    assert evaluate("(" * 95 + "1" + ")" * 95) == "1"
    assert evaluate("-" * 150 + "2") == "2"
    assert [evaluate(e) for e in ("-2**2", "2**-1", "2**3**2", "7//2*2-1", "1)", "(1", "1 2", "2*", "")] == [
        "-4", "0.5", None, "5", None, None, None, None, None]


def test_no_call_is_made_twice(spark, tmp_path):
    log = str(tmp_path)

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        import uuid

        for budget in batch["max_tokens"]:
            with open(f"{log}/{uuid.uuid4().hex}", "w") as file:
                file.write(str(budget))
        cut = batch["max_tokens"] == batch["max_tokens"].min()
        return pd.DataFrame({"text": ["" if c else "SCORE: 4" for c in cut], "finish_reason": ["length" if c else "stop" for c in cut]})

    tasks = spark.createDataFrame([(f"u{i}", "j", "vague", f"p{i}", False) for i in range(6)],
                                  "uid string, judge string, config string, prompt string, reasoning boolean")
    done = judging.judge(tasks, scorer, piece_rows=1)
    for _ in range(3):
        assert done.count() == 6
    budgets = [path.read_text() for path in tmp_path.iterdir()]
    assert sorted(Counter(budgets).values()) == [6, 6]


def test_numbers_of_any_length_are_mined(spark):
    rng = random.Random(1)
    numbers = ["9" * 32, "0." + "1" * 12, "5", "4", "15", "25", "0", "0.5", "007", "99.95", "1" * 60 + ".55"]
    numbers += [f"{rng.randrange(10**rng.randrange(1, 40))}.{rng.randrange(10**6)}" for _ in range(40)]
    paragraphs = []
    for i, n in enumerate(numbers):
        context = f"At ({n}) it ends."
        answers = [{"text": n, "answer_start": 4}]
        paragraphs.append({"context": context, "qas": [{"id": str(i), "question": "?", "is_impossible": False, "answers": answers}]})
    source = spark.read.schema(qa_mining.SOURCE_SCHEMA).json(
        spark.sparkContext.parallelize([json.dumps({"data": [{"title": "T", "paragraphs": paragraphs}]})]))
    got = {int(r.id): r.candidate for r in qa_mining.eligible_pairs(source).collect()}
    with localcontext() as exact:
        exact.prec = 200
        for i, n in enumerate(numbers):
            value = Decimal(n)
            unit = Decimal(1).scaleb(value.as_tuple().exponent)
            want = value + max(unit, (value / 10).quantize(unit, ROUND_HALF_EVEN))
            assert got[i] == f"{want:f}", n


def test_error_classes_are_names(spark):
    rows = [("HTTPError: bad",), ("socket.timeout",), ("it broke: badly",), ("free text 1",), ("",), ("QuotaExhaustedError: x",)]
    df = spark.createDataFrame(rows, "error string").select(accounting.error_class(F.col("error")).alias("c"))
    assert [r.c for r in df.collect()] == ["HTTPError", "socket.timeout", "other", "other", None, "QuotaExhaustedError"]


def test_ranges_follow_the_rows_and_change_nothing(spark):
    rng = random.Random(2)
    values = rng.sample(range(100_000), 3000)
    rows = [("big", v, v % 7) for v in values] + [("small", v, 1) for v in values[:5]]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    tagged = ordered.with_chunk(df, ["g"], ["k"], range_rows=50)
    sizes = Counter((r.g, r._chunk) for r in tagged.collect())
    assert sum(g == "big" for g, _ in sizes) > 30 and max(sizes.values()) < 50 * 10
    for by in (["g"], []):
        base = df if by else df.where("g = 'big'")
        out = ordered.running(base, by, ["k"], {"up": "w"}, {"peak": "w"}, range_rows=50).collect()
        assert len(out) == base.count()
        for group in {r.g for r in out}:
            total, peak = 0, None
            for r in sorted((r for r in out if r.g == group), key=lambda r: r.k):
                total += r.w
                assert r.up == total and r.peak == peak
                peak = r.w if peak is None else max(peak, r.w)


def test_latest_rows_of_each_group(spark):
    rows = [("a", i * 37 % 1000, i) for i in range(1000)] + [("b", 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, t long, e long")
    got = latency.last_n(df, ["g"], ["t", "e"], 10).collect()
    assert sorted(r.t for r in got if r.g == "a") == list(range(990, 1000)) and len(got) == 12


def test_bootstrap_is_one_method_whatever_the_number_of_cells(spark):
    from plumbline.operators.bootstrap import bootstrap_ci, cluster_ci

    rng = random.Random(6)
    rows = [(g, rng.gauss(10, 3)) for g in ("a", "b") for _ in range(400)] + [("c", 1.0)] * 5
    df = spark.createDataFrame(rows, "g string, v double")
    one = {r.g: r for r in bootstrap_ci(df, ["g"], "v", 4000).collect()}
    many = {r.g: r for r in bootstrap_ci(df, ["g"], "v", 4000, block_cells=30).collect()}
    for g in ("a", "b"):
        values = pd.Series([v for k, v in rows if k == g])
        half = 1.96 * values.std() / len(values) ** 0.5
        for r in (one[g], many[g]):
            assert r.n == 400 and r.method == "bca" and abs(r.value - values.mean()) < 1e-9
            assert abs(r.lo - (values.mean() - half)) < half / 5 and abs(r.hi - (values.mean() + half)) < half / 5
    assert one["c"].method == many["c"].method == "wilson"
    whole = bootstrap_ci(df, [], "v", 500, block_cells=100).collect()
    assert len(whole) == 1 and whole[0].n == 805 and whole[0].lo < whole[0].value < whole[0].hi
    clusters = cluster_ci(df.withColumn("s", F.floor("v")), ["g"], "s", "v", 500).collect()
    assert {r.g: r.n_rows for r in clusters} == {"a": 400, "b": 400, "c": 5}


def test_blocks_of_a_replicate_add_up(spark):
    import numpy as np

    from plumbline.operators.bootstrap import _block_units, _paths

    totals = {None: [9], "a": [5, 0, 17, 3, 100, 1, 1], "b": [4, 4]}
    rows = [(g, 3 * i + 2, n) for g, blocks in totals.items() for i, n in enumerate(blocks)]  # block numbers with holes
    paths = _paths(spark.createDataFrame(rows[1:], "g string, _block long, _units long"), ["g"]).collect()
    assert len(paths) == 9 and all(len(r.path) <= 3 for r in paths)
    for g in ("a", "b"):
        own = sorted((r for r in paths if r.g == g), key=lambda r: r.place)
        assert [r._block for r in own] == [3 * i + 2 for i in range(len(own))]
        assert own[0].path[0].whole == sum(totals[g]) and own[0].path[0].hi == len(own)
        parts = np.array([_block_units(r.path, sum(totals[g]), 2000, 3, 9) for r in own])
        assert (parts.sum(axis=0) == sum(totals[g])).all()
        assert np.allclose(parts.mean(axis=1), totals[g], atol=0.5)


def test_poisson_interval_counts_units(spark):
    import numpy as np

    from plumbline.operators.bootstrap import poisson_ci

    rng = np.random.default_rng(8)
    values = rng.normal(3, 1, 500).round(1)
    rows = [("g", i, float(v)) for i, v in enumerate(values)] + [("g", i, 0.5) for i in range(100)] + [("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, u int, v double")
    sums = values + np.where(np.arange(500) < 100, 0.5, 0.0)
    sizes = np.where(np.arange(500) < 100, 2.0, 1.0)
    weights = rng.poisson(1, (4000, 500))
    want = np.quantile(weights @ sums / (weights @ sizes), [0.025, 0.975])
    for cells in (4096, 7):
        out = {r.g: r for r in poisson_ci(df, ["g"], "u", F.col("v"), F.lit(1), 4000, block_cells=cells).collect()}
        assert abs(out["g"].value - sums.sum() / sizes.sum()) < 1e-9
        assert abs(out["g"].lo - want[0]) < 0.03 and abs(out["g"].hi - want[1]) < 0.03
        assert out["one"].value == out["one"].lo == out["one"].hi == 2.0


def test_folds_always_exist(spark):
    from plumbline.operators.student import fit_student

    rng = random.Random(3)
    rows = [(([0, 1], [rng.random() + y, rng.random()]), y, f"g{k}") for k in range(7) for y in (0, 1) for _ in range(4)]
    schema = "features struct<indices:array<int>,values:array<double>>, teacher_label int, item_group string"
    student = fit_student(spark.createDataFrame(rows, schema), size=2)
    assert student.weights.shape == (3, 5) and len(student.calibrators) == 5
