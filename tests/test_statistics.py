import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators import agreement, bootstrap, ordered, power


def flags(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_running_totals_equal_plain_window_under_skew(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(rng.integers(0, 4000))) for i in range(9000)]
    hist = (
        spark.createDataFrame(rows, "g string, v long").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = hist.withColumn("c", F.sum("n").over(upto)).withColumn("m", F.max("n").over(before))
    for parts in (1, 3, 16):
        got = ordered.running(hist.repartition(parts), ["g"], ["v"], {"c": "n"}, {"m": "n"})
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_take_first_by_rank_equals_limit(spark):
    df = spark.range(0, 5000).withColumn("k", F.xxhash64("id"))
    want = {r.id for r in df.orderBy("k").limit(700).collect()}
    assert {r.id for r in ordered.take_first(df, ["k", "id"], 700, small=0).collect()} == want


def test_wilson_known_value_and_empty(spark):
    row = (
        spark.createDataFrame([(8, 10), (0, 0)], "k long, n long")
        .select("n", *[c.alias(a) for c, a in zip(wilson(F.col("k"), F.col("n")), ("lo", "hi"))])
        .orderBy(F.desc("n"))
        .collect()
    )
    assert row[0].lo == pytest.approx(0.4901625, abs=1e-6)
    assert row[0].hi == pytest.approx(0.9433178, abs=1e-6)
    assert math.isnan(row[1].lo) and math.isnan(row[1].hi)


def test_holm_first_value(spark):
    df = flags(spark, [(i, p) for i, p in enumerate([0.001, 0.02, 0.04, 0.3])], "id long, p double")
    out = {r.id: r for r in agreement.holm(df, [], "p", ["id"]).collect()}
    assert out[0].p_adjusted == pytest.approx(0.004)
    assert out[1].p_adjusted == pytest.approx(0.06)
    assert out[3].p_adjusted == pytest.approx(0.3)
    assert [out[i].reject for i in range(4)] == [True, False, False, False]


def test_mcnemar_exact_and_large(spark):
    counts = flags(spark, [(1, 6, 1), (2, 0, 0), (3, 40, 10)], "id long, b long, c long")
    out = {r.id: r for r in agreement.mcnemar_from_counts(counts).collect()}
    assert out[1].exact and out[1].p_value == pytest.approx(0.125)
    assert out[2].p_value == 1.0
    assert not out[3].exact
    assert out[3].statistic == pytest.approx(29 * 29 / 50)
    assert out[3].p_value == pytest.approx(math.erfc(math.sqrt(29 * 29 / 100)))


def test_kappa_and_alpha_identities(spark):
    same = flags(spark, [(i, "ab"[i % 2], "ab"[i % 2]) for i in range(20)], "i long, a string, b string")
    assert agreement.kappa(same, [], "a", "b").first().kappa == pytest.approx(1.0)
    constant = flags(spark, [(i, "a", "b") for i in range(5)], "i long, a string, b string")
    assert agreement.kappa(constant, [], "a", "b").first().kappa == 0.0
    ratings = flags(
        spark,
        [("g", i, r) for i in range(10) for r in ("x", "x" if i < 8 else "y")]
        + [("g", 99, "y"), ("lonely", 1, "x")],
        "g string, item long, rating string",
    )
    out = {r.g: r.alpha for r in agreement.krippendorff(ratings, ["g"], "item", "rating").collect()}
    disagreement = 4 / 20
    expected = 1 - (18 * 17 + 2 * 1) / (20 * 19)
    assert out["g"] == pytest.approx(1 - disagreement / expected)
    assert math.isnan(out["lonely"])


def test_cliffs_delta_signs_and_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 60), rng.integers(2, 11, 45)
    rows = [(True, int(v)) for v in a] + [(False, int(v)) for v in b]
    got = agreement.cliffs_delta(flags(spark, rows, "s boolean, v int"), [], F.col("s"), "v").first()
    want = (np.sign(a[:, None] - b[None, :])).sum() / (len(a) * len(b))
    assert got.delta == pytest.approx(want)


def test_spearman_perfect_order_and_constant(spark):
    rows = [("up", i, i * i) for i in range(12)] + [("flat", i, 3) for i in range(5)]
    out = {r.g: r for r in agreement.spearman(flags(spark, rows, "g string, x int, y int"), ["g"], "x", "y").collect()}
    assert out["up"].rho == pytest.approx(1.0) and out["up"].p_value == pytest.approx(0.0, abs=1e-9)
    assert math.isnan(out["flat"].rho)


def test_bca_brackets_mean_and_agrees_between_paths(spark):
    rng = np.random.default_rng(11)
    rows = [("a", float(v)) for v in rng.normal(5, 2, 400)]
    df = flags(spark, rows, "g string, v double")
    exact = bootstrap.bootstrap_ci(df, ["g"], "v", 2000).first()
    spread = bootstrap.bootstrap_ci(df, ["g"], "v", 2000, block_cells=10).first()
    mean = np.mean([r[1] for r in rows])
    error = np.std([r[1] for r in rows]) / math.sqrt(len(rows))
    for out in (exact, spread):
        assert out.method == "bca" and out.value == pytest.approx(mean)
        assert out.lo == pytest.approx(mean - 1.96 * error, abs=0.06)
        assert out.hi == pytest.approx(mean + 1.96 * error, abs=0.06)


def test_bootstrap_coverage_on_flags(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(v)) for g in range(60) for v in rng.random(120) < 0.72]
    out = bootstrap.bootstrap_ci(flags(spark, rows, "g int, v int"), ["g"], "v", 800).collect()
    covered = sum(r.lo <= 0.72 <= r.hi for r in out)
    assert covered >= 50


def test_degenerate_groups(spark):
    rows = [("ones", 1.0)] * 10 + [("flat", 4.0)] * 5
    out = {r.g: r for r in bootstrap.bootstrap_ci(flags(spark, rows, "g string, v double"), ["g"], "v", 100).collect()}
    assert out["ones"].method == "wilson" and out["ones"].lo < 1.0
    assert out["flat"].method == "degenerate" and out["flat"].lo == 4.0


def test_paired_difference_and_misalignment(spark):
    rows = [(float(i % 5) + 1.0, float(i % 5)) for i in range(50)]
    out = bootstrap.paired_diff(flags(spark, rows, "a double, b double"), [], "a", "b", 500).first()
    assert out.diff == 1.0 and out.lo == 1.0 and out.significant and out.n == 50
    broken = flags(spark, [(1.0, None), (1.0, 1.0)], "a double, b double")
    with pytest.raises(Exception, match="both values"):
        bootstrap.paired_diff(broken, [], "a", "b", 50).collect()


def test_cluster_interval_resamples_whole_clusters(spark):
    rows = [(c, 1 if c % 4 else 0) for c in range(40) for _ in range(25)]
    df = flags(spark, rows, "c int, v int")
    clustered = bootstrap.cluster_ci(df, [], "c", "v", 2000).first()
    naive = bootstrap.bootstrap_ci(df, [], "v", 2000).first()
    assert clustered.n_clusters == 40 and clustered.value == pytest.approx(0.75)
    assert clustered.hi - clustered.lo > 2 * (naive.hi - naive.lo)


def test_sample_size_golden_value(spark):
    df = flags(spark, [(600, 0.80, 0.73)], "n long, p1 double, p2 double")
    out = power.power_report(df, "n", "p1", "p2").first()
    assert out.n_required == 575 and out.adequate and 0.80 < out.power < 0.83


def test_holm_queries_keep_well_supported_tests(spark, folder, monkeypatch):
    from plumbline.plans import bias, load_all
    from plumbline.plans.registry import QUERIES

    load_all()
    rows = [("s1", "j", "d", 0.5, 1, 0)] * 40 + [("s1", "j", "d", 0.5, 0, 1)] * 5  # 45 discordant pairs
    rows += [("s2", "j", "d", 0.5, 1, 0)] * 6 + [("s3", "j", "d", 0.5, 1, 1)] * 9
    frame = spark.createDataFrame(
        rows, "source_id string, judge string, degradation string, severity double, correct_ref_first int, correct_deg_first int"
    )
    monkeypatch.setattr(bias, "outcomes", lambda t: frame)
    out = {r.source_id: r for r in QUERIES["holm_adjusted"](spark, folder).collect()}
    assert {r.n_tests for r in out.values()} == {3} and set(out) == {"s1", "s2", "s3"}
    chi = (40 - 5 - 1) ** 2 / 45
    assert out["s1"].p_adjusted == pytest.approx(3 * math.erfc(math.sqrt(chi / 2)), abs=1e-6) and out["s1"].reject
    assert out["s2"].p_adjusted == pytest.approx(2 * 2 / 2**6, abs=1e-6) and out["s3"].p_adjusted == 1
    assert [tuple(r) for r in QUERIES["holm_summary"](spark, folder).collect()] == [("j", 3, 1)]
