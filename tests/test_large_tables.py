"""Work and data movement of the queries that large tables stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, discrimination, verbosity
from plumbline.plans.registry import Inputs
from plumbline.plans.shared import drained, spread, table_stream


def test_references_are_not_broadcast(spark):
    parts = spark.range(100).select(F.col("id").cast("string").alias("item_id"), F.explode(F.array(F.lit("j0"), F.lit("j1"))).alias("judge"))
    references = parts.withColumn("score", F.lit(5.0))
    judged = parts.withColumn("score", F.lit(4.0))
    for joined in (discrimination.discrimination_rows(judged, references), verbosity.padded_pairs(judged, references)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert joined.count() == 200


@pytest.mark.parametrize("parts", [None, 3])
def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path, parts):
    path, rows = f"{tmp_path}/things.parquet", spark.range(10)
    if parts:
        rows.repartition(parts).write.parquet(path)
    else:
        rows.toPandas().to_parquet(path)
    spark.range(5).write.parquet(f"{tmp_path}/others.parquet")
    found = drained(table_stream(Inputs(spark, str(tmp_path)), "things"), "append")
    assert sorted(r.id for r in found.collect()) == list(range(10))


def test_draws_of_units_have_the_spread_of_multinomial_draws():
    rng = np.random.default_rng(5)
    x, size, count = rng.normal(10, 3, 500), rng.integers(1, 4, 500).astype(float), rng.integers(1, 5, 500)
    units = rng.integers(0, 2 * count.sum(), 4000)
    units[:3] = 0
    top, bottom = bootstrap._block_sums(x, size, count, units, rng)
    assert not top[:3].any() and not bottom[:3].any()
    mean = (x * count).sum() / count.sum()
    spread = np.sqrt((count * (x - mean) ** 2).sum() / count.sum())
    z = (top[3:] - units[3:] * mean) / (spread * np.sqrt(np.maximum(units[3:], 1)))
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06
    weighed = (size * count).sum() / count.sum()
    assert abs((bottom.sum() / units.sum()) / weighed - 1) < 0.01


def test_blocks_are_dealt_to_many_tasks(spark, monkeypatch):
    rows = spark.range(40_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(bootstrap, "BLOCK_CELLS", 1000)
    found = bootstrap.bootstrap_ci(rows, ["g"], "x", resamples=50, block_cells=1000)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(g") and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    one = found.first()
    assert one.lo < one.value < one.hi and one.n == 40_000


def test_judgments_are_sorted_in_parts_of_bounded_size(spark):
    rows = spark.range(1000).select((F.col("id") % 90).cast("string").alias("item_id"), F.lit("j0").alias("judge"))
    assert spread(rows, ["judge", "item_id"], rows=50).rdd.getNumPartitions() == 20
    assert spread(rows, ["judge", "item_id"]).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
