"""Some queries against their SQL twins; set PLUMBLINE_ALL_QUERIES=1 for all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from check_oracle import rows_of

FAST = [
    "discrimination_report", "swap_resolution", "flip_rates", "kappa_of_orders", "cost_accuracy",
    "latency_summary", "rate_windows", "step_status", "trace_audit", "pair_evidence_summary",
    "parsed_scores", "calibration_table", "chosen_threshold", "usage_windows",
]
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("PLUMBLINE_ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, sql, name):
    df = entry_point.queries()[name](spark, folder)
    cursor = sql.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
