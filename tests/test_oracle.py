"""Registered queries vs their DuckDB oracles on the smallest fixture (the
full set runs with tools/oracle_check.py at sf0.01)."""

import duckdb
import pytest
from conftest import SF_SMALL

from riskframe.plans.registry import load_all
from tools.oracle_check import TABLES, rows_of

QUERIES, ORACLE = load_all()
SUBSET = ["analytic_dataset", "flag_by_code", "pivot_min", "describe_numeric", "correlation_matrix",
          "iqr_outliers", "clean_chain", "prepare_data", "stratified_split", "evaluate", "roc_curve",
          "calibration", "top_factors", "report_full", "csv_roundtrip", "one_hot"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols, got = sdf.columns, [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    assert rows_of(cols, got) == rows_of(ocols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
