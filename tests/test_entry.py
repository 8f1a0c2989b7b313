"""Queries against their SQL on the smallest tables, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from claimloom.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["a4_count_by_status", "j5_history_pairs", "x7_velocity_as_of", "a2_best_values", "m4_risk_score", "j18_similar_rows", "d1_d2_classes", "r11_keyword_hits", "t9_pipeline_outcome", "w12_lines"])
def test_twin(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(c.execute(catalog.ORACLES[name]).df())
