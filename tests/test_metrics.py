"""Sketches against exact quantiles, suggestions against counting, and the queries' SQL."""

import datetime as dt
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import metrics
from claimloom.plans import catalog

DIR = "/root/testdata/sf0.001"
RANKS = (0.01, 0.5, 0.9, 0.99)


def test_sketches(spark):
    """Skewed, tied and constant values over many days; the merged sketch is within the bound of all rows' ranks."""
    rng = np.random.default_rng(3)
    values = {"long tail": rng.lognormal(3, 2, 60_000), "ties": rng.integers(0, 5, 20_000).astype(float), "one value": np.full(5_000, 7.0), "one row": np.array([2.5])}
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(days=i % 45), float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    rows += [("ties", start, None), ("ties", None, float("nan")), ("nulls", start, None), (None, None, 4.0)]
    df = spark.createDataFrame(rows, "method string, ts timestamp, ms double").repartition(7)
    daily = metrics.daily_sketches(df, ["method"], "ts", "ms")
    found = {r["method"]: r for r in metrics.quantiles(metrics.rolled_up(daily, ["method"]), ["method"], RANKS).collect()}
    assert set(found) == {*values, None}
    assert found[None]["at"] == [4.0] * 4 and found["one row"]["at"] == [2.5] * 4 and found["one value"]["at"] == [7.0] * 4
    for k, vs in values.items():
        r = found[k]
        assert (r["n"], r["least"], r["most"]) == (len(vs), vs.min(), vs.max()) and r["total"] == pytest.approx(vs.sum())
        for p, at in zip(RANKS, r["at"], strict=True):
            assert (vs < at).mean() <= p + metrics.RANK_ERROR and (vs <= at).mean() >= p - metrics.RANK_ERROR


def test_exact_ranks(spark):
    """Counts are those of all rows, null keys too, and a value of another rank isn't near."""
    rows = [(m, float(v)) for m in ("a", None) for v in range(100)] + [("a", None)]
    df = spark.createDataFrame(rows, "method string, ms double")
    found = spark.createDataFrame([("a", [50.0, 70.0]), (None, [49.5, 90.0])], "method string, at array<double>")
    got = metrics.exact_ranks(df, found, ["method"], "ms", (0.5, 0.9)).withColumn("near", metrics.near())
    assert {tuple(r) for r in got.collect()} == {
        ("a", 0.5, 50.0, 100, 50, 51, True), ("a", 0.9, 70.0, 100, 70, 71, False), (None, 0.5, 49.5, 100, 50, 50, True), (None, 0.9, 90.0, 100, 90, 91, True),
    }


def test_no_rows(spark):
    empty = spark.createDataFrame([], "method string, ts timestamp, ms double")
    assert metrics.rolled_up(metrics.daily_sketches(empty, ["method"], "ts", "ms"), ["method"]).count() == 0
    assert metrics.prefix_suggestions(spark.createDataFrame([], "attribute string, value string, n long"), 3, 2).count() == 0


def test_prefixes(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("xy"), "".join(rnd.choice("aAbé") for _ in range(rnd.randint(1, 4))), rnd.randint(1, 3)) for _ in range(400)]
    rows += [("x", None, 9), ("x", "", 9), ("x", "N/A", 9)]
    got = metrics.prefix_suggestions(spark.createDataFrame(rows, "attribute string, value string, n long").repartition(5), 3, 2)
    n = Counter()
    for a, v, k in rows:
        if v not in (None, "", "N/A"):
            n[a, v] += k
    groups = {}
    for (a, v), k in n.items():
        for length in range(min(len(v), 2) + 1):
            groups.setdefault((a, v[:length].lower()), []).append((-k, v.encode(), v))
    want = {(a, p, i + 1, v, -k) for (a, p), vs in groups.items() for i, (k, _, v) in enumerate(sorted(vs)[:3])}
    assert {tuple(r) for r in got.collect()} == want
    # A prefix that all values share is cut before the shuffle.
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["a33_quantile_ranks", "a25_prefix_suggestions"])
def test_twin(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    got, want = catalog.QUERIES[name](spark, DIR), c.execute(catalog.ORACLES[name]).df()
    assert Counter(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == Counter(want[sorted(want.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_latency_query(spark):
    got = catalog.QUERIES["a33_latency_quantiles"](spark, DIR)
    assert got.count() > 0 and got.where(~(F.col("least") <= F.col("p50")) | ~(F.col("p50") <= F.col("p90")) | ~(F.col("p90") <= F.col("p99")) | ~(F.col("p99") <= F.col("most"))).count() == 0
