"""Tiled search of vectors against the queries' SQL, and how many rows it shuffles."""

import random

import duckdb
import pytest

from claimloom.operators import nearest
from claimloom.plans import catalog


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """900 vectors of which many are equal or nearly so, one zero and one null."""
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else [x + rng.gauss(0, 1e-4) for x in base[i % 7]]) for i in range(900)]
    rows[50], rows[61] = (50, [0.0] * 8), (61, None)
    where = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame([(i, v, i % 5) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{where}/embeddings.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["r13_chunk_search", "r2_r3_dense_top"])
@pytest.mark.parametrize("tile", [16, 4096])
def test_best_are_those_of_the_sql(spark, table, name, tile, monkeypatch):
    monkeypatch.setattr(nearest.scored, "__defaults__", (*nearest.scored.__defaults__[:-1], tile))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{table}/embeddings.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, table)
    told = lambda rows: sorted(map(str, rows))
    names = ", ".join(got.columns)
    assert told(map(tuple, got.collect())) == told(c.execute(f"SELECT {names} FROM ({catalog.ORACLES[name]})").fetchall())


def test_a_tile_keeps_the_best_alone(spark):
    v = spark.range(500).selectExpr("id AS doc_id", "array(cos(id), sin(id)) AS vector")
    rows = nearest.scored(v.withColumnRenamed("doc_id", "query_id"), v, 3, "doc_id", tile=50).groupBy("query_id").count().collect()
    assert len(rows) == 500 and all(3 < r["count"] <= 30 for r in rows)


def test_other_lengths_have_no_score(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, None]), (4, [3.0, 4.0])], "doc_id long, vector array<double>")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in nearest.scored(v.withColumnRenamed("doc_id", "query_id"), v, 9, "doc_id").collect()}
    assert len(got) == 16 and {k for k, s in got.items() if s is not None} == {(1, 1), (1, 4), (4, 1), (4, 4), (2, 2)} and got[1, 4] == 0.6
