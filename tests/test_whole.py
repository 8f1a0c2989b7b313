"""Queries answer for every row of their table: counts by other means, and texts worked out by hand."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from claimloom.operators import documents
from claimloom.plans import catalog

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def table(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


@tables
@pytest.mark.parametrize("name", ["w12_lines", "w11_blocks", "a28_a29_token_stats", "a27_page_texts", "d29_region_kinds"])
def test_layout_covers_all_documents(spark, name):
    worded = {r["doc_id"] for r in table(spark, "documents").collect() if any(w for line in (r["text"] or "").split("\n") for w in line.split(" "))}
    assert {r["document_id"] for r in catalog.QUERIES[name](spark, DIR).collect()} == worded


@tables
def test_chapters_cover_the_catalogue_in_order(spark):
    got = [(r["chapter"], r["code"]) for r in catalog.QUERIES["o5_chapter_order"](spark, DIR).collect()]
    assert got == sorted((c % 22 + 1, c) for (c,) in table(spark, "part").select("p_partkey").collect())


@tables
def test_stored_index_is_asked_every_item_and_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    for f in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {f} AS SELECT * FROM '{DIR}/{f}.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["r5_stored_index"](spark, DIR).select("query_id", "doc_id", "score", "rank").collect())
    assert {r[0] for r in got} == {r["item_id"] for r in table(spark, "benchmark").collect()}
    assert got == sorted(c.execute(f"SELECT query_id, doc_id, score, rank FROM ({catalog.ORACLES['r5_stored_index']})").fetchall())


@tables
def test_classifier_scores_every_labelled_row(spark):
    labelled = table(spark, "documents").select("doc_id").join(table(spark, "labels"), "doc_id")
    got = catalog.QUERIES["m7_classifier"](spark, DIR)
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in labelled.collect()}
    assert got.where(F.col("held_out") != (F.col("doc_id") % 4 == 0)).count() == 0 and got.where("held_out").count() > 0


TEXTS = {
    1: "Der Mann that this that this is größer als the other, über of allem.",
    2: "MRN: 123456 call 555-123-4567 or 123-45-6789, größer@x a.b@example.com AB12345678 ABCDE1234F",
    3: "Ward: 4B\nÉlan\nélan\nplain\nplain",
    4: "x" * 9000 + " 555-123-4567",
}


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(1, 0, "user", "Please change the policy number to P77."), (1, 1, "assistant", "Fertig, schönen Tag"), (2, 0, "user", "remove the middle name")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return lambda name: {tuple(r)[0]: tuple(r)[1:] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}


def test_relevance_of_all_texts(texts):
    got = texts("d3_relevance")
    assert set(got) == set(TEXTS) and got[1] == (0.95,)


def test_scrubbing_reads_the_texts(texts):
    got = texts("d22_d23_scrubbed")
    left = {1: TEXTS[1], 2: "[MRN_REDACTED] call [PHONE_REDACTED] or [SSN_REDACTED], größer@x [EMAIL_REDACTED] [POLICY_REDACTED] [PAN_REDACTED]", 3: TEXTS[3], 4: "x" * 9000 + " [PHONE_REDACTED]"}
    assert got == {i: (hashlib.sha256(f"{t}{i}".encode()).hexdigest(),) for i, t in left.items()}
    assert texts("d22_scrub_documents") == {1: (0,), 2: (len(left[2].replace("[PAN_REDACTED]", "ABCDE1234F")) - len(TEXTS[2]),), 3: (0,), 4: (4,)}


def test_intents_of_the_messages(spark, texts, tmp_path):
    got = {(r["conv_id"], r["turn"]): (r["action"], r["field"], r["value"]) for r in catalog.QUERIES["d33_intents"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("modify", "policy_number", "P77"), (1, 1): (None, None, None), (2, 0): ("delete", "middle_name", None)}


def test_key_values_and_lines_of_all_texts(texts):
    assert texts("d35_key_values") == {1: (2,), 2: (3,), 3: (3,), 4: (2,)}
    assert texts("u4_merged_lines") == {1: (1,), 2: (1,), 3: (3,), 4: (1,)}


def test_ordered_text_gathers_only_what_the_cut_keeps(spark):
    rows = [(1, i, "ab" * 5) for i in range(500)] + [(1, 0, None), (2, 1, "b"), (2, 0, "a" * 40)]
    out = documents.ordered_text(spark.createDataFrame(rows, "k int, n int, t string"), "k", "n", "t", 30)
    assert {r["k"]: r["text"] for r in out.collect()} == {1: "\n".join(["ab" * 5] * 3)[:30], 2: "a" * 30}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.index("Aggregate") < plan.index("Filter") < plan.index("Window")


def test_ordered_text_keeps_a_break_at_the_cut(spark):
    rows = [(1, 1, "abc"), (1, 2, "def"), (2, 1, "abcd"), (2, 2, None), (3, 1, None), (4, None, "z"), (4, 1, "y"), (5, 1, "abc"), (5, 2, None)]
    got = documents.ordered_text(spark.createDataFrame(rows, "k int, turn int, text string"), "k", "turn", "text", 4).collect()
    assert {r["k"]: r["text"] for r in got} == {1: "abc\n", 2: "abcd", 3: None, 4: "y\nz", 5: "abc"}
