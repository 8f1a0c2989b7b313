"""Search over blocked postings against the plain scores, and how much of the postings it reads."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import postings, retrieval

K = 10


@pytest.fixture(scope="module")
def texts(spark):
    """3,000 texts over 4,000 words of Zipf's frequencies, with equal, empty and null ones, and one of a single word."""
    rng = random.Random(7)
    names = [f"w{i}" for i in range(4000)]
    freq = [1 / (i + 1) for i in range(4000)]
    rows = [(i, " ".join(rng.choices(names, freq, k=rng.randint(5, 120)))) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(40)] + [(3100, ""), (3101, None), (3102, "w0"), (3103, "w0 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asks = [(i, " ".join(rows[i * 37][1].split()[:6])) for i in range(30)] + [(100, "w0 w1"), (101, "w0 w0 w900"), (102, ""), (103, None), (104, "nowhere"), (105, "w0 nowhere")]
    return docs, spark.createDataFrame(asks, "query_id long, text string")


@pytest.mark.parametrize("block", [8, 64])
def test_best_are_those_of_the_plain_scores(texts, block):
    docs, asks = texts
    got = postings.searched(asks, postings.bm25_index(docs, "doc_id", F.col("text"), block), K)
    want = retrieval.bm25(asks, docs, "doc_id", F.col("text"), K)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    assert rows(got) == rows(want)
    assert {r["query_id"] for r in got.select("query_id").distinct().collect()} == {*range(30), 100, 101, 105}


def test_many_queries_are_scored_in_one_pass_with_one_shuffle_of_their_postings(spark, texts, monkeypatch):
    docs, asks = texts
    index = postings.bm25_index(docs, "doc_id", F.col("text"), 8)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    want, before = shuffled(spark, lambda: rows(postings.searched(asks, index, K)))
    monkeypatch.setattr(postings, "MANY", 0)
    monkeypatch.setattr(postings, "TASK_READS", 1 << 12)
    got, after = shuffled(spark, lambda: rows(postings.searched(asks, index, K)))
    print("rows shuffled:", before, after)
    assert got == want and after < before / 2
    assert postings.searched(asks.limit(0), index, K).count() == 0


def test_most_postings_are_not_read(texts):
    docs, asks = texts
    index = postings.bm25_index(docs, "doc_id", F.col("text"), 8)
    said = asks.select("query_id", F.explode(F.split("text", " ")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("said"))
    wanted = said.join(index.factors, "term").select("query_id", "term", (F.col("said") * F.col("factor")).alias("factor"))
    read = lambda asked: asked.join(index.postings, ["term", "block"]).agg(F.sum(F.size("docs")).alias("n")).first()["n"]
    every = wanted.join(index.postings, "term").agg(F.sum(F.size("docs")).alias("n")).first()["n"]
    found = postings.plan(wanted, index.postings, K)
    essential, ended = read(found.rest.where("essential")), read(postings.remaining(found))
    seeds = read(found.seed)
    print("postings:", every, "seeds:", seeds, "essential:", essential, "to end the scores:", ended)
    assert seeds + essential + ended < 0.5 * every


def test_a_term_of_all_documents_is_many_small_rows(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"))
    index = postings.bm25_index(docs, "doc_id", F.col("text"), 16)
    sizes = [r["n"] for r in index.postings.select(F.size("docs").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 64
    got = postings.searched(spark.createDataFrame([(1, "same")], "query_id long, text string"), index, 3)
    assert got.count() == 0  # all have the word: idf and its stand-in are negative, and scores over 0 alone count


def test_empty_tables(spark, texts):
    docs, asks = texts
    index = postings.bm25_index(docs.limit(0), "doc_id", F.col("text"))
    assert postings.searched(asks, index, K).count() == 0
    assert postings.searched(asks.limit(0), postings.bm25_index(docs, "doc_id", F.col("text")), K).count() == 0


def shuffled(spark, job):
    """What job returns, and how many rows its stages wrote for shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def rows():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    out = job()
    return out, sum(n for k, n in rows().items() if k not in before)


def test_neither_postings_nor_the_index_are_shuffled(spark, texts):
    docs, asks = texts
    index, built = shuffled(spark, lambda: postings.bm25_index(docs, "doc_id", F.col("text"), 8))
    said, kept = index.postings.agg(F.sum(F.size("docs")), F.count("*")).first()
    assert built < said / 2
    few = asks.where("query_id IN (0, 1, 2)")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")  # the asked terms fit, their blocks don't
    try:
        found, searched = shuffled(spark, lambda: postings.searched(few, index, K).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    print("postings:", said, "shuffled:", built, "rows of the index:", kept, "shuffled:", searched)
    assert len(found) == 3 * K and searched < kept / 2


def test_blocks_are_bounded_in_words(spark):
    tokens = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(20000).alias("doc_len"))
    sizes = [r["count"] for r in postings.in_blocks(tokens).groupBy("block").count().collect()]
    assert sum(sizes) == 2000 and sum(sizes) / len(sizes) < 5 and max(sizes) < 16
