"""Readers and writers over small files."""

from pyspark.sql import functions as F

from claimloom.operators import layout
from claimloom.sources import readers
from claimloom.streaming import lifecycle as streams


def test_catalogue_with_other_names(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ICD10_CODE,description\nA00, Cholera \n,nothing\nB01,\n")
    assert {tuple(r) for r in readers.code_catalogue(spark, str(tmp_path / "c.csv")).collect()} == {("A00", "Cholera"), ("B01", "B01")}


def test_texts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "t" / "b.txt").write_bytes("héllo".encode("latin-1"))
    assert {r["text"] for r in readers.text_documents(spark, str(tmp_path / "t")).collect()} == {"héllo"}
    (tmp_path / "r.csv").write_text("a,,b\n,,\nc,d,\n")
    assert [r["text"] for r in readers.csv_rows(spark, str(tmp_path / "r.csv")).collect()] == ["a | b", "c | d"]
    (tmp_path / "j.json").write_text('{\n "a": 1,\n "b": [2]\n}')
    assert [r["text"] for r in readers.json_text(spark, str(tmp_path / "j.json")).collect()] == ['{"a":1,"b":[2]}']


def test_bulk_folder(spark, tmp_path):
    for claim in ("c1", "c2"):
        (tmp_path / "bulk" / claim).mkdir(parents=True)
        (tmp_path / "bulk" / claim / f"{claim}.pdf").write_bytes(b"x")
    meta = spark.createDataFrame([("c1.pdf", "P1", "A")], "file_name string, policy_id string, patient_id string")
    got = {r["claim_key"]: r["policy_id"] for r in readers.bulk_folder(spark, str(tmp_path / "bulk"), meta).collect()}
    assert got == {"c1": "P1", "c2": None}


def test_bucket_replacement_repeats_safely(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(50).select(F.col("id").alias("claim_id"), F.lit("old").alias("v"))
    readers.replace_buckets(rows, path, "claim_id", 4)
    for _ in range(2):
        readers.replace_buckets(rows.withColumn("v", F.lit("new")), path, "claim_id", 4)
    got = spark.read.parquet(path)
    assert got.count() == 50 and {r["v"] for r in got.select("v").distinct().collect()} == {"new"}
    readers.append(rows, path + "2")
    readers.append(rows, path + "2")
    assert spark.read.parquet(path + "2").count() == 100


def test_tokens_of_two_documents_do_not_mix(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0), (2, 1, 20.0, 30.0, 0.0, 10.0), (1, 1, 0.0, 10.0, 50.0, 60.0)], "document_id int, page int, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r["document_id"], r["line"]) for r in layout.lines(t, 5.0).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_progress_stream_stops_at_the_terminal_value(spark, tmp_path):
    path = str(tmp_path / "ev")
    spark.createDataFrame([(1, 1, 1, 10.0), (2, 2, 1, 5.0), (3, 3, 1, 100.0), (4, 4, 1, 50.0)], "event_id long, s long, user_id long, value double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(path)
    source = spark.read.parquet(path)
    got = streams.drained(streams.monotonic_progress(spark.readStream.schema(source.schema).parquet(path)), "progress_test", "append")
    assert sorted((r["event_id"], r["progress"]) for r in got.collect()) == [(1, 10.0), (2, 10.0), (3, 100.0)]
