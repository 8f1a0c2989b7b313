"""Source queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.plans.registry import query, raw, role
from claimloom.sources import readers
from claimloom.sources.storage import shared_dir


@query("s1_relational_scan", "SELECT claim_id, patient_id, status, created_at FROM claims WHERE total_amount > 250000", "claims")
def s1(spark, d):
    return role(spark, d, "claims").where("total_amount > 250000").select("claim_id", "patient_id", "status", "created_at")


@query("s7_content_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' ELSE 'rejected' END AS content_type FROM pages")
def s7(spark, d):
    n = F.col("page_id") % 4
    declared = F.when(n == 0, "application/x-pdf").when(n == 1, "IMAGE/JPG; q=1").otherwise("application/octet-stream")
    name = F.concat("page_id", F.when(n == 2, ".HTML").otherwise(".bin"))
    return raw(spark, d, "pages").select("page_id", F.coalesce(readers.content_type(declared, name), F.lit("rejected")).alias("content_type"))


@query("o5_chapter_order", "SELECT code, (code % 22 + 1)::INT AS chapter FROM catalogue ORDER BY 2, 1", "catalogue")
def o5(spark, d):
    from claimloom.functions.scalars import roman

    names = F.array(*map(F.lit, "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII".split()))
    return role(spark, d, "catalogue").select("code", roman(F.element_at(names, (F.col("code") % 22 + 1).cast("int"))).alias("chapter")).orderBy("chapter", "code")


# ---------------------------------------------------------------- tables written as files, and read back


@query("s2_code_catalogue", "SELECT CASE WHEN code % 7 > 0 THEN 'C' || code END AS code, CASE WHEN code % 5 = 0 THEN 'C' || code ELSE description END AS description FROM catalogue WHERE code % 7 > 0", "catalogue")
def s2(spark, d):
    path = shared_dir(spark)
    code = F.concat(F.lit("C"), "code")
    rows = role(spark, d, "catalogue").select(F.when(F.col("code") % 7 > 0, code).otherwise(" ").alias("CPT_Code"), F.when(F.col("code") % 5 > 0, F.concat("description", F.lit(" "))).alias("Desc"), F.col("cost").alias("other"))
    rows.write.option("header", "true").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return readers.code_catalogue(spark, path)


@query("s3_csv_rows", "SELECT claim_id || CASE WHEN claim_id % 3 = 0 THEN '' ELSE ' | ' || status END || ' | ' || channel AS text FROM claims WHERE claim_id % 4 > 0", "claims")
def s3(spark, d):
    path = shared_dir(spark)
    some = lambda c: F.when(F.col("claim_id") % 4 > 0, F.col(c).cast("string"))
    role(spark, d, "claims").select(some("claim_id"), F.when(F.col("claim_id") % 3 > 0, some("status")), some("channel")).write.csv(path)
    return readers.csv_rows(spark, path)


@query("s4_json_text", """SELECT '{"brand":"' || brand || '","code":' || code || ',"description":"' || description || '"}' AS text FROM catalogue""", "catalogue")
def s4(spark, d):
    path = shared_dir(spark)
    rows = role(spark, d, "catalogue").select("size", F.struct("code", "description", "brand").alias("r"))
    rows.groupBy("size").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("size").text(path)
    return readers.json_text(spark, path).select(F.to_json(F.from_json("text", "brand string, code bigint, description string")).alias("text"))


def item_files(spark, d) -> str:
    """The benchmark's items, a folder and a file each."""
    path = shared_dir(spark)
    raw(spark, d, "benchmark").select(F.concat(F.lit("claim"), "item_id").alias("claim"), F.col("text").alias("value")).repartition("claim").write.partitionBy("claim").text(path)
    return path


@query("s5_text_documents", "SELECT 'claim' || item_id AS claim, text || chr(10) AS text FROM benchmark")
def s5(spark, d):
    files = readers.text_documents(spark, item_files(spark, d)).where("path LIKE '%.txt'")
    return files.select(F.regexp_extract("path", "claim=(claim[0-9]+)/", 1).alias("claim"), "text")


@query("s6_bulk_folder", "SELECT 'claim=claim' || item_id AS claim_key, strlen(text) + 1 AS length, sha256(text || chr(10)) AS content_hash, CASE WHEN item_id % 2 = 0 THEN 'P' || item_id END AS policy_id FROM benchmark")
def s6(spark, d):
    path = item_files(spark, d)
    named = readers.bulk_folder(spark, path, spark.createDataFrame([], "file_name string, x int")).where("file_name LIKE '%.txt'")
    n = F.regexp_extract("claim_key", "([0-9]+)$", 1)
    # A writer's task may give files of several folders one name: metadata by folder and name.
    metadata = named.where(n.cast("long") % 2 == 0).select(F.concat_ws("/", "claim_key", "file_name").alias("file_name"), F.concat(F.lit("P"), n).alias("policy_id"))
    return readers.bulk_folder(spark, path, metadata, folder=True).where("file_name LIKE '%.txt'").select("claim_key", "length", "content_hash", "policy_id")


@query("s10_appended_batches", "SELECT claim_id, claim_id % 3 AS batch, total_amount FROM claims", "claims")
def s10(spark, d):
    path = shared_dir(spark)
    rows = role(spark, d, "claims").select("claim_id", "total_amount")
    for batch in (0, 1, 2, 1):  # the second batch comes twice
        readers.append_batch(rows.where(F.col("claim_id") % 3 == batch), path, batch)
    return spark.read.parquet(path).select("claim_id", F.col("batch").cast("long").alias("batch"), "total_amount")
