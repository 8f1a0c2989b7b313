"""Sources: declared tables, catalogues, texts, bulk folders, content types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared schemas of the claim tables.
SCHEMAS = {
    "claims": "claim_id string, policy_id string, patient_id string, status string, source string, created_at timestamp, updated_at timestamp",
    "documents": "document_id string, claim_id string, file_name string, file_type string, content_hash string, uploaded_at timestamp, metadata string",
    "parsed_fields": "id string, claim_id string, document_id string, field_name string, field_value string, source_page int, doc_type string, model_version string, created_at timestamp",
    "medical_codes": "id string, claim_id string, code string, code_system string, description string, confidence double, is_primary boolean, created_at timestamp",
    "medical_entities": "id string, claim_id string, entity_text string, entity_type string, start_offset int, end_offset int, confidence double",
    "ocr_results": "id string, document_id string, page_number int, text string, confidence double, tokens array<struct<text:string,x0:double,y0:double,x1:double,y1:double,page:int,confidence:double>>",
    "predictions": "id string, claim_id string, rejection_score double, top_reasons array<struct<reason:string,feature:string,weight:double>>, model_name string, model_version string, created_at timestamp",
    "audit_logs": "id string, claim_id string, action string, actor string, metadata string, created_at timestamp",
}

#: Content types by extension, and their other names (fixed values).
TYPES = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "html": "text/html", "md": "text/markdown", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
TYPE_ALIASES = {"image/jpg": "image/jpeg", "application/x-pdf": "application/pdf", "text/xml": "application/xml", "text/x-markdown": "text/markdown"}


def claim_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A claim table by its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def code_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(code, description) from a CSV whose columns go by several names; rows without a code are left out."""
    rows = spark.read.csv(path, header=True)
    have = {c.lower(): c for c in rows.columns}
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    out = rows.select(pick(("icd10_code", "code", "icd_code", "cpt_code")).alias("code"), pick(("code_description", "description", "desc", "name")).alias("description"))
    return out.where("code IS NOT NULL").withColumn("description", F.coalesce("description", "code"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3: a CSV's rows as readable text, cells joined by pipes, empty rows left out."""
    rows = spark.read.csv(path)
    cells = F.filter(F.array(*(F.trim(F.col(c)) for c in rows.columns)), lambda c: F.coalesce(c, F.lit("")) != "")
    return rows.select(F.array_join(cells, " | ").alias("text")).where("text <> ''")


def json_text(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as text."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("text"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file, UTF-8, else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(valid, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def bulk_folder(spark: SparkSession, path: str, metadata: DataFrame, folder: bool = False) -> DataFrame:
    """Files of sub-folders, one claim each, with the metadata (file_name, policy_id, patient_id).

    folder: file_name is `folder/name` in the metadata and the result, for names that come in several.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    rows = files.select("path", F.element_at(parts, -2).alias("claim_key"), (F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)) if folder else F.element_at(parts, -1)).alias("file_name"), "length", F.sha2("content", 256).alias("content_hash"))
    return rows.join(metadata, "file_name", "left")


def content_type(declared: Column, file_name: Column) -> Column:
    """The declared type by its main name where known, else by extension, else null."""
    alias = F.create_map(*(F.lit(v) for pair in TYPE_ALIASES.items() for v in pair))
    by_ext = F.create_map(*(F.lit(v) for pair in TYPES.items() for v in pair))
    said = F.lower(F.trim(F.split_part(F.coalesce(declared, F.lit("")), F.lit(";"), F.lit(1))))
    main = F.coalesce(alias[said], said)
    return F.coalesce(F.when(main.isin(*set(TYPES.values())), main), by_ext[F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))])


def append(rows: DataFrame, path: str) -> None:
    """Predictions, assessments and audit rows only ever grow."""
    rows.write.mode("append").parquet(path)


def replace_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Rows of whole key buckets replace those that are there; other buckets stay."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """S10 with a commit a batch: each batch is a folder of its own, so one that runs again changes nothing."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
