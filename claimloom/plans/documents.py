"""Document queries over the driver's documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import scalars
from claimloom.operators import documents
from claimloom.plans.registry import query, raw, role


@query("d3_relevance", r"""WITH h AS (SELECT doc_id, text, substring(text, 1, 5000) AS s FROM documents), c AS (SELECT *, len(regexp_extract_all(s, '(?i)\b(?:the|of)\b')) / greatest(length(s), 1) * 1000 AS m, len(regexp_extract_all(s, '(?i)\b(?:that|this)\b')) / greatest(length(s), 1) * 1000 AS n FROM h)
    SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN 0 WHEN n > 0 AND n > m THEN least(n / 5, 0.95) WHEN m = 0 THEN 0.1 WHEN m < 2 THEN 0.3 WHEN m < 5 THEN 0.6 ELSE least(0.5 + m / 20, 0.98) END AS confidence FROM c""")  # fmt: skip
def d3(spark, d):
    return raw(spark, d, "documents").select("doc_id", documents.relevance(F.col("text"), r"(?i)\b(?:the|of)\b", r"(?i)\b(?:that|this)\b")["confidence"].alias("confidence"))


@query("d6_name_similarity", """WITH n AS (SELECT patient_id, patient_name AS a, CASE patient_id % 3 WHEN 0 THEN patient_name WHEN 1 THEN patient_name || ' Jr' ELSE 'Someone Else' END AS b FROM patients)
    SELECT patient_id, CASE patient_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.0 END AS score FROM n""", "patients")  # fmt: skip
def d6(spark, d):
    n = F.col("patient_id") % 3
    other = F.when(n == 0, F.col("patient_name")).when(n == 1, F.concat("patient_name", F.lit(" Jr"))).otherwise("Someone Else")
    return role(spark, d, "patients").select("patient_id", scalars.name_similarity(F.col("patient_name"), other).alias("score"))


def _scrub_sql(more=()) -> str:
    """The redaction rules as nested DuckDB calls."""
    out = "text"
    for pattern, token in (*documents.PHI, *more):
        out = f"regexp_replace({out}, '{pattern}', '{token}', 'g')"
    return out


@query("d22_d23_scrubbed", "SELECT doc_id, sha256(" + _scrub_sql(documents.PHI_MORE) + " || doc_id) AS digest FROM documents")
def d22(spark, d):
    return raw(spark, d, "documents").select("doc_id", F.sha2(F.concat(documents.scrubbed(F.col("text"), documents.PHI_MORE), F.col("doc_id").cast("string")), 256).alias("digest"))


@query("d22_scrub_documents", "SELECT doc_id, length(" + _scrub_sql() + ") - length(text) AS grown FROM documents")
def d22_docs(spark, d):
    return raw(spark, d, "documents").select("doc_id", (F.length(documents.scrubbed(F.col("text"))) - F.length("text")).cast("long").alias("grown"))


@query("d31_chunks", "SELECT doc_id, (i / 400)::INT AS chunk, substring(text, i::INT + 1, 500) AS text FROM documents, range(0, 2000000, 400) t(i) WHERE i < length(text) AND trim(substring(text, i::INT + 1, 500)) <> ''")
def d31(spark, d):
    return documents.chunks(raw(spark, d, "documents")).select("doc_id", "chunk", "text")


@query("d32_keyword_scores", r"WITH c AS (SELECT doc_id, (i / 400)::INT AS chunk, substring(text, i::INT + 1, 500) AS text FROM documents, range(0, 2000000, 400) t(i) WHERE i < length(text)) SELECT doc_id, chunk, len(regexp_extract_all(text, '(?i)(?:license|stupid|the)')) AS hits FROM c WHERE trim(text) <> '' AND len(regexp_extract_all(text, '(?i)(?:license|stupid|the)')) > 0")
def d32(spark, d):
    return documents.keyword_scores(documents.chunks(raw(spark, d, "documents")), ["license", "stupid", "the"]).where("hits > 0").select("doc_id", "chunk", F.col("hits").cast("long").alias("hits"))


@query("o4_budget", r"""WITH c AS (SELECT doc_id, (i / 400)::INT AS chunk, substring(text, i::INT + 1, 500) AS text FROM documents, range(0, 2000000, 400) t(i) WHERE i < length(text)), k AS (SELECT *, len(regexp_extract_all(text, 'the')) AS hits FROM c WHERE trim(text) <> ''),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk) <= 3), u AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk) - length(text) AS used FROM b)
    SELECT doc_id, chunk, length(substring(text, 1, 1200 - used::INT)) AS chars FROM u WHERE used < 1200""")  # fmt: skip
def o4(spark, d):
    pieces = documents.chunks(raw(spark, d, "documents")).withColumn("hits", F.regexp_count("text", F.lit("the")))
    return documents.within_budget(pieces, "hits", 1200, 3).select("doc_id", "chunk", F.length("text").cast("long").alias("chars"))


def _intent_sql(part: str) -> str:
    """The first command that a message fits, and its part, as a DuckDB CASE."""
    cases = []
    for action, pattern in documents.INTENTS:
        value = {"action": f"'{action}'", "field": f"replace(lower(trim(regexp_extract(text, '{pattern}', 1))), ' ', '_')", "value": "NULL" if action == "delete" else f"regexp_extract(text, '{pattern}', 2)"}[part]
        cases.append(f"WHEN regexp_matches(text, '{pattern}') THEN {value}")
    return f"CASE {' '.join(cases)} END"


@query("d33_intents", "SELECT conv_id, turn, " + ", ".join(f"{_intent_sql(p)} AS {p}" for p in ("action", "field", "value")) + " FROM conversations")
def d33(spark, d):
    return raw(spark, d, "conversations").select("conv_id", "turn", documents.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.*")


@query("d35_key_values", r"SELECT doc_id, 2 + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*([A-Za-z][A-Za-z /._-]{1,40}?)\s*:\s*(\S.*)$')))::INT AS pairs FROM documents")
def d35(spark, d):
    return raw(spark, d, "documents").select("doc_id", F.size(documents.key_values(F.concat(F.lit("Name: Asha\nWard : 4B\n"), "text"))).alias("pairs"))


@query("d35_column_tables", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), k AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\s*\|\s*|\t+| {2,}'), lambda x: x <> '')) AS c FROM l),
    f AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM k WHERE c >= 2) SELECT doc_id, min(n)::INT AS first_line, count(*) AS lines, max(c)::INT AS columns FROM f GROUP BY doc_id, island""")  # fmt: skip
def d35_tables(spark, d):
    return documents.column_tables(raw(spark, d, "documents"))


@query("p11_usable_text", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '\s', '', 'g')) >= 25 AND len(regexp_extract_all(text, '\S+')) >= 4")
def p11(spark, d):
    return raw(spark, d, "documents").where(documents.usable(F.col("text"))).select("doc_id")


@query("p12_noisy_values", "SELECT conv_id, turn FROM conversations WHERE length(text) > 200 OR (contains(lower(text), 'patient name')::INT + contains(lower(text), 'date')::INT + contains(lower(text), 'address')::INT + contains(lower(text), 'policy')::INT + contains(lower(text), 'hospital')::INT + contains(lower(text), 'doctor')::INT + contains(lower(text), 'bill no')::INT + contains(lower(text), 'page')::INT) >= 2")
def p12(spark, d):
    return raw(spark, d, "conversations").where(documents.noisy(F.col("text"))).select("conv_id", "turn")


@query("u4_merged_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), k AS (SELECT doc_id, min(n) AS n FROM l WHERE trim(line) <> '' GROUP BY doc_id, regexp_replace(lower(trim(line)), '\s+', ' ', 'g')) SELECT doc_id, count(*)::INT AS lines FROM k GROUP BY doc_id""")
def u4(spark, d):
    rows = raw(spark, d, "documents").select("doc_id", F.lit(0).alias("seq"), "text")
    both = rows.unionByName(rows.withColumn("seq", F.lit(1)))
    return documents.merged_lines(both).select("doc_id", F.size(F.split("text", "\n")).alias("lines"))


@query("a20_ordered_text", "SELECT conv_id, substring(string_agg(text, chr(10) ORDER BY turn), 1, 3000) AS text FROM conversations GROUP BY conv_id")
def a20(spark, d):
    return documents.ordered_text(raw(spark, d, "conversations"), "conv_id", "turn", "text", 3000)


@query("a26_set_hash", "SELECT source, sha256(string_agg(h, ',' ORDER BY h)) AS set_hash FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def a26(spark, d):
    return documents.set_hash(raw(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")), "source", "h")


@query("j2_document_pages", "SELECT d.source AS claim_id, d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 100")
def j2(spark, d):
    pages = raw(spark, d, "labels").select("doc_id", "quality")
    return raw(spark, d, "documents").where("n_chars > 100").select(F.col("source").alias("claim_id"), "doc_id").join(pages, "doc_id")
