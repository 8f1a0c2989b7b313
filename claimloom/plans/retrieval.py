"""Retrieval queries: parts are the catalogue, benchmark items the queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import postings, retrieval
from claimloom.plans.registry import query, raw, role

TOKENS = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 1)"


def items(spark, d):
    return raw(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked(spark, d):
    return items(spark, d).where("query_id % 10 = 0")


@query("r2_r3_dense_top", """WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)
    SELECT a.id AS query_id, b.id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) <= 10""")  # fmt: skip
def r2(spark, d):
    v = raw(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_top(v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), v, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("r4_index_replace", "SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 9 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 9 <> 0")
def r4(spark, d):
    v = raw(spark, d, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 9 = 0").withColumn("label", F.col("label") + 100)
    return v.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)


BM25 = f"""WITH t AS (SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
    tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT term, ln((any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, n GROUP BY term), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
    q AS (SELECT item_id AS query_id, unnest({TOKENS.format(c='text')}) AS term FROM benchmark WHERE item_id % 10 = 0),
    s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / n.mean))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), n GROUP BY 1, 2 HAVING score > 0),
    b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"""


@query("r5_bm25", f"{BM25} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM b")
def r5(spark, d):
    out = retrieval.bm25(asked(spark, d), raw(spark, d, "documents"), "doc_id", F.col("text"), 20)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r5_stored_index", f"{BM25.replace(' WHERE item_id % 10 = 0', '')} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM b")
def r5_index(spark, d):
    out = postings.searched(items(spark, d), postings.bm25_index(raw(spark, d, "documents"), "doc_id", F.col("text")), 20)
    # As the SQL rounds: what is multiplied is rounded, not the decimal digits.
    return out.select("query_id", "doc_id", (F.round(F.col("score") * 10000) / 10000).alias("score"), F.col("rank").cast("long").alias("rank"))


HITS = f"""h AS (SELECT q.query_id, x.doc_id, count(*) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY count(*) DESC, x.doc_id) AS rank FROM
    (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format(c='text')}) AS term FROM benchmark WHERE item_id % 10 = 0) q JOIN (SELECT DISTINCT doc_id, unnest({TOKENS.format(c='text')}) AS term FROM documents) x USING (term) WHERE length(term) > 3 GROUP BY 1, 2 QUALIFY rank <= 20)"""


@query("r11_keyword_hits", f"WITH {HITS} SELECT query_id, doc_id, score, rank FROM h")
def r11(spark, d):
    out = retrieval.keyword_hits(asked(spark, d), raw(spark, d, "documents"), "doc_id", F.col("text"), 20)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("r6_r7_fusion", f"{BM25}, {HITS}, u AS (SELECT query_id, doc_id, rank FROM b UNION ALL SELECT query_id, doc_id, rank FROM h) SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM u GROUP BY 1, 2")
def r6(spark, d):
    docs = raw(spark, d, "documents")
    a = retrieval.bm25(asked(spark, d), docs, "doc_id", F.col("text"), 20)
    b = retrieval.keyword_hits(asked(spark, d), docs, "doc_id", F.col("text"), 20)
    return retrieval.fused(a, b).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("u3_r8_r15_merged_lists", f"{BM25}, {HITS}, u AS (SELECT query_id, doc_id, min(place) AS place FROM (SELECT query_id, doc_id, rank AS place FROM b UNION ALL SELECT query_id, doc_id, 1000 + rank FROM h) GROUP BY 1, 2) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS rank FROM u QUALIFY rank <= 25")
def u3(spark, d):
    docs = raw(spark, d, "documents")
    a = retrieval.bm25(asked(spark, d), docs, "doc_id", F.col("text"), 20)
    b = retrieval.keyword_hits(asked(spark, d), docs, "doc_id", F.col("text"), 20)
    return retrieval.first_of(a, b, k=25).withColumn("rank", F.col("rank").cast("long"))


@query("j11_lookup", "SELECT claim_id, seq, e.code, c.description FROM expenses e LEFT JOIN catalogue c USING (code)", "expenses catalogue")
def j11(spark, d):
    return retrieval.looked_up(role(spark, d, "expenses").select("claim_id", "seq", "code"), role(spark, d, "catalogue").select("code", "description"))


@query("j12_costs", "SELECT code, CASE WHEN code % 3 = 0 THEN cost WHEN size % 2 = 0 THEN 100.0 WHEN code % 2 = 0 THEN 2500.0 ELSE 250.0 END AS estimate FROM catalogue", "catalogue")
def j12(spark, d):
    c = role(spark, d, "catalogue").select("code", F.when(F.col("code") % 2 == 0, "ICD10").otherwise("CPT").alias("system"), (F.col("size") % 2).alias("category"), F.col("cost").alias("price"))
    known = c.where("code % 3 = 0").select("code", "system", F.col("price").alias("cost"))
    kinds = c.where("category = 0").select("category", "system").distinct().withColumn("category_cost", F.lit(100.0))
    return retrieval.costs(c.drop("price"), known, kinds).select("code", "estimate")


@query("j13_cross_reference", """WITH k AS (SELECT code % 50 AS icd, code AS cpt, min(claim_id) AS seq FROM expenses GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY icd ORDER BY seq, cpt) AS rank FROM k QUALIFY rank <= 3)
    SELECT code, cpt, rank FROM catalogue JOIN f ON catalogue.code = f.icd""", "expenses catalogue")  # fmt: skip
def j13(spark, d):
    relation = role(spark, d, "expenses").select((F.col("code") % 50).alias("icd"), F.col("code").alias("cpt"), F.col("claim_id").alias("seq"))
    return retrieval.cross_referenced(role(spark, d, "catalogue").select("code"), relation).withColumn("rank", F.col("rank").cast("long"))


@query("j14_synonyms", """WITH s AS (SELECT lower(description) AS synonym, min(code) AS code FROM catalogue GROUP BY 1),
    t AS (SELECT DISTINCT term FROM (SELECT unnest([synonym, synonym || 's (item)', 'the ' || synonym, substring(synonym, 2, 6), substring(synonym, 3, 2), 'zz' || code]) AS term FROM s))
    SELECT t.term, coalesce(arg_max(s.code, ((s.synonym = t.term)::BIGINT, length(s.synonym), s.code)), -1) AS code FROM t LEFT JOIN s ON contains(t.term, s.synonym) OR contains(s.synonym, t.term) GROUP BY t.term""", "catalogue")  # fmt: skip
def j14(spark, d):
    s = role(spark, d, "catalogue").groupBy(F.lower("description").alias("synonym")).agg(F.min("code").alias("code"))
    forms = [F.col("synonym"), F.concat("synonym", F.lit("s (item)")), F.concat(F.lit("the "), "synonym"), F.substring("synonym", 2, 6), F.substring("synonym", 3, 2), F.concat(F.lit("zz"), F.col("code").cast("string"))]
    return retrieval.by_synonym(s.select(F.explode(F.array(*forms)).alias("term")), s).withColumn("code", F.coalesce("code", F.lit(-1).cast("long")))


SHARED = "SELECT e.term, c.code, count(*) AS score, row_number() OVER (PARTITION BY e.term ORDER BY count(*) DESC, c.code) AS rank FROM (SELECT DISTINCT term, unnest({a}) AS w FROM {q}) e JOIN (SELECT DISTINCT code, unnest({b}) AS w FROM catalogue WHERE {w}) c USING (w) WHERE length(w) > 3 GROUP BY 1, 2 QUALIFY rank = 1"


@query("j15_entity_codes", f"""WITH e AS (SELECT x.claim_id, x.seq, CASE WHEN x.seq % 2 = 0 THEN upper(c.description) ELSE ' ' || c.description || ' done' END AS entity_text, CASE x.seq % 3 WHEN 0 THEN 'finding' WHEN 1 THEN 'SURGERY' ELSE 'OTHER' END AS kind FROM expenses x JOIN catalogue c USING (code)),
    f AS (SELECT claim_id, lower(trim(entity_text)) AS term, arg_min(trim(entity_text), seq) AS entity_text, arg_min(kind, seq) AS kind FROM e GROUP BY 1, 2),
    q AS (SELECT *, CASE kind WHEN 'finding' THEN 'ICD10' WHEN 'SURGERY' THEN 'CPT' END AS system FROM f WHERE kind <> 'OTHER'), d AS (SELECT DISTINCT term FROM q WHERE system = 'ICD10'), p AS (SELECT DISTINCT term FROM q WHERE system = 'CPT'),
    h AS (SELECT *, 'ICD10' AS system FROM ({SHARED.format(a=TOKENS.format(c='term'), b=TOKENS.format(c='description'), q='d', w='code % 2 = 0')}) UNION ALL SELECT *, 'CPT' FROM ({SHARED.format(a=TOKENS.format(c='term'), b=TOKENS.format(c='description'), q='p', w='code % 2 = 1')}))
    SELECT claim_id, entity_text, system, code, score FROM q JOIN h USING (term, system)""", "expenses catalogue")  # fmt: skip
def j15(spark, d):
    catalogue = role(spark, d, "catalogue").select("code", "description")
    named = role(spark, d, "expenses").select("claim_id", "seq", "code").join(catalogue, "code")
    text = F.when(F.col("seq") % 2 == 0, F.upper("description")).otherwise(F.concat(F.lit(" "), "description", F.lit(" done")))
    kind = F.when(F.col("seq") % 3 == 0, "finding").when(F.col("seq") % 3 == 1, "SURGERY").otherwise("OTHER")
    find = lambda odd: lambda q: retrieval.catalogue_hits(q, catalogue.where(F.col("code") % 2 == odd), "code", F.col("description"), 1)
    return retrieval.entity_codes(named.select("claim_id", "seq", text.alias("entity_text"), kind.alias("entity_type")), {"ICD10": find(0), "CPT": find(1)})


@query("u2_unsupported_codes", "WITH a AS (SELECT DISTINCT claim_id, code % 10 AS code FROM expenses WHERE line_status = 'O'), b AS (SELECT DISTINCT claim_id, code % 10 AS code FROM expenses WHERE line_status = 'F') SELECT claim_id, code, 'unsupported' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT claim_id, code, 'missing' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", "expenses")
def u2(spark, d):
    e = role(spark, d, "expenses").select("claim_id", (F.col("code") % 10).alias("code"), "line_status")
    return retrieval.unsupported(e.where("line_status = 'O'"), e.where("line_status = 'F'"))


@query("r14_w15_assigned_codes", """WITH x AS (SELECT DISTINCT claim_id, code FROM expenses WHERE line_status = 'O'), h AS (SELECT claim_id, seq, code, quantity / 50 AS score FROM expenses WHERE line_status = 'F'), b AS (SELECT claim_id, code, score FROM h QUALIFY row_number() OVER (PARTITION BY claim_id, seq ORDER BY score DESC, code) = 1),
    u AS (SELECT claim_id, code, min(l) AS l, max(score) AS score FROM (SELECT claim_id, code, 0 AS l, 0.9 AS score FROM x UNION ALL SELECT claim_id, code, 1, score FROM b) GROUP BY 1, 2),
    r AS (SELECT claim_id, code, row_number() OVER (PARTITION BY claim_id ORDER BY l, score DESC, code) AS rank, CASE WHEN min(l) OVER (PARTITION BY claim_id) = 0 THEN 4 WHEN max(score) OVER (PARTITION BY claim_id) >= 0.5 THEN 1 ELSE 3 END AS few FROM u)
    SELECT claim_id, code, rank, rank = 1 AS is_primary FROM r WHERE rank <= few""", "expenses")  # fmt: skip
def r14(spark, d):
    e = role(spark, d, "expenses")
    hits = e.where("line_status = 'F'").select("claim_id", F.col("seq").alias("term"), "code", (F.col("quantity") / 50).alias("score"))
    return retrieval.assigned(e.where("line_status = 'O'"), hits).select("claim_id", "code", F.col("rank").cast("long").alias("rank"), "is_primary")


@query("r9_r10_rerank", f"""WITH c AS (SELECT code, 'X' || (code // 10) || CASE WHEN code % 10 = 0 THEN '' ELSE '.' || code % 10 END AS icd, description, cost / 2100 AS score, {TOKENS.format(c='description')} AS w FROM catalogue), q AS (SELECT *, {TOKENS.format(c="'large brushed steel item'")} AS qw FROM c)
    SELECT icd AS code, round(greatest(score + least(0.02 * len(list_intersect(list_distinct(qw), list_distinct(w))), 0.08) + CASE WHEN contains(icd, '.') THEN -0.01 ELSE 0.005 END - least(0.008 * len(list_filter(list_distinct(w), lambda x: NOT list_contains(qw, x) AND length(x) > 4)), 0.06), 0), 6) AS score FROM q""", "catalogue")  # fmt: skip
def r9(spark, d):
    icd = F.concat(F.lit("X"), F.floor(F.col("code") / 10).cast("string"), F.when(F.col("code") % 10 == 0, "").otherwise(F.concat(F.lit("."), (F.col("code") % 10).cast("string"))))
    rows = role(spark, d, "catalogue").select(icd.alias("code"), "description", (F.col("cost") / 2100).alias("score"), F.lit("large brushed steel item").alias("query"), F.lit(1).alias("query_id"))
    return retrieval.reranked(rows).select("code", F.round("score", 6).alias("score"))


ICD_SQL = "'X' || (code // 10) || CASE WHEN code % 10 = 0 THEN '' ELSE '.' || code % 10 END"
NOISE = "['and', 'or', 'of', 'the', 'with', 'without', 'other', 'unspecified', 'specified', 'abnormal', 'normal']"


@query("r10_parent_codes", f"""WITH c AS (SELECT code // 10 AS q, {ICD_SQL} AS icd, 'X' || (code // 10) AS parent, code % 10 AS child, description || CASE WHEN code % 10 = 0 THEN '' ELSE ' of kind' || code % 10 || ' with other' END AS description, cost / 2100 AS score, 'seen kind3 and kind5' AS query FROM catalogue),
    p AS (SELECT q, description AS wide FROM c WHERE child = 0), w AS (SELECT *, list_filter({TOKENS.format(c='description')}, lambda x: NOT list_contains({TOKENS.format(c='wide')}, x) AND NOT list_contains({NOISE}, x)) AS own FROM c LEFT JOIN p USING (q)),
    f AS (SELECT *, child <> 0 AND wide IS NOT NULL AND len(own) > 0 AND NOT list_has_any(own, ['seen', 'kind3', 'kind5']) AS falls FROM w)
    SELECT q AS query_id, CASE WHEN falls THEN parent ELSE icd END AS code, round(max(score), 6) AS score FROM f GROUP BY 1, 2""", "catalogue")  # fmt: skip
def r10(spark, d):
    q, child = F.floor(F.col("code") / 10), F.col("code") % 10
    icd = F.concat(F.lit("X"), q.cast("string"), F.when(child == 0, "").otherwise(F.concat(F.lit("."), child.cast("string"))))
    text = F.concat("description", F.when(child == 0, "").otherwise(F.concat(F.lit(" of kind"), child.cast("string"), F.lit(" with other"))))
    rows = role(spark, d, "catalogue").select(q.alias("query_id"), F.lit("seen kind3 and kind5").alias("query"), icd.alias("code"), text.alias("description"), (F.col("cost") / 2100).alias("score"))
    return retrieval.prefer_parents(rows).select("query_id", "code", F.round("score", 6).alias("score"))


DENSE = """u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    dn AS (SELECT a.id AS query_id, b.id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.id IN (SELECT item_id FROM benchmark WHERE item_id % 10 = 0)), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn)"""


@query("r7_search_modes", f"""{BM25.replace('rank <= 20', 'rank <= 20')}, {DENSE}, f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM b UNION ALL SELECT query_id, doc_id, rank FROM dr WHERE rank <= 20) GROUP BY 1, 2),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
    SELECT 'bm25' AS mode, query_id, doc_id, rank FROM b WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dr WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM h WHERE rank <= 5""")  # fmt: skip
def r7(spark, d):
    docs, v = raw(spark, d, "documents"), raw(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    wanted = v.join(asked(spark, d).select(F.col("query_id").alias("doc_id")), "doc_id").withColumnRenamed("doc_id", "query_id")
    sparse = lambda n: retrieval.bm25(asked(spark, d), docs, "doc_id", F.col("text"), n)
    dense = lambda n: retrieval.dense_top(wanted, v, n, digits=6)
    out = [retrieval.searched(mode, 5, "CPT", sparse, dense).select(F.lit(mode).alias("mode"), "query_id", "doc_id", F.col("rank").cast("long").alias("rank")) for mode in ("bm25", "dense", "hybrid")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("r13_chunk_search", """WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    p AS (SELECT a.id AS query_id, b.id % 20 AS doc_id, b.id // 20 AS chunk, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.id % 20 = b.id % 20)
    SELECT query_id, doc_id, chunk, score FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) <= 8""")  # fmt: skip
def r13(spark, d):
    v = raw(spark, d, "embeddings")
    chunks = v.select((F.col("vec_id") % 20).alias("doc_id"), F.floor(F.col("vec_id") / 20).alias("chunk"), F.col("embedding").alias("vector"))
    return retrieval.chunk_search(v.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 20).alias("doc_id"), F.col("embedding").alias("vector")), chunks).select("query_id", "doc_id", "chunk", "score")


@query("r12_catalogue_text", "SELECT code, concat_ws(' ', description, coalesce(nullif(brand, ''), category)) AS text FROM catalogue", "catalogue")
def r12(spark, d):
    return role(spark, d, "catalogue").select("code", F.concat_ws(" ", "description", F.coalesce(F.nullif("brand", F.lit("")), "category")).alias("text"))


@query("r1_highlights", "SELECT source AS claim_id, least(3, count(*)) ::INT AS highlights FROM documents WHERE contains(lower(text), 'licensed') GROUP BY source")
def r1(spark, d):
    hits = raw(spark, d, "documents").where(F.lower("text").contains("licensed")).select(F.col("source").alias("claim_id"), F.col("doc_id").alias("place"), F.substring(F.substring_index("text", "\n", -1), 1, 100).alias("snippet"))
    return retrieval.highlights(hits).select("claim_id", F.size("highlights").alias("highlights"))


@query("a37_claim_terms", "WITH t AS (SELECT conv_id, lower(trim(split_part(text, ' ', 1))) AS term, min(turn) AS turn FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, term) AS r FROM t QUALIFY r <= 5) SELECT conv_id AS claim_id, string_agg(term, '; ' ORDER BY r) AS terms FROM r GROUP BY 1")
def a37(spark, d):
    rows = raw(spark, d, "conversations").select(F.col("conv_id").alias("claim_id"), F.lit("diagnosis").alias("field_name"), F.split_part("text", F.lit(" "), F.lit(1)).alias("field_value"), F.col("turn").alias("seq"))
    return retrieval.claim_terms(rows)
