"""The thin queries over the driver's tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import ann, centroids, chat, decontaminate, language, licenses, neardup, packing, pii, prefixtrie, toxicity, urltree, warc
from claimloom.llm.common import held_out, table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1)))
    scored = toxicity.score(docs, model, ["doc_id"])
    # The sentences that offend: number:start:end:p, joined by commas.
    told = F.transform("offending", lambda s: F.concat_ws(":", s["sentence"], s["start"], s["end"], F.round(s["p"], 4)))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.array_join(told, ",").alias("offending"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digest(chat.chat(chat.conversations(rows, layouts=chat.LAYOUTS)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), ["doc_id"]))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.histories(warc.index(warc.archived(table(spark, sf_dir, "pages"))))
    page = [F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"]
    return captures.select(*page, F.col("key").alias("url_key"), F.col("date").alias("captured"), F.col("range").alias("key_range"), "position", F.col("before").alias("captured_before"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents have no paths: the source is the tree, a hundred ids a directory.
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.concat("doc_id", F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", path))


def language_field(docs: DataFrame) -> language.Field:
    """Fitted to labelled documents outside the held-out fold."""
    return language.fit(language.sample(docs, ~held_out(F.col("doc_id"), 4, 2), "lang", "doc_id", "text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language_field(docs), ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judged(table(spark, sf_dir, "pages"))


def op12_ns_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings")).drop("scanned")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_decontaminate": op6_decontaminate,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_licenses": op10_licenses,
    "op11_url_filter": op11_url_filter,
    "op12_ns_kmeans": op12_ns_kmeans,
    "op13_prefix_trie": op13_prefix_trie,
}


def _kmeans_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """Lloyd's rounds, all vectors against all centroids, a pair of tables a round."""
    parts = [
        """v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS y FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
            SELECT r, min(d * {k} + j)::BIGINT % {k} AS j, min(d * {k} + j)::BIGINT // {k} AS d
            FROM (SELECT r, j, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
            SELECT j, list(mean ORDER BY e) AS y FROM (
                SELECT a{i}.j, e, (sum(x[e]) - ((sum(x[e]) % count(*)) + count(*)) % count(*)) // count(*) AS mean
                FROM v JOIN a{i} USING (r), range(1, 65) AS g(e) GROUP BY a{i}.j, e) GROUP BY j)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN m{i} USING (j))")
    return "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, a.j::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(list_transform(y, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.j = a.j"""


ORACLES: dict[str, str] = {
    "op5_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, length(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>')) + length(role) + 15 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars, 'ok' AS status
        FROM e GROUP BY conv_id""",
    "op12_ns_kmeans": _kmeans_sql(),
    # crc32 is worked out bit by bit; shares go from each node to all nodes above it on its smallest member's path.
    "op13_prefix_trie": r"""
        WITH RECURSIVE t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
            FROM conversations WHERE conv_id IS NOT NULL),
        bytes AS (SELECT c, 4294967295::BIGINT AS crc, c::VARCHAR AS rest FROM (SELECT DISTINCT c FROM t)
            UNION ALL
            SELECT c, list_reduce(list_prepend(xor(crc, ascii(rest)::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)), substr(rest, 2) FROM bytes WHERE rest <> ''),
        convs AS (SELECT c, c - c % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM bytes WHERE rest = ''),
        built AS (
            SELECT convs.c, pos, turn, words FROM convs JOIN t ON t.c = base WHERE pos < h
            UNION ALL
            SELECT t.c, pos, turn, words FROM t JOIN convs ON t.c = convs.c WHERE pos >= h),
        paths AS (
            SELECT c, row_number() OVER w AS depth, words, sha256(string_agg(turn, ',') OVER w) AS node FROM built WINDOW w AS (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            UNION ALL SELECT c, 0, 0, '' FROM convs),
        steps AS (SELECT c, depth, words, node, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS last FROM paths WINDOW w AS (PARTITION BY c ORDER BY depth)),
        nodes AS (
            SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(c) AS conv_id, count(*) AS n,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
            FROM steps GROUP BY node),
        kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        shares AS (SELECT nodes.conv_id AS c, nodes.depth, (kids.n IS NULL)::INT AS leaf, (nodes.n - 1) * words AS saved FROM nodes LEFT JOIN kids USING (node)),
        sums AS (SELECT p.node, sum(leaf) AS leaves, sum(saved) AS saved FROM shares s JOIN paths p ON p.c = s.c AND p.depth <= s.depth GROUP BY p.node)
        SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends_sha256
        FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes up ON nodes.parent = up.node""",
}
