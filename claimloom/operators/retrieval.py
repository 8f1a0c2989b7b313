"""Search over catalogues, documents and vectors: BM25, dense, fusion, rerank, code assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import words
from claimloom.operators import nearest
from claimloom.sources.storage import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
FUSION = 60
#: Rows that one task sorts at most, about.
TASK_ROWS = 1_000_000


def top(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The k best of each query, ties by document; the engine cuts each partition's groups first."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))).where(F.col("rank") <= k)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, digits: int | None = None) -> DataFrame:
    """R2: exact inner products of unit vectors. A stated query set against all rows, tile by tile.

    Each tile's best are kept before they are ranked. digits rounds scores, so that ties are told by the document.
    """
    pairs = nearest.scored(queries.select("query_id", "vector"), vectors.select("doc_id", "vector"), k, "doc_id", digits=digits)
    return top(pairs if least is None else pairs.where(F.col("score") >= least), k)


def bm25_index(docs: DataFrame, id_col: str, text: Column, asked: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """(term, doc_id, tf, doc_len) of the asked terms, (term, idf) of them, and the mean length.

    Document frequencies are counted over all terms, since a negative idf becomes EPSILON of the
    mean of all; each partition adds its terms up before they are shuffled. Term frequencies, whose
    rows are as many as terms in documents, are made for the asked terms alone.
    """
    tokens = docs.select(F.col(id_col).alias("doc_id"), words(text).alias("w"))
    told = tokens.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    n, mean = told.select("n").scalar(), told.select("mean").scalar()
    df = tokens.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    all_mean = df.agg(F.avg("raw")).scalar()
    terms = asked.select("term").distinct()
    idf = df.join(terms, "term", "left_semi").select("term", F.when(F.col("raw") < 0, EPSILON * all_mean).otherwise(F.col("raw")).alias("idf"))
    tf = tokens.select("doc_id", F.size("w").alias("doc_len"), F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("term", "doc_id", "doc_len").agg(F.count("*").alias("tf"))
    return tf, idf, mean


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, text: Column, k: int) -> DataFrame:
    """Okapi scores over 0, the k best per query. queries: query_id, text."""
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("term"))
    tf, idf, mean = bm25_index(docs, id_col, text, asked)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / mean))
    weighed = tf.join(idf, "term").select("term", "doc_id", part.alias("part"))
    scored = asked.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")  # rounded: equal texts tie, whatever the order of the sum
    return top(scored, k)


#: How many candidates a search takes for n results, and at least (fixed values).
POOLS = {"ICD10": (10, 100), "CPT": (4, 20)}


def searched(mode: str, n: int, system: str, sparse, dense) -> DataFrame:
    """The n best by mode: `bm25`, `dense`, or `hybrid`, which fuses both rankers' pools.

    sparse, dense: functions from a count to a ranked list (query_id, doc_id, score, rank).
    """
    times, least = POOLS[system]
    pool = max(times * n, least)
    if mode == "hybrid":
        return top(fused(sparse(pool), dense(pool)).withColumn("score", F.round("score", 9)), n)
    return {"bm25": sparse, "dense": dense}[mode](n)


def chunk_search(queries: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """Each query's k most alike chunks of its own document, with a score over 0.

    queries: query_id, doc_id, vector; chunks: doc_id, chunk, vector. A long document is compared tile by tile.
    """
    scored = nearest.scored(queries.select("query_id", "doc_id", "vector"), chunks.select("doc_id", "chunk", "vector"), k, "chunk", ("doc_id",), digits=6)
    return top(scored.where("score > 0").select("query_id", "doc_id", "chunk", "score"), k, doc="chunk")


def fused(*ranked: DataFrame, k: int = FUSION) -> DataFrame:
    """Reciprocal-rank fusion of lists (query_id, doc_id, rank from 1)."""
    union = ranked[0].select("query_id", "doc_id", "rank")
    for r in ranked[1:]:
        union = union.unionByName(r.select("query_id", "doc_id", "rank"))
    return union.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def keyword_hits(queries: DataFrame, docs: DataFrame, id_col: str, text: Column, k: int) -> DataFrame:
    """How many of a query's words of four letters or more a document has."""
    long = lambda w: F.filter(F.array_distinct(w), lambda x: F.length(x) > 3)
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(long(words(text))).alias("term"))
    asked = queries.select("query_id", F.explode(long(words(F.col("text")))).alias("term"))
    return top(asked.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("score")), k)


def long_words(text: Column) -> Column:
    """The distinct words of four letters or more, in order."""
    return F.array_sort(F.filter(F.array_distinct(words(text)), lambda x: F.length(x) > 3))


def kinds(docs: DataFrame, id_col: str, text: Column, k: int) -> DataFrame:
    """(w, ids, kind), written: each set of long words, its k smallest documents, and the smallest of them."""
    said = docs.select(F.col(id_col).alias("doc_id"), long_words(text).alias("w")).where(F.size("w") > 0)
    first = said.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("doc_id"))).where(F.col("r") <= k)
    return stored(first.groupBy("w").agg(F.collect_list("doc_id").alias("ids"), F.min("doc_id").alias("kind")))


def catalogue_hits(queries: DataFrame, docs: DataFrame, id_col: str, text: Column, k: int) -> DataFrame:
    """What keyword_hits answers, for a catalogue in which many texts have the same words.

    Documents of the same words score equally, so their first k stand for all of them, and queries of
    the same words are searched once: what meets grows with the distinct sets of words, not with the texts.
    """
    sets = kinds(docs, id_col, text, k)
    wanted = queries.select("query_id", long_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    asked = wanted.select("w").distinct()
    met = asked.select(F.col("w").alias("q"), F.explode("w").alias("term")).join(sets.select("kind", F.explode("w").alias("term")), "term").groupBy("q", "kind").agg(F.count("*").alias("score"))
    # Of the kinds too, k by their first document hold the k best, since each has one document at least.
    best = top(met, k, "q", "kind").drop("rank").join(sets.select("kind", "ids"), "kind").select("q", "score", F.explode("ids").alias("doc_id"))
    return top(wanted.join(top(best, k, "q").drop("rank"), F.col("w") == F.col("q")).select("query_id", "doc_id", "score"), k)


def reranked(rows: DataFrame) -> DataFrame:
    """+ 0.02 a shared word (at most 0.08), - 0.01 dotted or + 0.005 parent code, - 0.008 an extra long word (at most 0.06)."""
    q, d = words(F.col("query")), words(F.col("description"))
    shared = F.least(0.02 * F.size(F.array_intersect(q, d)), F.lit(0.08))
    extra = F.least(0.008 * F.size(F.filter(F.array_except(d, q), lambda w: F.length(w) > 4)), F.lit(0.06))
    shape = F.when(F.col("code").contains("."), -0.01).otherwise(0.005)
    return rows.withColumn("score", F.greatest(F.col("score") + shared + shape - extra, F.lit(0.0)))


#: Words that tell no child from its parent (fixed values).
STRUCTURAL = ("and", "or", "of", "the", "with", "without", "other", "unspecified", "specified", "abnormal", "normal")


def prefer_parents(rows: DataFrame) -> DataFrame:
    """A child code becomes its parent where the parent is a candidate too and none of the child's own words is asked for.

    A code that two rows come to keeps the better score.
    """
    parents = rows.where(~F.col("code").contains(".")).groupBy("query_id", F.col("code").alias("parent")).agg(F.min("description").alias("wide"))
    out = rows.withColumn("parent", F.split_part("code", F.lit("."), F.lit(1))).join(parents, ["query_id", "parent"], "left")
    own = F.array_except(F.array_except(words(F.col("description")), words(F.col("wide"))), F.array(*map(F.lit, STRUCTURAL)))
    falls = F.col("code").contains(".") & F.col("wide").isNotNull() & (F.size(own) > 0) & ~F.arrays_overlap(own, words(F.col("query")))
    out = out.select("query_id", "query", F.when(falls, F.col("parent")).otherwise(F.col("code")).alias("code"), F.when(falls, F.col("wide")).otherwise(F.col("description")).alias("description"), "score")
    return out.groupBy("query_id", "query", "code", "description").agg(F.max("score").alias("score"))


def first_of(*ranked: DataFrame, k: int) -> DataFrame:
    """Ranked lists one after another, the first place of each document counts, k per query."""
    union = None
    for i, r in enumerate(ranked):
        part = r.select("query_id", "doc_id", F.struct(F.lit(i).alias("list"), "rank").alias("place"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id"))).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def code_key(c: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def looked_up(codes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Codes with their description by normalised key."""
    return codes.join(catalogue.select(code_key(F.col("code").cast("string")).alias("key"), "description"), code_key(F.col("code").cast("string")) == F.col("key"), "left").drop("key")


def costs(codes: DataFrame, code_cost: DataFrame, category_cost: DataFrame) -> DataFrame:
    """The code's cost, else its category's, else 2500 (ICD10) or 250 (CPT); null for unknown systems."""
    rows = codes.join(code_cost, ["code", "system"], "left").join(category_cost, ["category", "system"], "left")
    default = F.when(F.col("system") == "ICD10", 2500.0).when(F.col("system") == "CPT", 250.0)
    return rows.withColumn("estimate", F.coalesce("cost", "category_cost", default)).drop("cost", "category_cost")


def cross_referenced(codes: DataFrame, relation: DataFrame, most: int = 3) -> DataFrame:
    """The first few procedure codes of each diagnosis code. relation: icd, cpt, seq."""
    known = relation.select(code_key(F.col("icd").cast("string")).alias("key"), "cpt", "seq").groupBy("key", "cpt").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("seq", "cpt"))
    few = known.withColumn("rank", rank).where(F.col("rank") <= most).drop("seq")
    return codes.withColumn("key", code_key(F.col("code").cast("string"))).join(few, "key").drop("key")


#: Kinds of entities that are coded as diagnoses, and as procedures (fixed values).
DIAGNOSIS_KINDS, PROCEDURE_KINDS = ("DIAGNOSIS", "DISEASE", "SYMPTOM", "FINDING", "CONDITION"), ("PROCEDURE", "TREATMENT", "SURGERY")


def entity_codes(entities: DataFrame, search: dict) -> DataFrame:
    """The best code of each of a claim's entities; a text that comes again in other case counts once, as its first.

    search: by system (ICD10, CPT) a function from queries (query_id, text) to ranked hits (query_id, doc_id, score, rank).
    Each distinct text is searched once, whatever the number of claims that name it.
    """
    kind, term = F.upper("entity_type"), F.lower(F.trim("entity_text"))
    system = F.when(kind.isin(*DIAGNOSIS_KINDS), "ICD10").when(kind.isin(*PROCEDURE_KINDS), "CPT")
    first = entities.where(F.trim("entity_text") != "").groupBy("claim_id", term.alias("term")).agg(F.min_by(F.struct(F.trim("entity_text").alias("entity_text"), system.alias("system")), "seq").alias("e")).select("claim_id", "term", "e.*").where("system IS NOT NULL")
    terms = stored(first.select("term", "system").distinct())
    out = None
    for name, find in search.items():
        asked = terms.where(F.col("system") == name).select("term")
        hits = find(asked.select(F.col("term").alias("query_id"), F.col("term").alias("text"))).where("rank = 1").select(F.col("query_id").alias("term"), F.lit(name).alias("system"), F.col("doc_id").alias("code"), "score")
        out = hits if out is None else out.unionByName(hits)
    return first.join(out, ["term", "system"]).select("claim_id", "entity_text", "system", "code", "score")


def _grams(text: Column, n: int) -> Column:
    """Distinct pieces of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s, l) of texts of which s is a piece of l: s meets l by its rarest trigram, and is confirmed.

    Texts of one or two characters meet by their whole. So no pair is lost, and none is tried without a shared key.
    """
    out = None
    for n in (1, 2, 3):
        own = short.where(F.length("s") == n) if n < 3 else short.where(F.length("s") >= 3)
        pieces = long.select("l", F.explode(_grams(F.col("l"), n)).alias("gram"))
        counts = pieces.groupBy("gram").agg(F.count("*").alias("times"))
        # A piece that no long text has rules its text out.
        grams = own.select("s", F.explode(_grams(F.col("s"), n)).alias("gram")).join(counts, "gram", "left")
        key = grams.groupBy("s").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("k")).select("s", F.col("k.gram").alias("gram"))
        pairs = key.join(pieces, "gram").where(F.col("l").contains(F.col("s"))).select("s", "l")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def by_synonym(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """A term's code: of the equal synonym; else of the longest that the term holds or that holds the term; else null."""
    t, s = terms.select("term").distinct(), synonyms.select("synonym").distinct()
    held = contained(s.select(F.col("synonym").alias("s")), t.select(F.col("term").alias("l"))).select(F.col("l").alias("term"), F.col("s").alias("synonym"))
    holds = contained(t.select(F.col("term").alias("s")), s.select(F.col("synonym").alias("l"))).select(F.col("s").alias("term"), F.col("l").alias("synonym"))
    near = held.unionByName(holds).join(synonyms, "synonym")
    best = near.groupBy("term").agg(F.max_by("code", F.struct(F.col("term") == F.col("synonym"), F.length("synonym"), "code")).alias("code"))
    return t.join(best, "term", "left")


def unsupported(claimed: DataFrame, found: DataFrame) -> DataFrame:
    """Codes claimed but not found, and found but not claimed; each once, of one shuffle. A null is a code like others."""
    both = claimed.select("claim_id", "code", F.lit(1).alias("side")).unionByName(found.select("claim_id", "code", F.lit(2).alias("side")))
    one = both.groupBy("claim_id", "code").agg(F.bit_or("side").alias("side")).where("side <> 3")
    return one.select("claim_id", "code", F.when(F.col("side") == 1, "unsupported").otherwise("missing").alias("side"))


def assigned(explicit: DataFrame, hits: DataFrame, most: int = 4) -> DataFrame:
    """Explicit codes win; else the best hit per term, by score; the first is primary.

    Without explicit codes one is assigned, or up to three where the best score is under 0.5. A claim's
    rows are shuffled once, to as many partitions as keep TASK_ROWS in each.
    """
    said = explicit.select("claim_id", F.lit(None).cast(hits.schema["term"].dataType).alias("term"), "code", F.lit(0.9).alias("score"), F.lit(0).alias("list"))
    rows = said.unionByName(hits.select("claim_id", "term", "code", "score", F.lit(1).alias("list")))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(explicit.count() + hits.count()) // TASK_ROWS))
    best = F.row_number().over(Window.partitionBy("claim_id", "list", "term").orderBy(F.desc("score"), "code"))
    rows = rows.repartition(parts, "claim_id").withColumn("best", best).where("list = 0 OR best = 1")
    one = rows.groupBy("claim_id", "code").agg(F.min("list").alias("list"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy("list", F.desc("score"), "code"))
    w = Window.partitionBy("claim_id")
    few = F.when(F.min("list").over(w) == 0, most).when(F.max("score").over(w) >= 0.5, 1).otherwise(3)
    return one.withColumn("rank", rank).withColumn("few", few).where(F.col("rank") <= F.col("few")).drop("few").withColumn("is_primary", F.col("rank") == 1)


def claim_terms(fields: DataFrame, most: int = 5) -> DataFrame:
    """Up to five distinct diagnosis or procedure texts of a claim, joined by semicolons."""
    rows = fields.where(F.lower("field_name").rlike("diagnos|procedure")).groupBy("claim_id", F.lower(F.trim("field_value")).alias("term")).agg(F.min("seq").alias("seq"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("claim_id").orderBy("seq", "term"))).where(F.col("r") <= most)
    return first.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), "; ").alias("terms"))


def highlights(hits: DataFrame, most: int = 3) -> DataFrame:
    """A claim's hits with the first few as highlights."""
    r = hits.withColumn("r", F.row_number().over(Window.partitionBy("claim_id").orderBy("place"))).where(F.col("r") <= most)
    return r.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("r", "snippet"))).alias("highlights"))
