"""Best documents per query over blocked postings: each block tells its greatest weights, and what can't matter isn't read."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import words
from claimloom.operators.retrieval import EPSILON, K1, B, top
from claimloom.sources.storage import stored

#: About how many documents a block holds, how many blocks of a query are scored before the others are judged, and the rounding of scores.
BLOCK, SEED, DIGITS = 32, 64, 6
#: About how many words a block holds at most, where no single document has more, and how many a task inverts.
BLOCK_WORDS, TASK_WORDS = 1 << 16, 1 << 20
#: From how many asked terms on a search scores all their postings in one pass, and about how many rows of the index a task reads for its queries.
MANY, TASK_READS = 2_000, 1 << 19


def tokenised(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(doc_id, doc_len, terms, tfs), written: each text's distinct words with their counts, made once. Ids are unique.

    A text is one row, so its words are sorted and counted by runs within it, without a shuffle. terms are
    joined by spaces, which no word holds, since a row of many small values is much larger than their letters.
    Null texts have a null length, and no terms.
    """
    said = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(tokens).alias("w"))
    runs = said.withColumn("begins", begins("w", lambda w: w))
    terms, tfs = F.transform("begins", lambda i: F.get("w", i)), F.transform("begins", lambda i, j: ends("w", j) - i)
    return stored(runs.select("doc_id", F.size("w").alias("doc_len"), F.array_join(terms, " ").alias("terms"), tfs.alias("tfs")), "zstd")


def begins(sorted_: str, key: Callable[[Column], Column]) -> Column:
    """Where each run of equal keys begins in a sorted array."""
    starts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (key(F.get(sorted_, i)) != key(F.get(sorted_, i - 1))))
    return F.when(F.size(sorted_) > 0, starts).otherwise(F.array().cast("array<int>"))


def ends(sorted_: str, run: Column) -> Column:
    """Where a run of the column `begins` ends: at the next one, or with the array."""
    return F.coalesce(F.get("begins", run + 1), F.size(sorted_))


def in_blocks(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents with words, and the number of each one's block.

    A block holds documents of like length, whose weights are alike. Lengths fall into at most 128
    classes (a quarter of a doubling each), and a class into as many blocks as its count asks for, or
    its words: a block is inverted in one row.
    """
    sized = tokens.where("doc_len > 0").withColumn("like", F.floor(4 * F.log2("doc_len")))
    classes = sized.groupBy("like").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("doc_len") / BLOCK_WORDS)).alias("blocks"))
    number = F.shiftleft(F.col("like"), 48) + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    return sized.join(F.broadcast(classes), "like").withColumn("block", number).drop("like", "blocks")


def blocked(tokens: DataFrame, mean: Column, weight: Callable[[Column, Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """Postings (term, block, greatest, docs), written. docs: the block's documents that have the term, with their weights.

    weight: of a term's count, its document's length and their mean. A row holds no more than its
    block's documents, so a term that is everywhere is many rows. What is shuffled is one row a document,
    since a block's documents are all that its postings need; a block is inverted within its row, and a
    task has about TASK_WORDS, so that it holds its blocks in memory however large the table is.
    """
    tasks = -(-(tokens.agg(F.sum("doc_len")).first()[0] or 1) // TASK_WORDS)
    dealt = in_blocks(tokens, block).repartition(tasks, "block")
    held = dealt.groupBy("block").agg(F.collect_list(F.struct("doc_id", "doc_len", "terms", "tfs")).alias("texts")).withColumn("mean", mean)
    one = lambda d: F.transform(F.split(d["terms"], " "), lambda t, i: F.struct(t.alias("term"), d["doc_id"].alias("doc_id"), weight(F.get(d["tfs"], i), d["doc_len"], F.col("mean")).alias("weight")))
    said = held.select("block", F.array_sort(F.flatten(F.transform("texts", one))).alias("said"))
    runs = said.withColumn("begins", begins("said", lambda p: p["term"]))
    run = lambda i, j: F.struct(F.get("said", i)["term"].alias("term"), F.transform(F.slice("said", i + 1, ends("said", j) - i), lambda p: F.struct(p["doc_id"].alias("doc_id"), p["weight"].alias("weight"))).alias("docs"))
    rows = runs.select("block", F.inline(F.transform("begins", run)))
    return stored(rows.select("term", "block", F.array_max("docs.weight").alias("greatest"), "docs"), "zstd")


def parts(asked: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id, part): the postings of the asked terms in the asked blocks, each times its factor."""
    read = asked.join(index.select("term", "block", "docs"), ["term", "block"]).select(*keys, "factor", F.explode("docs").alias("d"))
    return read.select(*keys, F.col("d.doc_id").alias("doc_id"), (F.col("factor") * F.col("d.weight")).alias("part"))


class Plan(NamedTuple):
    """What a search reads, each written.

    met: the postings of the asked terms; seed: the terms of the seed blocks; told: the scores there; rest: the terms of
    the other blocks, with what they can add at most and whether a document needs one of them (`essential`);
    alive: the documents that these leave, with their sums over the essential terms.
    """

    met: DataFrame
    seed: DataFrame
    told: DataFrame
    rest: DataFrame
    alive: DataFrame


def plan(wanted: DataFrame, index: DataFrame, k: int, seed: int = SEED) -> Plan:
    """Judges each query's blocks and documents by the k-th best score of its seed blocks. wanted: query_id, term, factor.

    A block's terms are put in the order of what they can add there. Those whose sum stays under
    that score are not essential: a document with these alone isn't among the k best, so only the
    others' postings are read, and none of a block that has no essential term. A document whose sum
    over them can't come to the score with all the rest is dropped. A query with fewer than k
    documents in its seed blocks drops none. Equal scores stay, since the document decides between
    them; scores are rounded, so the bounds have a unit of the last digit to spare.

    The asked terms' postings are taken out of the index once, in the only pass over it, and blocks are looked
    up among these. What is looked up is few rows of a larger table, so it's written: by its own
    size it is sent to the postings, where by the table's these would be shuffled each time.
    """
    met = stored(index.join(wanted.select("term"), "term", "left_semi"), "zstd")
    able = stored(wanted.join(met.select("term", "block", "greatest"), "term").withColumn("up", F.greatest(F.col("factor") * F.col("greatest"), F.lit(0.0))).drop("greatest"))
    first = stored(top(able.groupBy("query_id", "block").agg(F.sum("up").alias("score")), seed, doc="block").select("query_id", "block"))
    begun = stored(able.join(first, ["query_id", "block"], "left_semi"))
    told = stored(rounded(parts(begun, met, "query_id")))
    least = top(told, k).where(F.col("rank") == k).select("query_id", (F.col("score") - 10**-DIGITS).alias("least"))
    upto = F.sum("up").over(Window.partitionBy("query_id", "block").orderBy("up", "term").rowsBetween(Window.unboundedPreceding, 0))
    rest = able.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left").withColumn("essential", F.col("least").isNull() | (upto >= F.col("least")))
    rest = stored(rest)
    sums = parts(stored(rest.where("essential")), met, "query_id", "block").groupBy("query_id", "block", "doc_id").agg(F.sum("part").alias("part"))
    others = rest.where("NOT essential").groupBy("query_id", "block", "least").agg(F.sum("up").alias("others"))
    alive = sums.join(others, ["query_id", "block"], "left").where(F.col("least").isNull() | (F.col("part") + F.col("others") >= F.col("least")))
    return Plan(met, begun, told, rest, stored(alive.select("query_id", "block", "doc_id", "part")))


def scored_whole(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) over 0, from all postings of the asked terms.

    Many queries leave little of the index unread, and what they need of each block is many times the block
    itself, so that judging blocks costs more than it saves. The asked postings are shuffled once, by
    block, and a block's documents are scored where it is.
    """
    read = index.select("term").join(wanted.select("term"), "term").count()
    met = index.select("term", "block", "docs").join(wanted.select("term"), "term", "left_semi")
    dealt = met.repartition(max(1, -(-read // TASK_READS)), "block")
    read = dealt.join(wanted, "term").select("query_id", "block", "factor", F.explode("docs").alias("d"))
    each = read.select("query_id", "block", F.col("d.doc_id").alias("doc_id"), (F.col("factor") * F.col("d.weight")).alias("part"))
    return each.groupBy("query_id", "block", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score")).where("score > 0").drop("block")


def remaining(found: Plan) -> DataFrame:
    """The terms that aren't essential, in the blocks that have a document left: what is read to end the scores."""
    return found.rest.where("NOT essential").join(found.alive, ["query_id", "block"], "left_semi")


def rounded(each: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the parts added up, where they are over 0."""
    return each.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score")).where("score > 0")


class Index(NamedTuple):
    """Written postings and the factor of each term, built once for any number of searches."""

    postings: DataFrame
    factors: DataFrame


def bm25_index(docs: DataFrame, id_col: str, text: Column, block: int = BLOCK) -> Index:
    """The index of Okapi scores: a term's factor is its idf, a negative one EPSILON of the mean of all."""
    tokens = tokenised(docs, id_col, words(text))
    told = tokens.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean"))
    weight = lambda tf, doc_len, mean: tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean))
    index = blocked(tokens, told.select("mean").scalar(), weight, block)
    df = index.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    raw = stored(df.select("term", F.log((told.select("n").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")))
    return Index(index, stored(raw.select("term", F.when(F.col("raw") < 0, EPSILON * raw.agg(F.avg("raw")).scalar()).otherwise(F.col("raw")).alias("factor"))))


def searched(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best documents of each query, exactly, ties by document: (query_id, doc_id, score, rank). queries: query_id, text.

    A query's factor of a term is the term's times how often the query says it; terms without a
    factor are in no document. A query without words, or with none that occurs, finds nothing.
    """
    said = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("said"))
    wanted = stored(said.join(index.factors, "term").select("query_id", "term", (F.col("said") * F.col("factor")).alias("factor")))
    if wanted.count() > MANY:
        return top(scored_whole(wanted, index.postings), k)
    found = plan(wanted, index.postings, k)
    more = parts(stored(remaining(found)), found.met, "query_id", "block").join(found.alive, ["query_id", "block", "doc_id"], "left_semi")
    each = found.alive.unionByName(more).drop("block")
    return top(found.told.unionByName(rounded(each)), k)
