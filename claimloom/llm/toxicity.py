"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's score is the logistic of a bias plus the weights of its words and their prefixes; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p). Only document labels are known: the gradient of the
documents' likelihood is shared among their sentences by their scores, so that the sentences
that explain a label take it up, and offending sentences can be located afterwards.

Weights are fitted on the driver to a bounded sample: at most SAMPLE_DOCS labelled documents of
at most SAMPLE_CHARS characters each, half of each label as far as there are, chosen by a hash
of the id and weighted back to the labels' shares. Features seen in fewer than
LEAST_DOCS sampled documents, or whose presence there is not tied to the label (chi-squared
under CHI2), have no weight. Scoring runs over every whole text, without a shuffle.

Sentences end at . ! ? or a line end; words are runs of letters (bytes from 0x80 count as
letters), A-Z lower-cased. A null text or one without words scores 0. Repeated rows each get a
row. Labels other than 0 and 1 are not learned from; without a labelled row all scores are 0.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import parts, span_hashes, spans

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 6_000
LEAST_DOCS = 4
#: Besides whole words, prefixes of so many bytes are features.
PREFIXES = (5, 6, 7, 8)
#: Least chi-squared of a word's presence with the label.
CHI2 = 20.0
STEPS, RATE, RIDGE = 250, 0.1, 3e-5
BIAS = -6.0
THRESHOLD = 0.7
#: Least score of a sentence that offends.
LOCATED = 0.5

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


class Bags:
    """Word hashes of a slice of documents, with the sentences and documents they stand in."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        starts, ends = spans(_WORD[data], off)
        self.words = span_hashes(data, starts, ends)
        self.kinds = [(np.arange(len(starts)), self.words)]
        for k, size in enumerate(PREFIXES):
            long = np.flatnonzero(ends - starts >= size)
            self.kinds.append((long, span_hashes(data, starts[long], starts[long] + size) ^ np.uint64(k + 1)))
        doc = np.searchsorted(off, starts, side="right") - 1
        part = np.concatenate([[0], np.cumsum(_END[data])])[starts] if len(data) else np.zeros(0, np.int64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        self.word_starts, self.word_ends = starts, ends
        self.heads = np.flatnonzero(fresh)  # first word of each sentence
        self.sentence_doc = doc[self.heads]
        self.first = np.searchsorted(self.sentence_doc, np.arange(len(off)))  # first sentence of each document

    def logits(self, known: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        """Of each sentence."""
        if not len(self.words):
            return np.zeros(0)
        each = np.zeros(len(self.words))
        for at, hashes in self.kinds:
            each[at] += _weights(hashes, known, weights)
        return bias + np.add.reduceat(each, self.heads)


def _together(slices: list[Bags]) -> Bags:
    """One bag list of several slices'; word positions are left out."""
    out = object.__new__(Bags)
    words = np.cumsum([0, *(len(b.words) for b in slices)])
    docs = np.cumsum([0, *(len(b.first) - 1 for b in slices)])
    out.words = np.concatenate([b.words for b in slices])
    out.kinds = [tuple(map(np.concatenate, zip(*((b.kinds[k][0] + w, b.kinds[k][1]) for b, w in zip(slices, words, strict=False)), strict=True))) for k in range(len(PREFIXES) + 1)]
    out.heads = np.concatenate([b.heads + w for b, w in zip(slices, words, strict=False)])
    out.sentence_doc = np.concatenate([b.sentence_doc + d for b, d in zip(slices, docs, strict=False)])
    out.first = np.searchsorted(out.sentence_doc, np.arange(docs[-1] + 1))
    return out


def _weights(words: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(words))
    i = np.searchsorted(known, words)
    i[i == len(known)] = 0
    return np.where(known[i] == words, weights[i], 0.0)


def _keeps(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each document's log of prod(1 - p)."""
    total = np.concatenate([[0.0], np.cumsum(-np.logaddexp(0, logits))])
    return total[first[1:]] - total[first[:-1]]


def scores(bags: Bags, model: dict) -> np.ndarray:
    if not len(model["known"]):
        return np.zeros(len(bags.first) - 1)
    return np.clip(-np.expm1(_keeps(bags.logits(model["known"], model["weights"], model["bias"]), bags.first)), 0, 1)


def _chi2(times: np.ndarray, with_1: np.ndarray, docs: int, docs_1: float) -> np.ndarray:
    """Of each word's presence with the documents' labels."""
    expect = times * docs_1 / docs
    spread = expect * (1 - docs_1 / docs) * (1 - times / docs)
    return np.where(spread > 0, (with_1 - expect) ** 2 / np.maximum(spread, 1e-12), 0)


def fit(rows: list[tuple[int, str]], share: float | None = None) -> dict:
    """A model from (label, text) rows; share: of label 1 among all labelled rows."""
    model = {"known": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": BIAS}
    if not rows:
        return model
    bags = _together([Bags(data, off) for _, _, data, off in parts(pa.array([t for _, t in rows]))])
    y = np.array([v for v, _ in rows], float)
    share = y.mean() if share is None else share
    mean = y.mean()
    worth = np.where(y > 0, share / max(mean, 1e-9), (1 - share) / max(1 - mean, 1e-9)) / len(y)
    size = np.diff(np.append(bags.heads, len(bags.words)))
    doc, sentence = np.repeat(bags.sentence_doc, size), np.repeat(np.arange(len(size)), size)
    known, keys, places = [], [], []
    for at, hashes in bags.kinds:
        names, back = np.unique(hashes, return_inverse=True)
        pairs = np.unique(back * np.int64(len(rows)) + doc[at])
        times, with_1 = np.bincount(pairs // len(rows), minlength=len(names)), np.bincount(pairs // len(rows), y[pairs % len(rows)] > 0, minlength=len(names))
        good = (times >= LEAST_DOCS) & (_chi2(times, with_1, len(y), y.sum()) >= CHI2)
        known.append(names[good])
        use = good[back]
        keys.append(hashes[use])
        places.append(sentence[at[use]])
    known = np.unique(np.concatenate(known))
    slot, place = np.searchsorted(known, np.concatenate(keys)), np.concatenate(places)
    w, b = np.zeros(len(known) + 1), BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        logit = b + np.bincount(place, w[slot], len(size))
        keep = _keeps(logit, bags.first)
        p = 1 / (1 + np.exp(-logit))
        gone = -np.expm1(keep)
        pull = np.where(y > 0, np.exp(keep) / np.maximum(gone, 1e-9), -1.0) * worth
        g = pull[bags.sentence_doc] * p
        grad = np.append(np.bincount(slot, g[place], len(w)) - RIDGE * w, g.sum())
        grad[len(known)] = 0
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w += move[:-1]
        b += move[-1]
    return {"known": known, "weights": w[:-1], "bias": b}


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[int, str]], float]:
    """About `most` (label, text) rows and the share of label 1. A document labelled both ways counts as 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], 0.0
    spread, hashed = 1 << 30, F.xxhash64(F.col(id_col), F.lit(4))
    part = {k: int(spread * min(1.0, most / 2 / n)) for k, n in counts.items()}
    chosen = known.where(F.pmod(hashed, F.lit(spread)) < F.when(F.col("label") == 1, part.get(1, 0)).otherwise(part.get(0, 0)))
    # The sample's size has a bound, so it may be broadcast; texts aren't shuffled.
    rows = docs.select(id_col, text_col).where(F.length(text_col).between(1, chars)).join(F.broadcast(chosen), id_col).select(hashed, "label", text_col).collect()
    return [(r[1], r[2]) for r in sorted(rows)], counts.get(1, 0) / sum(counts.values())


def located(bags: Bags, p: np.ndarray, score: np.ndarray, least: float = LOCATED) -> np.ndarray:
    """Numbers of the sentences that offend: those of `least` or more, and the highest (first at ties) of each document of THRESHOLD or more."""
    hit = p >= least
    for d in np.flatnonzero(score >= THRESHOLD):
        hit[bags.first[d] + p[bags.first[d] : bags.first[d + 1]].argmax()] = True
    return np.flatnonzero(hit)


def _scored(shared, text_at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, off in parts(batch.column(text_at)):
                bags = Bags(data, off)
                got = scores(bags, model)
                p = 1 / (1 + np.exp(-bags.logits(model["known"], model["weights"], model["bias"])))
                hit = located(bags, p, got) if len(model["known"]) else np.zeros(0, np.int64)
                doc = bags.sentence_doc[hit]
                last = np.append(bags.heads[1:], len(bags.words))[hit] - 1
                # Code points before a byte of its document: bytes that begin one.
                begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(hit) else np.zeros(1, np.int64)
                start, end = begun[bags.word_starts[bags.heads[hit]]] - begun[off[doc]], begun[bags.word_ends[last]] - begun[off[doc]]
                values = pa.StructArray.from_arrays([pa.array(hit - bags.first[doc], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p[hit], pa.float64())], ["sentence", "start", "end", "p"])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keep), pa.array(got, pa.float64()), found], [*(batch.schema.names[k] for k in keep), "score", "offending"])

    return run


def score(docs: DataFrame, model: dict, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs with score and offending, one row for each row.

    offending lists the sentences that explain a score (`located`): number from 0, start and end (code
    points of the text, end exclusive, from the first word to the last) and p.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in columns if c not in ("score", "offending")]
    inner = list(dict.fromkeys([*keep, text_col]))
    source = docs.select(*[docs[c] for c in inner])
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), "score double, offending array<struct<sentence: bigint, start: bigint, end: bigint, p: double>>"])
    return source.mapInArrow(_scored(shared, inner.index(text_col), [inner.index(c) for c in keep]), schema)


def offending(docs: DataFrame, model: dict, least: float = LOCATED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences scored `least` or more: id, sentence (its number), text from its first to its last word, p."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in parts(batch.column(1)):
                bags = Bags(data, off)
                if not len(bags.words) or not len(shared.value["known"]):
                    continue
                p = 1 / (1 + np.exp(-bags.logits(shared.value["known"], shared.value["weights"], shared.value["bias"])))
                hit = np.flatnonzero(p >= least)
                last = np.append(bags.heads[1:], len(bags.words)) - 1
                text = [data[bags.word_starts[bags.heads[s]] : bags.word_ends[last[s]]].tobytes().decode("utf-8", "replace") for s in hit]
                doc = bags.sentence_doc[hit]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), pa.array(hit - bags.first[doc], pa.int64()), pa.array(text, pa.string()), pa.array(p[hit], pa.float64())], ["id", "sentence", "text", "p"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, sentence long, text string, p double")
