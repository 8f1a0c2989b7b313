"""Language identification by a linear-chain conditional random field over words.

Each word's label is a language. Its features are byte bigrams and trigrams with word bounds,
prefixes and suffixes of 3 and 4 bytes, all hashed into one weight table, and membership in
word lists learned per language; transitions between labels are learned too. Forward-backward
gives each word's label probabilities; a document's language is the label with most mass.

The field is fitted on the driver to a bounded sample of labelled documents: at most
SAMPLE_DOCS of at most SAMPLE_CHARS characters each, an equal share for each language, chosen
by a hash of the id. Their texts are used whole, and also spliced into code-switched sequences,
so that transitions are learned. Prediction runs over every document's whole text.

A null text, or one without a letter, is `und` with score 0. Repeated rows each get a row.
Rows with a null label are predicted but never learned from; without any labelled row all
documents are `und`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import LOWER, parts, span_hashes, spans

SAMPLE_DOCS, SAMPLE_CHARS = 500, 6_000
#: Bytes of text that are labelled at once: a worker's arrays take some hundred times that.
SLICE = 1 << 18
TABLE_BITS = 17
LEXICON = 300
EPOCHS, RATE, DECAY = 4, 0.3, 1e-6
BLOCK = 64
UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = LOWER[65:91]
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


class Words:
    """Words of a slice of documents with their feature slots."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        own = np.repeat(np.arange(n), np.diff(off))
        b = np.zeros(len(data) + n + 4, np.uint8)
        at = np.arange(len(data)) + own + 1
        b[at] = _LETTER[data]
        off = off + np.arange(n + 1)
        self.starts, self.ends = spans(b[: len(b) - 3] > 0, np.zeros(1, np.int64))
        self.first = np.searchsorted(self.starts, off)
        self.hashes = span_hashes(b, self.starts, self.ends, lower=False)
        size = self.ends - self.starts
        self.byte_at = np.concatenate([[0], np.cumsum(size)])
        i = np.flatnonzero(b)
        w = b.astype(np.uint32)
        left, mid, right = w[i - 1], w[i], w[i + 1]
        self.three = _slot((left << 16) | (mid << 8) | right, 1)
        self.two = _slot((mid << 8) | right, 2)
        s, e = self.starts, self.ends
        pick = lambda k: np.where(k < e, w[np.minimum(k, len(w) - 1)], 0)
        back = lambda k: np.where(k >= s, w[np.maximum(k, 0)], 0)
        three = (pick(s) << 16) | (pick(s + 1) << 8) | pick(s + 2)
        tail = (back(e - 3) << 16) | (back(e - 2) << 8) | back(e - 1)
        self.affixes = [_slot(three, 3), _slot(tail, 4), _slot((three << 8) | pick(s + 3), 5), _slot(tail | (back(e - 4) << 24), 6)]

    def __len__(self) -> int:
        return len(self.starts)


def _slot(code: np.ndarray, kind: int) -> np.ndarray:
    x = (code.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


class Field:
    """Weights of the features, the word lists, transitions and starts."""

    def __init__(self, labels: list[str], lists: list[np.ndarray]):
        self.labels, n = labels, len(labels)
        words = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        self.words = words
        self.member = np.stack([np.isin(words, x) for x in lists], 1).astype(np.float32) if lists else np.zeros((0, n), np.float32)
        self.table = np.zeros((1 << TABLE_BITS, n), np.float32)
        self.lexicon = np.zeros((n, n), np.float32)
        self.moves = np.where(np.eye(n, dtype=bool), 2.0, -2.0)
        self.start = np.zeros(n)

    def in_lists(self, words: Words) -> np.ndarray:
        """[words, languages]: which lists hold each word."""
        if not len(self.words):
            return np.zeros((len(words), len(self.labels)), np.float32)
        i = np.minimum(np.searchsorted(self.words, words.hashes), len(self.words) - 1)
        return self.member[i] * (self.words[i] == words.hashes)[:, None]

    def emissions(self, words: Words, lists: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros((0, len(self.labels)), np.float32)
        grams = self.table.take(words.three, 0)
        grams += self.table.take(words.two, 0)
        out = np.add.reduceat(grams, words.byte_at[:-1], 0)
        for slot in words.affixes:
            out += self.table.take(slot, 0)
        return out + lists @ self.lexicon

    def marginals(self, emissions: np.ndarray, fresh: np.ndarray, pairs: bool = False):
        """Label probabilities of each word; fresh: words that open a document.

        All documents stand in one row; a fresh word's transition forgets what is before it.
        The row is cut in blocks: the blocks' products are found side by side, joined in
        order, and then each block's words are filled in side by side. Nothing is approximated.
        """
        total, n = emissions.shape
        blocks = -(-total // BLOCK)
        e = np.ones((blocks * BLOCK, n))
        e[:total] = np.exp(emissions - emissions.max(1, keepdims=True))
        new = np.zeros(blocks * BLOCK, bool)
        new[:total] = fresh
        new[total:] = True
        e, new = e.reshape(blocks, BLOCK, n), new.reshape(blocks, BLOCK)
        move = np.exp(self.moves - self.moves.max())
        start = np.exp(self.start - self.start.max())
        start /= start.sum()

        def step(x: np.ndarray, t: int) -> np.ndarray:
            y = x @ move
            f = new[:, t]
            if f.any():
                y[f] = x[f].sum(-1, keepdims=True) * start
            return y

        product = np.broadcast_to(np.eye(n), (blocks, n, n)).copy()
        for t in range(BLOCK):
            product = step(product, t) * e[:, t, None, :]
            product /= product.max((1, 2), keepdims=True)
        into, out = np.empty((blocks, n)), np.empty((blocks, n))
        a = np.full(n, 1 / n)
        for k in range(blocks):
            into[k] = a
            a = a @ product[k]
            a = a / a.sum()
        z = np.ones(n)
        for k in range(blocks - 1, -1, -1):
            out[k] = z
            z = product[k] @ z
            z = z / z.max()
        alpha, beta = np.empty((blocks, BLOCK, n)), np.empty((blocks, BLOCK, n))
        for t in range(BLOCK):
            into = step(into, t) * e[:, t]
            into /= into.sum(1, keepdims=True)
            alpha[:, t] = into
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = out
            y = e[:, t] * out
            z = y @ move.T
            f = new[:, t]
            z[f] = (y[f] * start).sum(1, keepdims=True)
            out = z / z.max(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        p = p.reshape(-1, n)[:total]
        if not pairs:
            return p
        late = (e * beta).reshape(-1, n)[:total]
        joint = alpha.reshape(-1, n)[: total - 1, :, None] * move * late[1:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        return p, joint[~fresh[1:]].sum(0)

    def fit(self, words: Words, gold: np.ndarray, fresh: np.ndarray, rng: np.random.Generator) -> None:
        n = len(self.labels)
        lists = self.in_lists(words)
        onehot = np.eye(n)[gold]
        g_table, g_lex, g_move, g_start = np.full_like(self.table, 1e-2), np.full_like(self.lexicon, 1e-2), np.full((n, n), 1e-2), np.full(n, 1e-2)
        heads = np.flatnonzero(fresh)
        cuts = np.append(heads[:: max(1, len(heads) // 60)], len(words))
        order = np.arange(len(cuts) - 1)
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for k in order:
                a, b = cuts[k], cuts[k + 1]
                if b - a < 2:
                    continue
                part = _Part(words, a, b)
                p, joint = self.marginals(self.emissions(part, lists[a:b]), fresh[a:b], True)
                d = (onehot[a:b] - p).astype(np.float32)
                grad = np.empty_like(self.table)
                own = np.repeat(np.arange(b - a), np.diff(part.byte_at))
                slots = np.concatenate([part.three, part.two, *part.affixes])
                rows = np.concatenate([own, own, *[np.arange(b - a)] * len(part.affixes)])
                for c in range(n):
                    grad[:, c] = np.bincount(slots, d[rows, c], len(self.table))
                size = b - a
                grad = grad / size - DECAY * self.table
                g_table += grad * grad
                self.table += RATE * grad / np.sqrt(g_table + 1e-8)
                grad = lists[a:b].T @ d / size
                g_lex += grad * grad
                self.lexicon += RATE * grad / np.sqrt(g_lex)
                seen = np.zeros((n, n))
                g = gold[a:b]
                inside = np.flatnonzero(~fresh[a + 1 : b])
                np.add.at(seen, (g[inside], g[inside + 1]), 1)
                grad = (seen - joint) / size
                g_move += grad * grad
                self.moves += RATE * grad / np.sqrt(g_move)
                at = np.flatnonzero(fresh[a:b])
                grad = d[at].sum(0) / size
                g_start += grad * grad
                self.start += RATE * grad / np.sqrt(g_start)


class _Part(Words):
    """Words a to b of others."""

    def __init__(self, words: Words, a: int, b: int):
        x, y = words.byte_at[a], words.byte_at[b]
        self.starts, self.ends, self.hashes = words.starts[a:b], words.ends[a:b], words.hashes[a:b]
        self.byte_at = words.byte_at[a : b + 1] - x
        self.three, self.two = words.three[x:y], words.two[x:y]
        self.affixes = [s[a:b] for s in words.affixes]


def _field(state: dict) -> Field:
    out = object.__new__(Field)
    vars(out).update(state)
    return out


def sample(docs: DataFrame, learn: Column, label: str, id_col: str, text_col: str, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple]:
    """About `most` (label, text) rows, an equal share of each label, by a hash of the id; of a text over `chars` a slice that the hash chooses."""
    known = docs.where(learn & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if not counts:
        return []
    share = max(1, most // len(counts))
    spread = 1 << 30
    least = F.lit(0)
    for value, n in counts.items():
        least = F.when(F.col(label) == value, F.lit(int(spread * min(1.0, 1.1 * share / n)))).otherwise(least)
    rows = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(spread)) < least).where(F.length(text_col) > 0)
    text, size = F.col(text_col), F.length(text_col)
    piece = F.when(size <= chars, text).otherwise(F.substr(text, (F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.greatest(size - chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(chars)))
    got = sorted(rows.select(F.xxhash64(F.col(id_col), F.lit(3)), label, piece).collect())
    left = dict.fromkeys(counts, share)
    out = []
    for _, value, text in got:
        if left[value]:
            left[value] -= 1
            out.append((value, text))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 1) -> Field:
    """A field from (language, text) rows."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Field([], [])
    rng = np.random.default_rng(seed)
    raw = [t.encode() for _, t in rows]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    of = np.repeat([labels.index(v) for v, _ in rows], np.diff(words.first))
    lists = []
    for k in range(len(labels)):
        seen, times = np.unique(words.hashes[of == k], return_counts=True)
        lists.append(seen[np.argsort(-times, kind="stable")[:LEXICON]])
    field = Field(labels, lists)
    fresh = np.zeros(len(words), bool)
    fresh[words.first[:-1][np.diff(words.first) > 0]] = True
    # Half of the documents stay whole; the others' spans are dealt anew into mixed sequences.
    doc = np.repeat(np.arange(len(rows)), np.diff(words.first))
    mixed = rng.random(len(rows)) < 0.5
    pieces = []
    for d in rng.permutation(np.flatnonzero(mixed)):
        a, b = words.first[d], words.first[d + 1]
        while a < b:
            c = min(b, a + int(rng.integers(3, 60)))
            pieces.append((a, c))
            a = c
    order = [np.flatnonzero(~mixed[doc])]
    starts = [fresh[order[0]]]
    rng.shuffle(pieces)
    for k, (a, c) in enumerate(pieces):
        order.append(np.arange(a, c))
        head = np.zeros(c - a, bool)
        head[0] = k % 6 == 0
        starts.append(head)
    order, fresh = np.concatenate(order), np.concatenate(starts)
    if len(order) > 1:
        field.fit(_taken(words, order), of[order], fresh, rng)
    return field


def _taken(words: Words, order: np.ndarray) -> Words:
    """Words in another order."""
    out = object.__new__(Words)
    size = np.diff(words.byte_at)[order]
    out.byte_at = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(words.byte_at[:-1][order] - out.byte_at[:-1], size) + np.arange(out.byte_at[-1])
    out.three, out.two = words.three[at], words.two[at]
    out.starts, out.ends, out.hashes = words.starts[order], words.ends[order], words.hashes[order]
    out.affixes = [s[order] for s in words.affixes]
    return out


def _letterless(data: np.ndarray, off: np.ndarray, doubtful: np.ndarray) -> Iterator[int]:
    for d in doubtful:
        if not any(c.isalpha() for c in data[off[d] : off[d + 1]].tobytes().decode()):
            yield d


def labelled(field: Field, data: np.ndarray, off: np.ndarray):
    """Of a slice of documents: words, each word's label probabilities, and whether a document has a letter."""
    words = Words(data, off)
    count = np.diff(words.first)
    fresh = np.zeros(len(words), bool)
    fresh[words.first[:-1][count > 0]] = True
    p = field.marginals(field.emissions(words, field.in_lists(words)), fresh) if len(words) and field.labels else np.zeros((len(words), len(field.labels)))
    letter = count > 0
    ascii_at = np.searchsorted(off, np.flatnonzero((_LETTER[data] > 0) & (data < 128)), side="right") - 1
    sure = np.zeros(len(count), bool)
    sure[ascii_at] = True
    letter[list(_letterless(data, off, np.flatnonzero(letter & ~sure)))] = False
    return words, p, letter


def _predicted(shared, text_at: int, keep: list[int], outputs: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(shared.value)
        names = np.array([*field.labels, UNKNOWN], object)
        for batch in batches:
            for i, j, data, off in parts(batch.column(text_at), SLICE):
                words, p, letter = labelled(field, data, off)
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
                mass = total[words.first[1:]] - total[words.first[:-1]]
                if mass.shape[1]:
                    best = mass.argmax(1)
                    score = mass.max(1) / np.maximum(np.diff(words.first), 1)
                else:
                    best, score, letter = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                best = np.where(letter, best, len(field.labels))
                score = np.clip(np.where(letter, score, 0.0), 0, 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keep), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], [*(batch.schema.names[k] for k in keep), *outputs])

    return run


def predict(docs: DataFrame, field: Field, columns: list[str], text_col: str = "text", outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The named columns of docs with language and score, one row for each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(field))
    keep = [c for c in columns if c not in outputs]
    inner = list(dict.fromkeys([*keep, text_col]))
    source = docs.select(*[docs[c] for c in inner])
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), f"`{outputs[0]}` string", f"`{outputs[1]}` double"])
    return source.mapInArrow(_predicted(shared, inner.index(text_col), [inner.index(c) for c in keep], outputs), schema)


def word_runs(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words with one language: id, first_word, words, lang."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(shared.value)
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in parts(batch.column(1), SLICE):
                words, p, _ = labelled(field, data, off)
                if not p.size:
                    continue
                best, doc = p.argmax(1), np.repeat(np.arange(j - i), np.diff(words.first))
                head = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
                size = np.diff(np.append(head, len(best)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[head] + i)), pa.array(head - words.first[doc[head]], pa.int64()), pa.array(size, pa.int64()), pa.array([field.labels[k] for k in best[head]], pa.string())], ["id", "first_word", "words", "lang"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, first_word long, words long, lang string")


#: A document is accepted with a language and at least this much of its words' mass on it.
LEAST_SCORE = 0.3


def accepted(docs: DataFrame, field: Field, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose language is known well enough."""
    found = predict(docs, field, docs.columns, text_col, ("__lang", "__mass"))
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__mass") >= least)).drop("__lang", "__mass")
