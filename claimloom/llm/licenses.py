"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Texts are cut into sentences and into blocks of lines without an empty line between, and the
whole text is a segment too. Each segment's TF-IDF vector over the templates' vocabulary is
compared with every template; words outside the vocabulary only lengthen the segment's vector,
at the weight of the rarest word. Document frequencies of the vocabulary are counted over all
texts; its size is the templates', not the corpus's.

A file whose best segment reaches LEAST has that licence; among equal cosines the segment of most
words counts. Where templates of another licence come within MARGIN of the best, the words that
only one of the two has (a version's number, say) decide; if they don't, the licence is null and
the candidates are named. A negation (NEGATIONS) that a short notice lacks makes it no match
("not released under ..."). A file that is a licence file (by name, or its whole text reaches
LEAST) licenses its directory. Files without a licence of
their own inherit from their nearest licensed ancestor directory: the distinct directories'
ancestors are joined with the licensed directories, the deepest wins, and files join their
directory.

Nulls and empty texts have no segments; null paths are files of the root directory. Equal
scores go to the licence id that sorts first. Repeated rows each get a row. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import parts, span_hashes, spans, written
from claimloom.llm.license_texts import TEMPLATES

LEAST = 0.65
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"

#: Templates this close to the best are told apart by the words that only one of them has.
MARGIN = 0.03
#: Words that turn a notice of at most SHORT words into its opposite (fixed values).
NEGATIONS, SHORT = ("not", "never", "no", "neither", "cannot", "isn", "aren", "wasn", "without"), 20

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Segments:
    """Word hashes of a slice of documents."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.n, self.off, self.data = len(off) - 1, off, data
        self.starts, ends = spans(_TOKEN[data], off)
        self.words = span_hashes(data, self.starts, ends)
        self.doc = np.searchsorted(off, self.starts, side="right") - 1

    def numbered(self, level: int) -> np.ndarray:
        """Each word's segment: of sentences (0), blocks of lines (1) or documents (2)."""
        if level == 2 or not len(self.data):
            return self.doc
        line = self.data == 10
        ends = np.zeros(len(self.data), bool)
        if level == 0:
            ends |= line
            ends[1:] |= _STOP[self.data[:-1]] & (self.data[1:] == 32)
        else:
            ends[1:] |= line[1:] & line[:-1]
        ends[self.off[:-1][self.off[:-1] < len(ends)]] = True
        return np.cumsum(ends)[self.starts]


def vocabulary(templates=TEMPLATES) -> dict:
    """Word hashes of all templates, sorted, and each template's counts of them."""
    raw = [t.encode() for _, t in templates]
    seen = Segments(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    words, at = np.unique(seen.words, return_inverse=True)
    counts = np.zeros((len(raw), len(words)))
    np.add.at(counts, (seen.doc, at), 1)
    says_no = np.zeros(len(words), bool)
    says_no[_found(words, _hashes(NEGATIONS))] = True
    plain = (counts.sum(1) <= SHORT) & ~(counts[:, says_no].sum(1) > 0)
    return {"words": words, "counts": counts, "names": [name for name, _ in templates], "plain": plain}


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]))


def _found(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of those words that are known."""
    at = _known(words, known)
    return at[at >= 0]


def _known(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each word's place in the vocabulary, -1 outside it."""
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    return np.where(known[at] == words, at, -1)


def frequencies(files: DataFrame, vocab: dict, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Count of all texts, and of those that hold each vocabulary word."""
    known = vocab["words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for i, j, data, off in parts(batch.column(0)):
                seen = Segments(data, off)
                at = _known(seen.words, known)
                pairs = np.unique(seen.doc[at >= 0] * np.int64(len(known)) + at[at >= 0])
                df += np.bincount(pairs % len(known), minlength=len(known))
                total += j - i
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(known))], pa.int64()), pa.array([total, *df.tolist()], pa.int64())], ["word", "n"])

    got = {r["word"]: r["n"] for r in files.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(known))])


def weights(vocab: dict, total: int, df: np.ndarray) -> dict:
    """Inverse document frequencies and the templates' unit vectors."""
    idf = np.log((1 + total) / (1 + df)) + 1
    vectors = vocab["counts"] * idf
    return vocab | {"idf": idf, "rarest": float(np.log(1 + total) + 1), "vectors": vectors / np.linalg.norm(vectors, axis=1, keepdims=True)}


def _told_apart(seen: set[int], a: int, b: int, counts: np.ndarray) -> int:
    """Which of two templates a segment's vocabulary words speak for: by the share that it has of the words only one has; -1 if neither."""
    only = [set(np.flatnonzero((counts[x] > 0) & (counts[y] == 0)).tolist()) for x, y in ((a, b), (b, a))]
    part = [len(seen & words) / len(words) if words else 0.5 for words in only]
    return a if part[0] > part[1] else b if part[1] > part[0] else -1


def best(seen: Segments, model: dict, levels=(0, 1, 2)) -> tuple[np.ndarray, list, np.ndarray]:
    """Each document's highest cosine, the licences it stands for (several where they can't be told apart), and the cosine of its whole text."""
    score, words, which, whole = np.zeros(seen.n), np.zeros(seen.n), [[] for _ in range(seen.n)], np.zeros(seen.n)
    at = _known(seen.words, model["words"])
    inside = at >= 0
    if not inside.any():
        return score, which, whole
    size, idf, names = len(model["words"]), model["idf"], model["names"]
    others = np.array([[x != y for y in names] for x in names])
    no = np.isin(seen.words, _hashes(NEGATIONS))
    for level in levels:
        segment = seen.numbered(level)
        last = segment.max() + 1
        outside = np.bincount(segment[~inside], minlength=last) * model["rarest"] ** 2
        length, denied = np.bincount(segment, minlength=last), np.bincount(segment[no], minlength=last) > 0
        pairs, times = np.unique(segment[inside] * np.int64(size) + at[inside], return_counts=True)
        row, col = pairs // size, pairs % size
        value = times * idf[col]
        own = np.bincount(row, value * value, len(outside))
        # A cosine is at most the share of the vocabulary's words in the segment's length.
        may = own >= LEAST**2 * (own + outside)
        keep = may[row]
        row, col, value = row[keep], col[keep], value[keep]
        if not len(row):
            continue
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        dot = np.zeros((len(heads), len(names)))
        for a in range(0, len(heads), 1024):  # bounded memory: so many segments at a time
            b = min(a + 1024, len(heads))
            x, y = heads[a], heads[b] if b < len(heads) else len(row)
            dot[a:b] = np.add.reduceat(model["vectors"][:, col[x:y]].T * value[x:y, None], heads[a:b] - x, 0)
        rows = row[heads]
        cosine = np.minimum(dot / np.sqrt(own[rows] + outside[rows])[:, None], 1.0)
        cosine[np.ix_(denied[rows], model["plain"])] = 0
        first = np.full(len(outside), -1)
        first[segment[::-1]] = seen.doc[::-1]
        for k, (d, c) in enumerate(zip(first[rows], cosine.max(1), strict=True)):
            if level == 2:
                whole[d] = c
            if c < LEAST or (round(c, 9), length[rows[k]]) <= (round(score[d], 9), words[d]):
                continue
            t = int(cosine[k].argmax())
            held = set(col[heads[k] : heads[k + 1] if k + 1 < len(heads) else len(col)].tolist())
            close = np.flatnonzero((cosine[k] >= c - MARGIN) & others[t])
            for rival in close[np.argsort(-cosine[k][close], kind="stable")]:
                winner = _told_apart(held, t, int(rival), model["counts"])
                t = t if winner < 0 else winner
            open_ = {names[r] for r in close if names[r] != names[t] and _told_apart(held, t, int(r), model["counts"]) < 0}
            score[d], words[d], which[d] = c, length[rows[k]], sorted({names[t], *open_})
    return score, which, whole


def detected(files: DataFrame, columns: list[str], templates=TEMPLATES, text_col: str = "text") -> DataFrame:
    """The named columns with license (null under LEAST, or where several can't be told apart), candidates (those, joined by OR), cosine and whole (the whole text's cosine)."""
    templates = tuple(sorted(templates))
    vocab = vocabulary(templates)
    model = weights(vocab, *frequencies(files, vocab, text_col))
    shared = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in parts(batch.column(0)):
                score, which, whole = best(Segments(data, off), shared.value)
                found = [w[0] if len(w) == 1 else None for w in which]
                doubt = [" OR ".join(w) if len(w) > 1 else None for w in which]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(i, j - i) for k in range(len(columns))), pa.array(found, pa.string()), pa.array(doubt, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.float64())], [*columns, "license", "candidates", "cosine", "whole"])

    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns), "license string, candidates string, cosine double, whole double"])
    return files.select(files[text_col].alias("__text"), *[files[c] for c in columns]).mapInArrow(run, schema)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per file: id, path, license, candidates, cosine, evidence (own, inherited or null), from_dir."""
    path = F.coalesce(F.col(path_col), F.lit(""))
    own = detected(files, [id_col, path_col], templates, text_col).withColumn("dir", F.regexp_replace(path, r"/?[^/]*$", ""))
    own = written(own)
    licensing = own.where(F.col("license").isNotNull() & (F.coalesce(F.col(path_col), F.lit("")).rlike(LICENSE_NAME) | (F.col("whole") >= LEAST)))
    licensed = licensing.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("whole"), F.col("license"))).alias("dir_license")).withColumnRenamed("dir", "above")
    # Ancestors of the distinct directories, itself first: a/b, a, and the root.
    steps = F.split("dir", "/")
    dirs = own.select("dir").distinct()
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))).alias("above")).distinct()
    nearest = above.join(licensed, "above").groupBy("dir").agg(F.max_by(F.struct("dir_license", "above"), F.length("above")).alias("near"))
    found = own.join(nearest, "dir", "left")
    return found.select(
        id_col, path_col, F.when(F.col("candidates").isNull(), F.coalesce("license", "near.dir_license")).alias("license"), "candidates", "cosine",
        F.when(F.coalesce("license", "candidates").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("evidence"),
        F.when(F.coalesce("license", "candidates").isNull(), F.col("near.above")).alias("from_dir"),
    )
