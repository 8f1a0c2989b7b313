"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it
leaves fullest (best fit); when it fits none, the fullest window is emitted and an empty one
opened. What is still open at the partitions' ends is merged: leftovers are dealt, by a
hash, into groups of a bounded count and packed again whole, windows onto windows.

Nulls and empty texts are documents of the end mark alone. Documents longer than a window
are cut: full windows first, the rest is placed like any other piece. Copies are separate
documents. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import groups_for, written

WINDOW = 1024
OPEN_WINDOWS = 64
END_ID = 0
MERGE_GROUP = 4096
SPECIAL = {"<|endoftext|>": 50256}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, at long, fill long, open boolean"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Ids of whole texts under a byte-level BPE; a special token's string becomes its id."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.bpe.encode(text, allowed_special="all")
        return self.bpe.encode_ordinary(text)


class Windows:
    """A fixed number of open windows; places pieces best-fit."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, int]] = []  # (fill, window), sorted
        self.made = 0
        self.fills: dict[int, int] = {}

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset there)"""
        i = bisect.bisect_right(self.open, (self.size - length, 1 << 60)) - 1
        if i >= 0:
            fill, window = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                self.open.pop()  # the fullest
            fill, window, self.made = 0, self.made, self.made + 1
        self.fills[window] = fill + length
        if fill + length < self.size:
            bisect.insort(self.open, (fill + length, window))
        return window, fill


def _packed(vocabulary: str, pattern: str, special: dict[str, int], size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = Encoder(vocabulary, pattern, special), Windows(size, most)
        part = TaskContext.get().partitionId()
        held: list[list] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = np.array([*encoder(text.as_py() or ""), END_ID], "<u4")
                for start in range(0, len(doc), size):
                    piece = doc[start : start + size]
                    window, at = windows.place(len(piece))
                    held.append([doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(doc), part, window, at])
            # A window that is no longer open is full for good: its rows can go.
            still = {w for _, w in windows.open}
            done = [r for r in held if r[6] not in still]
            held = [r for r in held if r[6] in still]
            yield _rows(done, windows.fills, False)
            windows.fills = {w: f for w, f in windows.fills.items() if w in still}
        yield _rows(held, windows.fills, True)

    def _rows(rows: list[list], fills: dict[int, int], is_open: bool) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "at"]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([fills[r[6]] for r in rows], pa.int64()), pa.array([is_open] * len(rows), pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "fill", "open"])

    return run


def _merged(size: int):
    """Of one group of leftover windows: onto which sequence each goes, and where."""

    def run(pdf):
        pdf = pdf.sort_values(["fill", "part", "window"], ascending=[False, True, True], kind="stable")
        windows = Windows(size, len(pdf))
        heads, to, at = {}, [], []
        for fill, part, window in zip(pdf.fill.tolist(), pdf.part.tolist(), pdf.window.tolist(), strict=True):
            w, a = windows.place(fill)
            head = heads.setdefault(w, (part, window))
            to.append(head)
            at.append(a)
        out = pdf[["part", "window"]].copy()
        out["to_part"], out["to_window"] = [t[0] for t in to], [t[1] for t in to]
        out["base"] = at
        return out

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, special: dict[str, int] = SPECIAL, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    padded_length: the window, but a sequence whose length is a power of two stays so.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_packed(vocabulary, pattern, special, window, open_windows), PIECES))
    left = pieces.where("open").groupBy("part", "window").agg(F.max("fill").alias("fill"))
    groups = groups_for(left.count(), MERGE_GROUP)
    merged = left.withColumn("grp", F.pmod(F.xxhash64("part", "window"), F.lit(groups))).groupBy("grp").applyInPandas(_merged(window), "part long, window long, to_part long, to_window long, base long")
    placed = (
        pieces.where("open").join(merged, ["part", "window"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("to_part").alias("part"), F.col("to_window").alias("window"), (F.col("at") + F.col("base")).alias("at"))
    )
    total = placed.groupBy("part", "window").agg(F.sum("length").alias("fill"))
    both = pieces.where("not open").select(*placed.columns, "fill").unionByName(placed.join(total, ["part", "window"]).select(*placed.columns, "fill"))
    power = F.expr("(fill & (fill - 1)) = 0")
    return both.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("shiftleft(part, 32) + window").alias("sequence_id"), F.col("at").alias("offset"),
        F.when(power, F.col("fill")).otherwise(F.lit(window)).cast("long").alias("padded_length"),
    )
