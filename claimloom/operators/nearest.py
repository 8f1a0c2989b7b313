"""Exact best inner products of unit vectors: tiles of queries against tiles of vectors, each a matrix product in a task."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])

#: About how many rows a side of a tile has, and how many of its queries are compared at a time.
TILE, STRIPE = 4096, 512
#: More than a product's sum can differ by the order of its terms.
SLACK = 1e-9


def by_length(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) of a list column. Null vectors and those that hold nulls have no score and aren't told."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.values
    null = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
    starts, ends = np.asarray(lists.offsets)[:-1], np.asarray(lists.offsets)[1:]
    known = np.asarray(lists.is_valid()) & (null[ends] == null[starts])
    numbers = values.to_numpy(zero_copy_only=False)
    for n in np.unique((ends - starts)[known]):
        rows = np.flatnonzero(known & (ends - starts == n))
        v = numbers[starts[rows][:, None] + np.arange(n)].astype(float)
        with np.errstate(all="ignore"):
            yield int(n), rows, v / np.sqrt(summed(v, v))[:, None]


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last, as the SQL adds them."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, of the double's product, as the SQL rounds."""
    scaled = np.abs(x * 10.0**digits)
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x)


def best(queries: list, vectors: list, shape: tuple[int, int], k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best in a tile, ties to the smaller place. queries, vectors: of by_length.

    A matrix product finds what may be among them; that is added up in order, so that equal vectors score equally.
    Vectors without a direction score NaN, which is above all; what has no score comes last and scores -inf.
    """
    out = []
    units = {n: (rows, v) for n, rows, v in vectors}
    spare = SLACK + (0 if digits is None else 10.0**-digits)
    every = [(np.arange(shape[0]), None)] if not queries else [(rows[i : i + STRIPE], (n, q[i : i + STRIPE])) for n, rows, q in queries for i in range(0, len(rows), STRIPE)]
    alone = np.setdiff1d(np.arange(shape[0]), np.concatenate([r for _, r, _ in queries])) if queries else np.arange(0)
    every += [(alone[i : i + STRIPE], None) for i in range(0, len(alone), STRIPE)]
    for mine, asked in every:
        near = np.full((len(mine), shape[1]), -np.inf)
        there, v = units.get(asked[0], (None, None)) if asked else (None, None)
        if v is not None:
            with np.errstate(all="ignore"):
                s = asked[1] @ v.T
            s[np.isnan(s)] = np.inf
            near[:, there] = s
        least = np.partition(near, -k, axis=1)[:, -k] if shape[1] > k else np.full(len(mine), -np.inf)
        left, right = np.nonzero(near >= (least - spare)[:, None])
        score = near[left, right]
        finite = np.flatnonzero(np.isfinite(score))
        if len(finite):
            at = np.full(shape[1], -1)
            at[there] = np.arange(len(there))
            for i in range(0, len(finite), 1 << 16):
                part = finite[i : i + (1 << 16)]
                exact = summed(asked[1][left[part]], v[at[right[part]]])
                score[part] = exact if digits is None else rounded(exact, digits)
        order = np.lexsort((right, -score, left))
        left, right, score = left[order], right[order], score[order]
        place = np.arange(len(left)) - np.searchsorted(left, left)
        first = place < k
        out.append((mine[left[first]], right[first], score[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def tile_best(queries: pa.Table, vectors: pa.Table, k: int, digits: int | None, names: list[str]) -> pa.Table:
    """A tile's rows: the group's columns of the query, query_id, the vector's id, score (null where there is none)."""
    vectors = vectors.sort_by(names[-1])
    i, j, score = best(list(by_length(queries["vector"])), list(by_length(vectors["vector"])), (len(queries), len(vectors)), k, digits) if len(queries) and len(vectors) else (np.arange(0), np.arange(0), np.zeros(0))
    told = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
    return pa.table([*(queries[c].take(pa.array(i)) for c in names[:-1]), vectors[names[-1]].take(pa.array(j)), told], names=[*names, "score"])


def scored(queries: DataFrame, vectors: DataFrame, k: int, doc: str, by: tuple[str, ...] = (), digits: int | None = None, tile: int = TILE) -> DataFrame:
    """(by, query_id, doc, score): each query's k best of every tile that it meets; the best of all are among them.

    Rows meet where `by` is equal. Each side of such a group is dealt to tiles of bounded count, and
    every pair of tiles is one group of a shuffle, whatever a group's size. digits rounds the scores, so that
    ties are told by doc.
    """
    counts = lambda df, n: df.groupBy(*by).agg(F.ceil(F.count("*") / tile).alias(n))
    a, b = counts(queries, "__a"), counts(vectors, "__b")
    tiles = a.join(b, list(by)) if by else a.crossJoin(b)
    dealt = lambda df, own, n, m: (df.join(tiles, list(by)) if by else df.crossJoin(F.broadcast(tiles))).withColumn(f"{n}t", F.pmod(F.xxhash64(own), F.col(n))).withColumn(f"{m}t", F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))).select(*(F.col(c).alias(c) for c in (*by, "__at", "__bt", own, "vector")))
    q, v = dealt(queries, "query_id", "__a", "__b"), dealt(vectors, doc, "__b", "__a")
    names = [*by, "query_id", doc]
    types = dict(queries.dtypes) | {doc: dict(vectors.dtypes)[doc]}
    keys = [*by, "__at", "__bt"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(lambda x, y: tile_best(x, y, k, digits, names), ", ".join(f"`{c}` {types[c]}" for c in names) + ", score double")
