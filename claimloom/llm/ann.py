"""Approximate nearest neighbours by an inverted multi-index.

The vector's two halves are quantised separately, so that k centroids each make k*k cells.
Centroids are fitted on the driver to at most SAMPLE vectors, chosen by a hash of the id; every
vector is indexed. A query walks the pairs of centroids by summed squared distance, with a
heap, until the cells taken hold its share of candidates, and the cells' vectors are reranked
by exact Euclidean distance in double precision.

The share is learned: for PROBES vectors of the sample, the share of the sample that a walk must
take to reach each true neighbour is measured, and that which reaches RECALL of them is used, at
any size of the table. Clustered vectors need a few hundredths, nearly random ones in many
dimensions about half; neighbours in the whole table lie nearer than those in a sample, so the
share errs upwards.

Cells are cut into pieces of bounded count by a hash of the id, so that a cell that holds a
third of all vectors is spread over tasks; each piece gives a query its nearest few only.
Cell counts (k*k numbers, k at most 1024) and centroids are what reaches the driver.

Vectors that are null, empty, zero, hold a null or a non-finite component, or are not of the
commonest length take no part, as queries or candidates; nor do rows without an id. A row that
repeats an id counts once, at its nearest vector. Ties go to smaller ids. With fewer candidates
than wanted, all are returned; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import groups_for, written

SAMPLE, ROUNDS = 20_000, 12
MOST_CENTROIDS = 1024
#: Vectors a cell holds on average, and those in one piece of a cell.
CELL, PIECE = 2, 2048
#: Vectors in one Python group on average.
GROUP = 4096
#: Queries in one task of the walk.
WALKS = 32
#: Sampled vectors whose neighbours calibrate the share of candidates, and the recall aimed at on them.
PROBES, RECALL = 200, 0.96
#: Candidates a query takes at least, for each neighbour wanted.
LEAST = 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null").where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size(v) == (sizes["size"] if sizes else -1))


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means of x; an emptied centroid moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        d = _square(x, c)
        at = d.argmin(1)
        for j in range(len(c)):
            own = x[at == j]
            if len(own):
                c[j] = own.mean(0)
            else:
                far = int(d.min(1).argmax())
                c[j], d[far] = x[far], 0
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def walk(query: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells by summed distance to their two centroids, until they hold `want` vectors.

    The heap holds one pair for each row of the (sorted) distance grid that has been reached.
    """
    half = len(query) // 2
    a, b = _square(query[None, :half], left)[0], _square(query[None, half:], right)[0]
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, cells, have = [(a[by_a[0]] + b[by_b[0]], 0, 0)], [], 0
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        cell = int(by_a[i]) * len(right) + int(by_b[j])
        if counts[cell]:
            cells.append(cell)
            have += int(counts[cell])
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[0]], i + 1, 0))
        if j + 1 < len(right):
            heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))
    return cells


def calibrated(x: np.ndarray, left: np.ndarray, right: np.ndarray, top: int, recall: float = RECALL, probes: int = PROBES) -> float:
    """The share of a sample that walks take to reach `recall` of its vectors' true nearest."""
    n, half = len(x), x.shape[1] // 2
    if n < 3:
        return 1.0
    cell = _square(x[:, :half], left).argmin(1) * len(right) + _square(x[:, half:], right).argmin(1)
    cells, own, size = np.unique(cell, return_inverse=True, return_counts=True)
    need = []
    for q in np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int)):
        d = _square(x[q][None, :], x)[0]
        d[q] = np.inf
        near = np.argpartition(d, min(top, n - 1) - 1)[: min(top, n - 1)]
        a, b = _square(x[q][None, :half], left)[0], _square(x[q][None, half:], right)[0]
        order = np.argsort(a[cells // len(right)] + b[cells % len(right)], kind="stable")
        upto = np.empty(len(cells))
        upto[order] = np.cumsum(size[order])
        need.append(upto[own[near]] / n)
    return float(np.quantile(np.concatenate(need), recall))


def _nearest(top: int):
    """Of one group: the vectors' pieces of cells, and the queries that visit them."""

    def run(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if len(base) and len(asks):
            base = base.sort_values("key", kind="stable")
            vectors, ids, own = np.stack(base.vector.to_numpy()), base.id.to_numpy(), base.key.to_numpy()
            for q, vector, keys in zip(asks.query_id.to_numpy(), asks.vector, asks["keys"], strict=True):
                low, high = np.searchsorted(own, keys), np.searchsorted(own, keys, side="right")
                size = high - low
                upto = np.cumsum(size)
                at = np.repeat(low - upto + size, size) + np.arange(upto[-1])
                at = at[ids[at] != q]
                d = vectors[at] - vector
                score = np.sqrt((d * d).sum(1))
                order = np.lexsort((score, ids[at]))
                order = order[np.concatenate(([True], np.diff(ids[at[order]]) != 0))] if len(order) else order
                best = order[np.lexsort((ids[at[order]], score[order]))[:top]]
                out["query_id"].append(np.full(len(best), q))
                out["vec_id"].append(ids[at[best]])
                out["score"].append(score[best])
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return run


def search(vectors: DataFrame, queries: DataFrame, top: int = 10, share: float | None = None, least: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `top` nearest found of each query: query_id, rank, vec_id, score (the distance).

    share, least: candidates of a query; by default the learned share, and LEAST for each neighbour.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vector_col)
    total = base.count()
    spread = 1 << 30
    some = base.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(spread)) < int(spread * min(1.0, SAMPLE / max(total, 1)))).select("id", "vector").toArrow().sort_by("id")
    dim = len(some["vector"][0]) if len(some) else 0
    if dim == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(some["vector"], dim)[: SAMPLE]
    k = int(min(MOST_CENTROIDS, len(x), max(1, 2 ** round(np.log2(max(1, total / CELL)) / 2))))
    half = dim // 2
    left = centroids(x[:, :half], k, 1) if half else np.zeros((1, 0))
    right = centroids(x[:, half:], k, 2)
    books = spark.sparkContext.broadcast((left, right))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            cell = _square(v[:, :half], a).argmin(1) * len(b) + _square(v[:, half:], b).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], ["id", "vector", "cell"])

    index = written(base.mapInArrow(assign, "id long, vector array<double>, cell long"))
    counts = np.zeros(len(left) * len(right), np.int64)
    for cell, n in index.groupBy("cell").count().collect():
        counts[cell] = n
    held = spark.sparkContext.broadcast(counts)
    groups = groups_for(total, GROUP)
    share = calibrated(x, left, right, top) if share is None else share
    want = max(LEAST * top if least is None else least, int(np.ceil(share * total)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), n = books.value, held.value
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            for row, q in enumerate(v):
                cells = np.array(walk(q, a, b, n, want), np.int64)
                pieces = -(-n[cells] // PIECE)
                keys = np.repeat(cells << 20, pieces) + np.concatenate([np.arange(p) for p in pieces])
                to = keys % groups
                order = np.argsort(to, kind="stable")
                found, starts = np.unique(to[order], return_index=True)
                same = pa.array(np.full(len(found), row))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(keys[order]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), lists, pa.array(found, pa.int64())], ["query_id", "vector", "keys", "g"])

    cut = spark.createDataFrame([(int(c), int(-(-counts[c] // PIECE))) for c in np.flatnonzero(counts > PIECE)], "cell long, pieces long")
    piece = F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("pieces", F.lit(1)))
    pieces = index.join(F.broadcast(cut), "cell", "left").select("id", "vector", (F.shiftleft("cell", 20) + piece).alias("key")).withColumn("g", F.pmod("key", F.lit(groups)))
    # Few bytes and much work: dealt explicitly, so that adaptive execution doesn't put them into one task.
    asked = usable(queries, id_col, vector_col).where(F.size("vector") == dim)
    asked = asked.repartition(groups_for(asked.count(), WALKS), "id").dropDuplicates(["id"])
    asks = asked.mapInArrow(visits, "query_id long, vector array<double>, keys array<long>, g long")
    near = pieces.groupBy("g").cogroup(asks.groupBy("g")).applyInPandas(_nearest(top), "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
