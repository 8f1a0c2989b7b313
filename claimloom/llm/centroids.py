"""Exact k-means on integer vectors with ns-bounds.

Lloyd's rounds, but a vector is compared with a centroid only where its bounds can't tell.
Every vector keeps its cluster, an upper bound of the distance to that cluster's centroid, and
for each of GROUPS groups of centroids a lower bound of the distance to the nearest of them that
isn't its own, each with the round in which it was last worked out exactly. The history of all
centroids is retained. A bound of round t is loosened in round r by the distance between where
a centroid is in r and where it was in t: the norm of the sum of its moves, which is never more
than the sum of their norms. A group whose lower bound no longer lies above the upper bound is
scanned again, in whole numbers, so clusters and distances are exact; equal distances go to the
smaller number.

The vectors with their bounds are a written table, rewritten each round by tasks that read it
in Arrow batches; the history (rounds * k * 64 numbers) is all that is shipped to them. Sums are
taken by Spark over whole numbers with map-side combine: k rows reach the driver a round.

Vectors that don't have exactly DIMS components, or with null or non-finite ones, take no part;
nor do those with a component of 2**27 or more after scaling, whose distances a long couldn't
hold. Fewer vectors than k make fewer clusters, no vectors no rows. Repeated rows each get a row
and count each. A vector without an id is clustered but never a start, unless ids are too few;
ties of equal ids among the starts go to the smaller vector. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import written

K, DIMS, ROUNDS, SEED, SCALE = 40, 64, 5, 2, 256
#: Groups of centroids that share a lower bound.
GROUPS = 8
LARGEST = 1 << 27
#: Below this all sums of squares are whole in a double.
SMALL = 1 << 22
#: Bounds are compared with this relative margin, so that rounding never hides a tie.
MARGIN = 1e-9

STATE = "vec_id long, x array<int>, cluster int, distance long, upper double, upper_at byte, lower array<double>, lower_at array<byte>, scanned int"


def whole(vector: Column) -> Column:
    """floor(SCALE * component) of each component as an int; null where the vector takes no part."""
    scaled = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE))
    fits = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < LARGEST / SCALE), F.lit(False)))
    return F.when((F.size(vector) == DIMS) & fits, scaled.cast("array<int>"))


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("x")).where("x is not null")


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: the k vectors whose ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.withColumn("__hash", order).orderBy(F.col("__hash").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(-1, DIMS)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < SMALL else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def group_of(k: int) -> list[np.ndarray]:
    """Centroid numbers of each group."""
    return [g for g in np.array_split(np.arange(k), min(GROUPS, k)) if len(g)]


def moved(history: np.ndarray) -> np.ndarray:
    """[t, j]: how far centroid j is now from where it was in round t."""
    return np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(2)) * (1 + MARGIN)


def assigned(x: np.ndarray, state: dict[str, np.ndarray] | None, history: np.ndarray) -> dict[str, np.ndarray]:
    """The state of a batch of vectors in the history's last round."""
    n, now, c = len(x), len(history) - 1, history[-1]
    groups = group_of(len(c))
    if state is None:
        own, old = np.full(n, -1), None
        lower, lower_at = np.zeros((n, len(groups))), np.zeros((n, len(groups)), np.int8)
        upper, upper_at, exact = np.full(n, np.inf), np.zeros(n, np.int8), np.full(n, np.iinfo(np.int64).max)
        fails = np.ones((n, len(groups)), bool)
    else:
        own, old = state["cluster"].copy(), state["cluster"]
        lower, lower_at, upper, upper_at = (state[k].copy() for k in ("lower", "lower_at", "upper", "upper_at"))
        far = moved(history)
        most = np.stack([far[:, g].max(1) for g in groups], 1)  # [t, group]
        held = lower - most[lower_at, np.arange(len(groups))]
        loose = upper + far[upper_at, own]
        doubt = (held <= loose[:, None] * (1 + MARGIN)).any(1)
        # The distance to the own centroid is part of the result, so it is always worked out.
        exact = squared_own(x, c[own])
        tight = np.sqrt(exact.astype(np.float64))
        upper, upper_at = np.where(doubt, tight, upper), np.where(doubt, now, upper_at).astype(np.int8)
        fails = doubt[:, None] & (held <= tight[:, None] * (1 + MARGIN))
    scanned = np.zeros(n, np.int32)
    best, best_d = own.copy(), exact.copy()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g, members in enumerate(groups):
        rows = np.flatnonzero(fails[:, g])
        if len(rows):
            d = squared(x[rows], c[members])
            found[g] = rows, d
            scanned[rows] += len(members)
            near = d.argmin(1)
            low = d[np.arange(len(rows)), near]
            better = (low < best_d[rows]) | (low == best_d[rows]) & (members[near] < best[rows])
            best[rows[better]], best_d[rows[better]] = members[near[better]], low[better]
    for g, (rows, d) in found.items():
        others = np.where(groups[g][None, :] == best[rows][:, None], np.iinfo(np.int64).max, d).min(1)
        lower[rows, g] = np.sqrt(others.astype(np.float64)) * (1 - MARGIN)
        lower_at[rows, g] = now
    if old is not None:
        # The centroid that was left is now one of its group's others.
        left = np.flatnonzero(best != old)
        where = np.array([g for g, members in enumerate(groups) for _ in members])[old[left]]
        unseen = ~fails[left, where]
        low = np.sqrt(exact[left].astype(np.float64)) * (1 - MARGIN)
        rows, g = left[unseen], where[unseen]
        held_now = (lower - most[lower_at, np.arange(len(groups))])[rows, g]
        lower[rows, g], lower_at[rows, g] = np.minimum(low[unseen], held_now), now
    new = best != own if state is not None else np.ones(n, bool)
    upper = np.where(new, np.sqrt(best_d.astype(np.float64)) * (1 + MARGIN), upper)
    return {"cluster": best, "distance": best_d, "upper": upper, "upper_at": np.where(new, now, upper_at).astype(np.int8), "lower": lower, "lower_at": lower_at, "scanned": scanned}


def squared_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c."""
    return ((x - c) ** 2).sum(1)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """An array column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def bounded(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """The table of the last round, or bare vectors, with the state of the history's last round."""
    first = "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            state = None
            if not first:
                state = {k: col(k).to_numpy(zero_copy_only=False) for k in ("cluster", "upper", "upper_at")} | {"lower": _matrix(col("lower"), np.float64), "lower_at": _matrix(col("lower_at"), np.int8)}
                state["cluster"] = state["cluster"].astype(np.int64)
            s = assigned(_matrix(col("x"), np.int64), state, history)
            yield pa.RecordBatch.from_arrays(
                [
                    col("vec_id"), col("x"), pa.array(s["cluster"], pa.int32()), pa.array(s["distance"], pa.int64()), pa.array(s["upper"], pa.float64()), pa.array(s["upper_at"], pa.int8()),
                    _lists(s["lower"], pa.float64()), _lists(s["lower_at"], pa.int8()), pa.array(s["scanned"], pa.int32()),
                ],
                names=["vec_id", "x", "cluster", "distance", "upper", "upper_at", "lower", "lower_at", "scanned"],
            )

    return rows.mapInArrow(run, STATE)


def means(rows: DataFrame, was: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor(sum / count) of its vectors; an empty one stays."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("x", F.lit(i)).cast("long")) for i in range(DIMS))).alias("total")).collect()
    now = was.copy()
    for r in sums:
        now[r["cluster"]] = [t // r["n"] for t in r["total"]]
    return now


def history_of(rows: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Centroids of every round, and the vectors assigned to the last of them."""
    history = first[None]
    for _ in range(rounds):
        rows = written(bounded(rows, history))
        history = np.concatenate([history, means(rows, history[-1])[None]])
    return history, written(bounded(rows, history))


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """A row for each vector: its cluster, exact squared distance, inertia of cluster and all, the centroid's digest."""
    spark = table.sparkSession
    rows = vectors(table, id_col, vector_col)
    first = starts(rows, k, seed)
    if not len(first):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned int"
        return spark.createDataFrame([], none)
    history, last = history_of(rows, first, rounds)
    # One row a cluster, k at most: a bounded broadcast.
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1].tolist())]
    inertia = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), h) for j, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.select("vec_id", "cluster", "distance", "scanned").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
