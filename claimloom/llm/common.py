"""Helpers that the operators share: shared storage, word arrays, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- shared storage

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the session's JVM ends.

    A local folder is made only where the setting is absent and the master is local (tests); on a
    cluster, where executors couldn't share it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="claimloom-")
        _own[spark.sparkContext.applicationId] = base
    path = f"{base.rstrip('/')}/claimloom-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(rows: int, per_group: int) -> int:
    """How many groups keep about per_group rows in each."""
    return max(1, -(-int(rows) // per_group))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod modulus, is the remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: what a lambda merely refers to is made again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: A key with more than this share of all rows is a heavy one; so there are fewer than its inverse.
HEAVY = 1 / 256


def heavy_keys(counts: DataFrame, n_col: str = "n") -> DataFrame:
    """Of (keys, n): those that hold more than HEAVY of all rows, fewer than 1 / HEAVY of them."""
    total = counts.agg(F.coalesce(F.sum(n_col), F.lit(0))).first()[0]
    return counts.where(F.col(n_col) > int(total * HEAVY)).limit(int(1 / HEAVY))


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], n_col: str = "n") -> DataFrame:
    """rows left-joined with values, a written table of one row for each key, whatever share one key has.

    values counts in n_col how many rows have each key, and loses that column. Heavy keys, whose
    number is bounded, are broadcast. Their rows then take no part in the shuffled join of the
    others: they go to it under salts that nothing has.
    """
    named = [c for c in values.columns if c not in keys and c != n_col]
    values = values.withColumn("__v", F.struct(*named)).select(*keys, "__v", n_col)
    heavy = heavy_keys(values, n_col).select(*keys, F.col("__v").alias("__h"))
    salted = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.when(F.col("__h").isNull(), 0).otherwise(F.monotonically_increasing_id() + 1).cast("long"))
    joined = salted.join(values.select(*keys, "__v", F.lit(0).cast("long").alias("__salt")), [*keys, "__salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"__h.{c}"), F.col(f"__v.{c}")).alias(c) for c in named))


# ---------------------------------------------------------------- bytes and words

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return _mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x9E3779B9)) * _U(0x9E3779B97F4A7C15))


#: White space as the contracts name it: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = seeded(256, 7)
_BYTE_LOWER = _BYTE[LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = {"n": 0, "p": np.ones(0, _U), "i": np.ones(0, _U)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, mod 2**64."""
    if _powers["n"] < n:
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("i", _PINV)):
                steps = np.full(n, _U(base))
                steps[0] = 1
                _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["p"][:n], _powers["i"][:n]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes, at least one document each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(arr: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of each slice of a text column."""
    data, off = buffers(arr)
    for i, j in slices(off, most):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def spans(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, none across documents."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = keep[:-1]
    starts = np.flatnonzero(keep & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = keep[1:]
    ends = np.flatnonzero(keep & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    with np.errstate(over="ignore"):
        p, inv = _pow(len(data) + 1)
        run = np.zeros(len(data) + 1, _U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:-1], out=run[1:])
        return _mix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document as sorted 64-bit hashes, and their offsets.

    Words are runs of non-space bytes, A-Z lower-cased. Fewer words than the width make one
    shingle of the whole sequence; no word makes none.
    """
    starts, ends = spans(~SPACE[data], off)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, off)
    k = seeded(width, 11) | _U(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        run = np.zeros(n, _U)
        for j in range(width):
            run += words[j : j + n] * k[j]
        run = _mix(run)
    out, bounds = [], [0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            got = np.sort(run[a : b - width + 1])
            got = got[np.concatenate(([True], got[1:] != got[:-1]))]
        elif b > a:
            with np.errstate(over="ignore"):
                got = _mix((words[a:b] * k[: b - a]).sum(keepdims=True, dtype=_U) + _U(b - a))
        else:
            got = run[:0]
        out.append(got)
        bounds.append(bounds[-1] + len(got))
    return (np.concatenate(out) if out else run[:0]), np.array(bounds, np.int64)


# ---------------------------------------------------------------- components


def roots(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric boolean matrix: each row's smallest reachable row."""
    n = len(linked)
    label = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v), longs.

    Each round takes the smallest label of the neighbours and jumps to the label's own label,
    so that rounds grow with the logarithm of a path's length. Each round is a written table;
    only the count of changes reaches the driver.
    """
    both = written(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct().toDF("u", "v"))
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")))
    while True:
        own = labels.select("node", F.col("label").alias("was"), "label")
        near = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), F.lit(None).cast("long").alias("was"), "label")
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("to"))
        jump = labels.join(up, labels.label == up.low).select("node", F.lit(None).cast("long").alias("was"), F.col("to").alias("label"))
        new = written(own.union(near).union(jump).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        labels = new.select("node", "label")
        if not new.where("label < was").limit(1).count():
            return labels.withColumnRenamed("label", "component")
