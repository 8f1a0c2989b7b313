"""b-bit MinHash near-duplicate detection with exact confirmation.

1. Each document's distinct word shingles are hashed; the minima under 160 hash functions
   give 32 band keys of 5 minima each and a signature of the minima's lowest 2 bits, packed
   in 5 longs. Equal shingle sets are one item from here on (their smallest id stands for all).
2. Items that share a band key are candidates. Within a band's bucket, similarities are
   estimated from packed signatures by bit counts, corrected for chance collisions; the pairs
   at or above the threshold less four standard errors are joined to a spanning forest, whose
   components are the loose groups. Nothing is emitted per pair.
3. Within each loose group the full shingle sets are compared exactly, and the confirmed links
   again leave as a spanning forest. Its components are the result.

A bucket or loose group over one tile's count or bytes is first compared with its leader, its
smallest id: what links to the leader is one component and needs no comparing among itself, so
a group of near copies costs one comparison each. What is left is compared with the whole
group, in tiles of bounded count and bytes spread over tasks; only a large group whose members
are unlike its leader costs more than linear work. A pair at exactly 0.8 misses all bands with
probability (1 - 0.8^5)^32 = 3e-6 and the estimate's margin with about 5e-5 (kept bits are
taken from a multiplied minimum, so that they are independent from function to function).

Nulls, empty texts and texts of white space have an empty set: they link with nothing, not
even with each other. Fewer words than the shingle width make one shingle of the whole
sequence. Of rows that repeat an id, the one whose text sorts last counts (and stays, when
duplicates are dropped; among equal texts the one that sorts last by the other columns that
can be sorted). Rows whose id is null are left out. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from claimloom.llm.common import components, groups_for, parts, roots, seeded, shingle_sets, written

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BITS = 2
WORDS = HASHES * BITS // 64
PERCENT = 80
#: Items of a bucket in one tile's side; hashes of full sets in one tile's side.
TILE_ITEMS, TILE_HASHES = 512, 1 << 19
#: Rows, and hashes of full sets, that one Python group holds on average.
GROUP_ROWS, GROUP_HASHES = 1024, 1 << 18

SKETCH = "id long, n long, digest binary, bands array<long>, signature array<long>"


def _sketched(width: int):
    mul = (seeded(HASHES, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (seeded(HASHES, 22) >> np.uint64(32)).astype(np.uint32)
    spread = seeded(HASHES, 23) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in parts(batch.column(1)):
                sets, bounds = shingle_sets(data, off, width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                minima = np.zeros((HASHES, len(full)), np.uint32)
                with np.errstate(over="ignore"):
                    if len(full):
                        low = (sets >> np.uint64(32)).astype(np.uint32)
                        work = np.empty_like(low)
                        for k in range(HASHES):
                            np.multiply(low, mul[k], out=work)
                            np.add(work, add[k], out=work)
                            minima[k] = np.minimum.reduceat(work, bounds[full])
                    wide = (minima.astype(np.uint64) + np.uint64(1)) * spread[:, None]
                    keys = wide.reshape(BANDS, ROWS, len(full)).sum(1, dtype=np.uint64)
                    keys ^= keys >> np.uint64(29)
                    keys *= np.uint64(0xBF58476D1CE4E5B9)
                    packed = np.zeros((WORDS, len(full)), np.uint64)
                    for k in range(HASHES):
                        # The product's top bits: its lowest depend on the minimum's lowest alone, alike for all functions.
                        packed[k * BITS // 64] |= (wide[k] >> np.uint64(64 - BITS)) << np.uint64(k * BITS % 64)
                digests: list = [None] * (j - i)
                for d in full:
                    digests[d] = hashlib.blake2b(sets[bounds[d] : bounds[d + 1]].tobytes(), digest_size=16).digest()
                present = (n > 0).astype(np.int64)
                lists = lambda rows, w: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(present * w)]), pa.int32()), pa.array(np.ascontiguousarray(rows.T).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists(keys, BANDS), lists(packed, WORDS)], ["id", "n", "digest", "bands", "signature"])

    return run


def _forest(pdf: pd.DataFrame, values: list | np.ndarray, linked, pairs=None) -> pd.DataFrame:
    """Star edges (member, root) of the links within each tile.

    linked: values of a tile's rows -> matrix; pairs: values of left and right rows -> vector,
    for all the tiles of two rows at once.
    """
    ids = pdf.id.to_numpy()
    order = np.lexsort((ids, pdf.hi.to_numpy(), pdf.lo.to_numpy(), pdf.grp.to_numpy()))
    tile = pdf[["grp", "lo", "hi"]].to_numpy()[order]
    ids = ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (tile[1:] != tile[:-1]).any(1)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(ids))
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    two = (ends - starts == 2) if pairs else np.zeros(len(starts), bool)
    if two.any():
        a = starts[two]
        hit = a[pairs(values[order[a]], values[order[a + 1]])]
        u.append(ids[hit + 1])
        v.append(ids[hit])
    for a, b in zip(starts[~two], ends[~two], strict=True):
        if b - a > 1:
            root = roots(linked([values[i] for i in order[a:b]] if isinstance(values, list) else values[order[a:b]]))
            away = np.flatnonzero(root != np.arange(b - a))
            u.append(ids[a + away])
            v.append(ids[a + root[away]])
    return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}).drop_duplicates()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from packed signatures [..., WORDS] that broadcast against each other."""
    odd = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int64)
    for w in range(a.shape[-1]):
        x = a[..., w] ^ b[..., w]
        x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
        odd += np.bitwise_count(x)
    chance = 1 / (1 << BITS)
    return ((1 - odd / HASHES) - chance) / (1 - chance)


def _loose(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = np.stack(pdf.signature.to_numpy()).view(np.uint64)
        return _forest(pdf, packed, lambda s: estimated(s[:, None], s[None, :]) >= least, lambda x, y: estimated(x, y) >= least)

    return run


def overlaps(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairs' intersections; each set's hashes are distinct."""
    n = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), n)
    keep = shared[at]
    row, col = row[keep], rank[at[keep]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [low, low + columns])
        m = np.zeros((len(sets), min(columns, int(shared.sum()) - low)), np.float32)
        m[row[a:b], col[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _exact(percent: int):
    def linked(sets: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(s) for s in sets])
        both = overlaps(sets)
        return 100 * both >= percent * (n[:, None] + n[None, :] - both)

    return lambda pdf: _forest(pdf, [np.frombuffer(x, np.uint64) for x in pdf.shingles], linked)


def _full(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in parts(batch.column("text")):
                sets, bounds = shingle_sets(data, off, width)
                rows = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("grp").slice(i, j - i), batch.column("n").slice(i, j - i), pa.array(rows, pa.binary())], ["id", "grp", "n", "shingles"])

    return run


def _alike(a: Column, b: Column) -> Column:
    """estimated() of two signature columns."""
    odd = F.lit(0)
    for w in range(WORDS):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        odd = odd + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / (1 << BITS)
    return ((1 - odd / HASHES) - chance) / (1 - chance)


def _near_leader(percent: int):
    """Whether each set links to its group's leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("shingles"), batch.column("lead"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "leader", "grp", "n", "shingles")), pa.array(near, pa.bool_())], ["id", "leader", "grp", "n", "shingles", "near"])

    return run


def _crossed(compared: DataFrame, unit: Column, tile: int) -> DataFrame:
    """Tiles (lo, hi) of what its leader doesn't link against the whole group, for each group with such.

    compared: id, grp and near, each id once. Sides are cut by a hash so that each holds about `tile` units.
    """
    sizes = compared.groupBy("grp").agg(F.sum(unit).alias("all"), F.sum(F.when(~F.col("near"), unit)).alias("left")).where("left > 0")
    rows = compared.join(sizes, "grp").withColumn("a", F.ceil(F.col("left") / tile)).withColumn("b", F.ceil(F.col("all") / tile))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    one = rows.where("not near").withColumn("lo", own(F.col("a"), 5)).withColumn("hi", every("b"))
    other = rows.withColumn("hi", own(F.col("b"), 6)).withColumn("lo", every("a"))
    return one.unionByName(other).drop("a", "b", "all", "left", "near", "leader")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (it is its component's smallest id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.max("text").alias("text"))
    sketches = written(rows.mapInArrow(_sketched(width), SKETCH))
    items = written(sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))

    # Buckets of two items or more.
    keyed = items.select("id", F.posexplode("bands").alias("band", "key"))
    bucket = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keyed.join(bucket, ["band", "key"]).select("id", F.xxhash64("band", "key").alias("grp"), "size"))
    sigma = ((percent / 100 * 0.75 + 0.25) * (1 - percent / 100 * 0.75 - 0.25) / HASHES) ** 0.5 / 0.75
    least = percent / 100 - 4 * sigma
    signed = members.join(items.select("id", "signature"), "id")
    whole = lambda df: df.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(0).cast("long"))
    tiles, stars, total = whole(signed.where(F.col("size") <= TILE_ITEMS).drop("size")), [], members.count()
    if members.where(F.col("size") > TILE_ITEMS).limit(1).count():
        large = signed.where(F.col("size") > TILE_ITEMS)
        leaders = written(large.groupBy("grp").agg(F.min_by(F.struct("id", "signature"), "id").alias("lead")))
        compared = written(large.join(leaders, "grp").select("id", F.col("lead.id").alias("leader"), "signature", "grp", (_alike(F.col("signature"), F.col("lead.signature")) >= least).alias("near")))
        stars.append(compared.where("near and id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")))
        crossed = written(_crossed(compared, F.lit(1), TILE_ITEMS).select("id", "signature", "grp", "lo", "hi"))
        tiles, total = tiles.select("id", "signature", "grp", "lo", "hi").unionByName(crossed), total + crossed.count()
    dealt = lambda df, n: df.withColumn("g", F.pmod(F.xxhash64("grp", "lo", "hi"), F.lit(n))).groupBy("g")
    loose_edges = dealt(tiles.select("id", "signature", "grp", "lo", "hi"), groups_for(total, GROUP_ROWS)).applyInPandas(_loose(least), "u long, v long")
    for star in stars:
        loose_edges = loose_edges.unionByName(star)
    loose = components(loose_edges)

    # Full sets of the loose groups' items, compared exactly.
    grouped = loose.join(items.select(F.col("id").alias("node"), "n"), "node").select(F.col("node").alias("id"), F.col("component").alias("grp"), "n")
    sets = written(rows.join(grouped, "id").mapInArrow(_full(width), "id long, grp long, n long, shingles binary"))
    weight = written(sets.groupBy("grp").agg(F.sum("n").alias("hashes")))
    moved = weight.agg(F.sum("hashes").alias("t")).first()["t"] or 0
    weighed = sets.join(weight, "grp")
    tiles, stars = whole(weighed.where(F.col("hashes") <= TILE_HASHES)).select("id", "shingles", "grp", "lo", "hi"), []
    if weight.where(F.col("hashes") > TILE_HASHES).limit(1).count():
        # A group is its component's smallest id, so that is the leader.
        large = weighed.where(F.col("hashes") > TILE_HASHES)
        leaders = written(large.where("id = grp").select("grp", F.col("id").alias("leader"), F.col("shingles").alias("lead")))
        compared = large.join(leaders, "grp").select("id", "leader", "grp", "n", "shingles", "lead")
        compared = written(compared.mapInArrow(_near_leader(percent), "id long, leader long, grp long, n long, shingles binary, near boolean"))
        stars.append(compared.where("near and id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")))
        crossed = _crossed(compared, F.col("n"), TILE_HASHES)
        moved += crossed.agg(F.sum("n").alias("t")).first()["t"] or 0
        tiles = tiles.unionByName(crossed.select("id", "shingles", "grp", "lo", "hi"))
    edges = dealt(tiles, groups_for(moved, GROUP_HASHES)).applyInPandas(_exact(percent), "u long, v long")
    for star in stars:
        edges = edges.unionByName(star)
    found = components(edges)

    # By digest first: one row for each set, so that copies meet a unique key.
    classes = items.select("digest", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    ids = sketches.select("id", "n", "digest")
    out = ids.join(classes, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, but one document of each group; rows without an id stay.

    The width is five words here, as for all stages on word shingles that no contract fixes.
    """
    gone = written(near_duplicates(docs, width, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")))
    repeated = docs.groupBy(id_col).count().where((F.col("count") > 1) & F.col(id_col).isNotNull()).limit(1).count()
    kept = docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    if repeated:
        others = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name not in (id_col, text_col)]
        last = kept.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*docs.columns), F.struct(text_col, *others)).alias("__row")).select("__row.*")
        kept = kept.where(F.col(id_col).isNull()).unionByName(last)
    return kept
