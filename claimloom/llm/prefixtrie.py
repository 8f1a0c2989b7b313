"""Prefix trie of conversations, made of ternary search trees over range shards.

Turns, (role, text), are dictionary-encoded in order, so that a conversation is a sequence of
ids. Sequences are cut into bands of BAND turns; a band is known by the hash of all turns
before it, and equal bands of many conversations become one row with a count. These rows are
dealt by range of (band, hash, ids) and sorted; each run of SHARD of them is a shard. In a shard
the rows of one band root are put into a ternary search tree, the median first, then the
medians of both halves, so that the tree is balanced; a tree of what follows hangs below each of
its nodes. Iterative traversals then give each trie node its members, smallest member,
children, leaves and saved tokens.

What lies on the paths of a shard's first and last row may go on in the next shard: these
boundary nodes, at most 2 * BAND a shard and root, are merged by key and their own share is
added to those above them. All other nodes are complete within their shard. A band's totals are
then added to the nodes above its root, from the deepest band up; bands whose root has one
member aren't put into trees, as each of their nodes has one member, one leaf and nothing saved.
So rounds are as many as the bands that two conversations share from their start on.

No task gathers a conversation or the members of a node: turns are numbered within range parts,
plus what earlier parts hold of the same conversation; the members that end at a node are
joined to text in chunks by range of id, and hashed as a stream of chunks. (A digest of one
list is sequential by definition, so one task reads the chunks of a node.)

Null roles and texts are empty, null turns come first; turns of one number go by role, then
text. Rows that repeat a turn stay. Rows without a conversation id take no part. A conversation
without turns (all of its own are among those that it drops) ends at the root. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import groups_for, looked_up, written

BAND = 256
SHARD = 4096
#: A conversation begins with turns of the one whose id is the multiple of EVERY below it.
EVERY, MOST = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()

#: Where conversations without turns end.
ROOT_END = "root"
NODE = "key string, band long, parent string, end_key string, depth long, low long, parent_low long, words long, n long, kids long, leaves long, saved long, more boolean, edge boolean, above array<string>"


def words_of(text: Column) -> Column:
    """How many runs of other characters than space and 0x09 to 0x0D a text has."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def encoded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, turn, tid) of (conv, turn, role, text), and the dictionary: tid in the order of (role, text), words."""
    counts = rows.groupBy("role", "text").agg(F.count("*").alias("n"))
    # Ids rise with the range parts and within them.
    book = written(counts.repartitionByRange("role", "text").sortWithinPartitions("role", "text").withColumn("tid", F.monotonically_increasing_id()))
    book = book.withColumn("words", words_of(F.col("text")))
    return looked_up(rows, book.select("role", "text", "n", "tid", "words"), ["role", "text"]).drop("role", "text"), book


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds pos, from 0: the place of each row among those of its key, however many they are."""
    parts = groups_for(rows.count(), 100_000)
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(max(parts, 8), key, *order, "__tie").withColumn("__part", F.spark_partition_id())
    dealt = written(dealt)
    local = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part", key).orderBy(*order, "__tie")) - 1)
    sizes = dealt.groupBy("__part", key).agg(F.count("*").alias("__n"))
    # A part's first key alone goes on from the part before: one row a part.
    many = sizes.groupBy(key).agg(F.count("*").alias("__parts")).where(F.col("__parts") > 1).select(key)
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.join(many, key).withColumn("__before", before).where(F.col("__before") > 0).select("__part", key, "__before")
    joined = local.join(F.broadcast(carried), ["__part", key], "left")
    return joined.withColumn("pos", (F.col("__at") + F.coalesce("__before", F.lit(0))).cast("long")).select(*rows.columns, "pos")


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % MOST).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth from 1, tid, words) of the rebuilt conversations, and (conv, base, h) of all."""
    convs = written(turns.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % EVERY).withColumn("h", shared_turns(F.col("conv"))))
    heads = turns.where((F.col("conv") % EVERY == 0) & (F.col("pos") < MOST - 1)).select(F.col("conv").alias("base"), "pos", "tid", "words")
    first = convs.join(heads, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "tid", "words")
    had = heads.groupBy("base").agg(F.count("*").alias("had"))
    shift = convs.join(had, "base", "left").select("conv", "h", F.least("h", F.coalesce("had", F.lit(0))).alias("got"))
    shift = written(shift.join(turns.groupBy("conv").agg(F.count("*").alias("n")), "conv"))
    own = looked_up(turns, shift, ["conv"]).where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("got") + 1).alias("depth"), "tid", "words")
    return first.unionByName(own), convs


def _hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def banded(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each band of each conversation: ids and words, root (the hash of all before), own end key, more.

    A conversation without turns has one empty band at the root.
    """
    band = F.floor((F.col("depth") - 1) / BAND)
    listed = F.array_sort(F.collect_list(F.struct("depth", "tid", "words")))
    rows = turns.groupBy("conv", band.alias("band")).agg(listed.alias("t"))
    rows = rows.select("conv", "band", F.transform("t", lambda x: x["tid"]).alias("ids"), F.transform("t", lambda x: x["words"]).alias("words"))
    none = convs.join(turns.select("conv").distinct(), "conv", "left_anti").select("conv", F.lit(0).cast("long").alias("band"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<bigint>").alias("words"))
    rows = rows.unionByName(none)
    before = Window.partitionBy("conv").orderBy("band")
    part = lambda seed: F.xxhash64(F.lit(seed), "band", "ids")
    so_far = lambda seed, end: F.bit_xor(part(seed)).over(before.rowsBetween(Window.unboundedPreceding, end))
    return rows.select(
        "conv", "band", "ids", "words", F.when(F.col("band") == 0, "").otherwise(F.concat(*(_hex(so_far(s, -1)) for s in (1, 2)))).alias("root"),
        F.when(F.size("ids") > 0, F.concat(*(_hex(so_far(s, 0)) for s in (1, 2)))).otherwise(ROOT_END).alias("end_key"), F.lead("band").over(before).isNotNull().alias("more"),
    )


# ---------------------------------------------------------------- a shard


class Tree:
    """The trie of one band root's sorted sequences: a ternary search tree of ids below each node.

    Node 0 is the root. first[v]: the search tree of v's children, whose nodes are trie nodes with
    an id, a lower and a higher one beside them.
    """

    def __init__(self) -> None:
        self.id, self.first, self.lower, self.higher, self.up = [0], [-1], [-1], [-1], [-1]
        self.words, self.n, self.low, self.ends, self.more = [0], [0], [None], [""], [False]

    def _node(self, up: int, tid: int, words: int) -> int:
        for column, value in ((self.id, tid), (self.first, -1), (self.lower, -1), (self.higher, -1), (self.up, up), (self.words, words), (self.n, 0), (self.low, None), (self.ends, ""), (self.more, False)):
            column.append(value)
        return len(self.id) - 1

    def insert(self, ids: list[int], words: list[int], n: int, low: int, end_key: str, more: bool) -> int:
        """The node where the sequence ends; n members and their smallest are put there."""
        v = 0
        for tid, w in zip(ids, words, strict=True):
            at, way, of = self.first[v], self.first, v
            while at >= 0 and self.id[at] != tid:
                way, of = (self.lower, at) if tid < self.id[at] else (self.higher, at)
                at = way[at]
            if at < 0:
                at = self._node(v, tid, w)
                way[of] = at
            v = at
        self.n[v] += n
        self.low[v] = low if self.low[v] is None else min(self.low[v], low)
        self.ends[v] = end_key
        self.more[v] = self.more[v] or more
        return v

    def order(self) -> list[int]:
        """All nodes, each after the one above it, by a stack."""
        out, stack = [], [0]
        while stack:
            v = stack.pop()
            out.append(v)
            kids = [self.first[v]]
            while kids:
                at = kids.pop()
                if at >= 0:
                    stack.append(at)
                    kids += (self.lower[at], self.higher[at])
        return out


def medians(n: int) -> Iterator[int]:
    """0..n-1, the median first, then those of both halves and so on."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += ((m + 1, b), (a, m))


def shard(band: int, root: str, rows: list[dict], first: bool, last: bool) -> list[tuple]:
    """NODE rows of a band root's sorted rows. first, last: whether others may come before, after them."""
    tree = Tree()
    where = {}
    for i in medians(len(rows)):
        r = rows[i]
        where[i] = tree.insert(r["ids"], r["words"], r["n"], r["low"], r["end_key"], r["more"])
    edge = {0}
    for i, open_ in ((0, first), (len(rows) - 1, last)):
        v = where[i]
        while open_ and v >= 0:
            edge.add(v)
            v = tree.up[v]
    order = tree.order()
    size = len(tree.id)
    n, low, kids, leaves, saved, depth = list(tree.n), list(tree.low), [0] * size, [0] * size, [0] * size, [0] * size
    for v in reversed(order):
        up = tree.up[v]
        own = v not in edge
        if own and not tree.more[v]:
            leaves[v] += not kids[v]
        elif own and n[v] == 1:
            # What follows in the next band has one member: one child, one leaf, nothing saved.
            kids[v] += 1
            leaves[v] += 1
        if own:
            saved[v] += (n[v] - 1) * tree.words[v]
        if up >= 0:
            n[up] += n[v]
            low[up] = low[v] if low[up] is None else min(low[up], low[v])
            kids[up] += own
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    key, hashes = [root] * size, [None] * size
    hashes[0] = hashlib.sha256(f"{band}:{root}".encode())
    for v in order[1:]:
        up = tree.up[v]
        depth[v] = depth[up] + 1
        h = hashes[up].copy()
        h.update(f",{tree.id[v]}".encode())
        # The last node of a full band is the next band's root, and known by that one's hash.
        hashes[v], key[v] = h, tree.ends[v] if depth[v] == BAND else h.hexdigest()[:32]
    out = []
    for v in order:
        up, above = tree.up[v], None
        if v in edge or depth[v] == BAND:
            above, w = [], v
            while w >= 0:
                above.append(key[w])
                w = tree.up[w]
        out.append((
            key[v], band, key[up] if up >= 0 else None, tree.ends[v] or None, band * BAND + depth[v], low[v], low[up] if up >= 0 else None, tree.words[v], n[v], kids[v], leaves[v], saved[v], tree.more[v], v in edge, above,
        ))
    return out


def sharded(bands: DataFrame, per: int = SHARD) -> DataFrame:
    """NODE rows of (band, root, ids, words, n, low, end_key, more), dealt and sorted by range."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODE.split(", "))])

    def told(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            """The trees of what is held. Its first and last root may have rows elsewhere."""
            out, a = [], 0
            for b in range(1, len(held) + 1):
                if b == len(held) or (held[b]["band"], held[b]["root"]) != (held[a]["band"], held[a]["root"]):
                    out += shard(held[a]["band"], held[a]["root"], held[a:b], a == 0, b == len(held))
                    a = b
            held.clear()
            if out:
                yield told(out)

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for r in batch.slice(i, 512).to_pylist():
                    held.append(r)
                    if len(held) >= per:
                        yield from done()
        yield from done()

    by = ["band", "root", "ids"]
    return bands.repartitionByRange(groups_for(bands.count(), per), *by).sortWithinPartitions(*by).mapInArrow(run, NODE)


# ---------------------------------------------------------------- merging


def merged(nodes: DataFrame) -> DataFrame:
    """Complete nodes of every band, each without what lies in deeper bands."""
    edge = nodes.where("edge")
    sums = edge.groupBy("key", "band").agg(
        F.max("parent").alias("parent"), F.max("end_key").alias("end_key"), F.max("depth").alias("depth"), F.min("low").alias("low"), F.max("words").alias("words"),
        F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("more").alias("more"), F.max_by("above", "depth").alias("above"),
    )
    sums = written(sums)
    below = sums.where("parent is not null").groupBy(F.col("parent").alias("key"), "band").agg(F.count("*").alias("edge_kids"))
    alone = F.col("more") & (F.col("n") == 1)
    # A boundary node's own share; that of a deeper band's root is counted in the band above.
    mine = F.col("parent").isNotNull() | (F.col("depth") == 0)
    told = sums.join(below, ["key", "band"], "left").withColumn("kids", F.col("kids") + F.coalesce("edge_kids", F.lit(0)))
    told = told.withColumn("own_leaf", F.when(mine & (alone | ~F.col("more") & (F.col("kids") == 0)), 1).otherwise(0)).withColumn("own_saved", F.when(mine, (F.col("n") - 1) * F.col("words")).otherwise(0))
    told = written(told.withColumn("kids", F.col("kids") + alone.cast("int")))
    shares = told.where("own_leaf <> 0 or own_saved <> 0").select(F.explode("above").alias("key"), "band", "own_leaf", "own_saved").groupBy("key", "band").agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    told = told.join(shares, ["key", "band"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
    names = ["key", "band", "parent", "end_key", "depth", "low", "parent_low", "words", "n", "kids", "leaves", "saved", "above"]
    edges = told.withColumn("parent_low", F.lit(None).cast("long")).select(*names, F.lit(True).alias("edge"))
    every = written(nodes.where("not edge").select(*names, "edge").unionByName(edges))
    # The smallest member of a boundary parent, or of one in the band above, is known only now.
    lows = every.where((F.col("depth") % BAND == 0) | F.col("edge")).groupBy(F.col("key").alias("parent")).agg(F.min("low").alias("parents_low"))
    lows = written(lows.join(every.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")), "parent"))
    return looked_up(every, lows, ["parent"]).withColumn("parent_low", F.coalesce("parents_low", "parent_low")).select(*names)


def joined_bands(nodes: DataFrame, deepest: int) -> DataFrame:
    """Nodes of all bands as one trie: each band's totals added to what lies above its root, the deepest first."""
    for band in range(deepest, 0, -1):
        is_root = (F.col("band") == band) & F.col("parent").isNull()
        roots = nodes.where(is_root).select("key", F.col("kids").alias("k"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        tops = nodes.where((F.col("band") == band - 1) & (F.col("depth") == band * BAND)).select("key", "above").join(roots, "key")
        adds = tops.select("key", F.explode("above").alias("at"), "k", "l", "s").groupBy(F.col("at").alias("key")).agg(F.sum("l").alias("add_l"), F.sum("s").alias("add_s"), F.sum(F.when(F.col("key") == F.col("at"), F.col("k")).otherwise(0)).alias("add_k"))
        adds = adds.withColumn("band", F.lit(band - 1).cast("long"))
        plus = lambda c: (F.col(c) + F.coalesce(f"add_{c[0]}", F.lit(0))).alias(c)
        nodes = written(nodes.where(~is_root).join(written(adds), ["key", "band"], "left").select(*(plus(c) if c in ("kids", "leaves", "saved") else c for c in nodes.columns)))
    return nodes


def end_digests(ends: DataFrame) -> DataFrame:
    """(end_key, digest) of (conv, end_key): the hash of the ids, in order, comma-joined."""
    chunked = written(ends.repartitionByRange("conv", "end_key").withColumn("chunk", F.spark_partition_id()))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = chunked.groupBy("end_key", "chunk").agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            keys, digests = [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        keys.append(key)
                        digests.append(h.hexdigest())
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["end_key", "digest"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["end_key", "digest"])

    return chunks.repartition("end_key").sortWithinPartitions("end_key", "chunk").select("end_key", "ids").mapInArrow(run, "end_key string, digest string")


def trie(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per: int = SHARD) -> DataFrame:
    """A row for each node of the rebuilt conversations' prefix trie."""
    rows = table.select(table[conv_col].cast("long").alias("conv"), table[turn_col].alias("turn"), F.coalesce(table[role_col], F.lit("")).alias("role"), F.coalesce(table[text_col], F.lit("")).alias("text")).where("conv is not null")
    turns, _ = encoded(rows)
    turns = written(numbered(written(turns), "conv", [F.col("turn").asc_nulls_first(), F.col("tid")]).select("conv", "pos", "tid", "words"))
    own, convs = rebuilt(turns)
    own = written(own)
    bands = written(banded(own, convs))
    # How many members each band root has; roots with one need no tree.
    members = written(bands.where(F.size("ids") == BAND).groupBy(F.col("end_key").alias("root")).agg(F.count("*").alias("members")))
    rooted = looked_up(bands, members.withColumn("n", F.col("members")), ["root"]).withColumn("alone", F.coalesce(F.col("members") == 1, F.lit(False)) & (F.col("band") > 0)).drop("members")
    rooted = written(rooted)
    shared = rooted.where("not alone")
    equal = written(shared.groupBy("band", "root", "ids").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv").alias("low"), F.max("end_key").alias("end_key"), F.max("more").alias("more")))
    deepest = equal.agg(F.max("band")).first()[0] or 0
    nodes = joined_bands(written(merged(written(sharded(equal, per)))), deepest)
    digests = written(end_digests(shared.where("not more").select("conv", "end_key")))
    told = nodes.join(digests, "end_key", "left").select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"),
    )
    last = F.col("i") == F.size("ids") - 1
    ends = last & ~F.col("more")
    tails = rooted.where("alone").select("*", F.posexplode("ids").alias("i", "tid")).select(
        F.col("conv").alias("conv_id"), (F.col("band") * BAND + F.col("i") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ends, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return told.unionByName(tails)
