"""URL templates, ns-bounds k-means and the prefix trie against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from claimloom.llm import centroids, common, prefixtrie, urltree

# ------------------------------------------------------------------ lookups


def test_lookup_of_keys_of_any_weight(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, i long")
    values = common.written(spark.createDataFrame([(k, f"v{k}", 2000 if k == 0 else 1) for k in range(0, 3000, 2)], "k long, v string, n long"))
    got = {r["i"]: r["v"] for r in common.looked_up(rows, values, ["k"]).collect()}
    assert got == {i: (f"v{k}" if k % 2 == 0 else None) for i in range(3000) for k in [0 if i % 3 else i]} | {-1: None}


# ------------------------------------------------------------------ 11 URL templates


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fit = [r for r in urltree.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def typed_path(path):
    def of(seg):
        for kind, pattern in urltree.TYPES:
            if m := regex.match(rf"^(?:{pattern}){urltree.EXTENSION}$", seg):
                return f"{{{kind}}}{m[1]}"
        return seg

    if path == "":
        return []
    segs = [of(s) for s in path.removeprefix("/").split("/")]
    return segs if len(segs) <= urltree.LEVELS else [*segs[: urltree.LEVELS - 1], "/".join(segs[urltree.LEVELS - 1 :])]


def shape(segs, i):
    if i >= len(segs):
        return "end"
    kind = re.match(r"\{([a-z]+)\}", segs[i])
    return "slash" if segs[i] == "" else kind[1] if kind and kind[1] in urltree.SHAPES else "word"


def brute_trees(urls, known):
    """[(host, path, template, labelled, purity)] level by level, all in memory."""
    rows = []
    for url, label in zip(urls, known, strict=True):
        host, path = split_url(url)
        fit = ruled(host, path)
        rows.append({"host": host, "path": path, "segs": typed_path(path), "label": fit.verdict == "block" if fit else label, "node": ""})
    for level in range(max((len(r["segs"]) for r in rows), default=0)):
        points = defaultdict(lambda: defaultdict(list))
        live = [r for r in rows if len(r["segs"]) > level]
        for r in live:
            if shape(r["segs"], level) == "word":
                points[r["host"], r["node"]][r["segs"][level]].append(r)
        names = {}
        for at, kids in points.items():
            if len(kids) > urltree.MANY:
                names |= {(at, k): "*" for k in kids}
                continue
            told = []
            for k, rs in kids.items():
                shapes = Counter(shape(r["segs"], level + 1) for r in rs)
                told.append({"seg": k, "n": len(rs), "labelled": sum(r["label"] is not None for r in rs), "blocked": sum(bool(r["label"]) for r in rs), "shapes": [shapes[s] for s in urltree.SHAPES]})
            names |= {(at, k): v for k, v in urltree.merged(told).items()}
        for r in live:
            r["node"] += "/" + names.get(((r["host"], r["node"]), r["segs"][level]), r["segs"][level])
    labelled = [r["label"] for r in rows if r["label"] is not None]
    base = min(0.5, sum(labelled) / len(labelled)) if labelled else 0.5
    leaves = defaultdict(list)
    for r in rows:
        leaves[r["host"], r["node"]].append(r["label"])
    out = []
    for r in rows:
        of = [x for x in leaves[r["host"], r["node"]] if x is not None]
        out.append((r["host"], r["path"], r["node"], len(of), round((sum(of) + urltree.SMOOTH * base) / (len(of) + urltree.SMOOTH), 9)))
    return out


def some_urls(rng):
    urls = []
    for host in ("a.example.com", "B.Example.net", "c.example.org", "shop.test", "net"):
        for lang in ("de", "en", "fr", "es"):
            urls += [f"https://{host}/{lang}/{rng.randrange(9999)}{rng.choice(['', '/', '.html', '?q=://x', '#t'])}" for _ in range(25)]
        urls += [f"http://{host}/blog/{''.join(rng.choices('abcdefgh', k=7))}/{rng.choice(['view', 'edit'])}" for _ in range(160)]
    urls += ["http://net", "http://net/", "http://x.net?y", "HTTP://ORG/fr/1", "nothing", None, "", "://", "://h", "http://h//a//b", "http://h/" + "x/" * 40, "http://h/" + "y" * 50_000, "http://h/2024-01-02/0123456789ab/u7-x.tar"]
    return urls + urls[:40]


def test_url_trees_equal_brute_force(spark):
    rng = random.Random(2)
    urls = some_urls(rng)
    label = [rng.choice([True, None]) if u and "/edit" in u else rng.choice([False, None]) if u and "/view" in u else None for u in urls]
    pages = spark.createDataFrame([(i, u, x) for i, (u, x) in enumerate(zip(urls, label, strict=True))], "page_id long, url string, bad boolean")
    got = {r["page_id"]: r for r in urltree.judged(pages.selectExpr("*", "1 AS host", "2 AS path", "3 AS template", "4 AS n", "5 AS segs"), blocked=pages["bad"]).collect()}
    assert len(got) == len(urls)
    for i, (host, path, template, labelled, purity) in enumerate(brute_trees(urls, label)):
        r, fit = got[i], ruled(host, path)
        assert (r["host"], r["path"], r["template"], r["labelled"], round(r["purity"], 9)) == (host, path, template, labelled, purity)
        assert r["rule"] == (fit.name if fit else None)
        assert r["verdict"] == (fit.verdict if fit else "block" if purity >= urltree.REJECT else "allow")
    told = {r["template"] for r in got.values()}
    assert "/blog/*/edit" in told and "/blog/*/view" in told and any("{" in t and "|" in t for t in told)
    # Urls without a label under a template of blocked ones are rejected, those beside it aren't.
    free = [r for r in got.values() if r["rule"] is None]
    assert {r["verdict"] for r in free if r["template"] == "/blog/*/edit"} == {"block"} and {r["verdict"] for r in free if r["template"] == "/blog/*/view"} == {"allow"}


def test_url_branches_are_merged_only_if_alike():
    one = lambda seg, n, labelled, blocked, shapes: {"seg": seg, "n": n, "labelled": labelled, "blocked": blocked, "shapes": shapes}
    assert urltree.merged([one("a", 50, 0, 0, [50, 0]), one("b", 40, 0, 0, [40, 0]), one("c", 60, 0, 0, [0, 60]), one("d", 3, 0, 0, [3, 0])]) == {"a": "{a|b}", "b": "{a|b}"}
    assert urltree.merged([one("a", 50, 50, 50, [50]), one("b", 50, 50, 0, [50])]) == {}
    assert urltree.merged([one("a", 50, 50, 50, [50]), one("b", 50, 0, 0, [50])]) == {}


def test_url_trees_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urltree.judged(none).count() == 0
    only = urltree.judged(spark.createDataFrame([(None, None)], "page_id long, url string")).collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in only] == [("", "", None, "allow")]


# ------------------------------------------------------------------ 12 k-means


def lloyd(x, first, rounds):
    c = first.copy()
    for i in range(rounds + 1):
        d = ((x[:, None, :].astype(object) - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if i < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = x[a == j].astype(object).sum(0) // int((a == j).sum())
    return a, d[np.arange(len(x)), a], c


@pytest.mark.parametrize("scale", [0.3, 20.0, 20_000.0])
def test_kmeans_equals_lloyd(spark, scale):
    rng = np.random.default_rng(4)
    around = rng.normal(size=(12, centroids.DIMS))
    v = np.float32(np.concatenate([around[rng.integers(0, 12, 700)] + rng.normal(size=(700, centroids.DIMS)) * 0.2, np.repeat(around[:1], 90, 0)]) * scale)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.clusters(table.repartition(3).selectExpr("*", "'z' AS x", "9 AS cluster", "8 AS distance")).toPandas().set_index("vec_id").sort_index()
    x = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    order = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    a, d, c = lloyd(x, x[order[: centroids.K]], centroids.ROUNDS)
    assert (got.cluster.to_numpy() == a).all() and [int(y) for y in got.distance] == [int(y) for y in d]
    assert set(got.inertia) == {int(d.sum())} and all(got.cluster_inertia[a == j].nunique() <= 1 for j in range(centroids.K))
    digest = [hashlib.sha256(",".join(str(int(e)) for e in row).encode()).hexdigest() for row in c]
    assert list(got.centroid_sha256) == [digest[j] for j in a]
    assert got.scanned.mean() < centroids.K * 0.8  # bounds spare comparisons in the last round


def test_kmeans_bounds_are_loosened_by_the_net_move():
    history = np.zeros((3, 1, centroids.DIMS), np.int64)
    history[1, 0, 0] = 100  # there and back again
    assert np.allclose(centroids.moved(history)[:, 0], [0, 100, 0])


def test_kmeans_of_odd_vectors(spark):
    ok = [0.5] * centroids.DIMS
    rows = [(1, ok), (1, ok), (None, ok), (2, None), (3, []), (4, ok[:-1]), (5, [None, *ok[1:]]), (6, [float("nan"), *ok[1:]]), (7, [float("inf"), *ok[1:]]), (8, [3e38, *ok[1:]]), (9, [-1.0] * centroids.DIMS)]
    got = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, None: 1, 9: 1} and {r["distance"] for r in got} == {0}
    assert centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------------ 13 prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    seq = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in seq:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = seq.get(base, [])[:h] + seq[c][h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    for k, m in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words
    out = Counter()
    for k, m in nodes.items():
        ends = sorted(c for c in m if len(built[c]) == len(k))
        out[min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()] += 1
    return out


CONV = "conv_id long, turn long, role string, text string"


def some_turns():
    rng = random.Random(3)
    rows = [(c, t if rng.random() > 0.05 else None, rng.choice("ua"), rng.choice(["a b", "c", "", None, "d e f\x0bg"])) for c in range(-30, 120) for t in range(rng.randint(1, 6))]
    return rows + [(None, 1, "u", "x"), (500, 0, None, None), (501, 0, "u", "w " * 30_000), (40, 1, "u", "a b"), (40, 1, "u", "a b")]


@pytest.mark.parametrize(("band", "per"), [(256, 4096), (256, 3), (3, 5)])
def test_trie_equals_brute_force(spark, monkeypatch, band, per):
    monkeypatch.setattr(prefixtrie, "BAND", band)
    # Copies of long conversations, one of which ends where a band does.
    rows = some_turns() + [(c, t, "u", f"t{t}") for c in (1000, 1001, 1002, 1041, 1061) for t in range(14 if c % 2 else 12)] + [(1100, t, "u", f"t{t}") for t in range(9)]
    table = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS n", "2 AS key", "3 AS words", "4 AS tid", "5 AS conv")
    got = Counter(tuple(r) for r in prefixtrie.trie(table, per=per).collect())
    assert got == brute_trie(rows)


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    rows = [(7, t, "u", f"w{t % 50}") for t in range(3000)] + [(8, 0, "u", "x")]
    got = prefixtrie.trie(spark.createDataFrame(rows, CONV)).toPandas()
    h = zlib.crc32(b"7") % 4
    assert sorted(got[got.conv_id == 7].depth) == list(range(0 if got.conv_id.min() == 7 else 1, 3000 - h + 1)) and set(got[got.depth > 1].n_convs) == {1}
    assert got[got.depth == 3000 - h].n_children.tolist() == [0] and got[got.depth == 0].n_leaves.tolist() == [1 if zlib.crc32(b"8") % 4 else 2]
    assert prefixtrie.trie(spark.createDataFrame([], CONV)).count() == 0


def test_median_first_trees_are_balanced():
    assert sorted(prefixtrie.medians(1000)) == list(range(1000)) and next(prefixtrie.medians(9)) == 4
    tree = prefixtrie.Tree()
    for i in prefixtrie.medians(1023):
        tree.insert([i], [1], 1, i, "e", False)

    def depth(v):
        return 0 if v < 0 else 1 + max(depth(tree.lower[v]), depth(tree.higher[v]))

    assert depth(tree.first[0]) == 10


def test_numbers_of_one_hot_key_split_over_parts(spark):
    rows = spark.createDataFrame([(1 if i % 3 else 2, i % 97) for i in range(4000)], "conv long, t long")
    got = prefixtrie.numbered(rows, "conv", [F.col("t")]).toPandas()
    for _, g in got.groupby("conv"):
        assert sorted(g.pos) == list(range(len(g))) and g.sort_values("pos").t.is_monotonic_increasing
