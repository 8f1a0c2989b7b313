"""The text operators against brute force, round trips and held-out accuracy, on small fixtures."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from claimloom.llm import ann, chat, common, decontaminate, language, licenses, neardup, packing, pii, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_of(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


ODD = [None, "", "   ", "one", "Ünïcödé wörds hére", "x" * 50_000, "a b " * 9000, "same text here for both", "same text here for both"]

# ------------------------------------------------------------------ shared


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).withColumn("h", common.held_out(F.col("id"), 3, 1)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ 1 nearest neighbours


def test_ann_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x[10:30] = x[10]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0]), (9004, [None] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = ann.search(df, df.where("vec_id % 50 = 10 or vec_id >= 9000"))
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(10, 3000, 50))
    hit = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len({r["vec_id"] for r in rs} & set(want.tolist()))
        assert [r["rank"] for r in rs] == list(range(1, 11)) and np.allclose([r["score"] for r in rs], d[[r["vec_id"] for r in rs]])
    assert hit / (10 * len(by)) >= 0.9
    assert [r["vec_id"] for r in by[10]] == list(range(11, 21))


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_ann_learned_share_and_recall(spark, kind):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(8000, 24)) if kind == "random" else np.repeat(rng.normal(size=(80, 24)), 100, 0) * 5 + rng.normal(size=(8000, 24)) * 0.3
    left, right = ann.centroids(x[:, :12], 64, 1), ann.centroids(x[:, 12:], 64, 2)
    share = ann.calibrated(x, left, right, 10)
    assert share < (0.75 if kind == "random" else 0.1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 80 = 0")).toPandas()
    hit = 0
    for q, rs in got.groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(rs.vec_id) & set(np.argsort(d)[:10].tolist()))
    assert got.query_id.nunique() == 100 and hit / 1000 >= 0.9


def test_ann_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(df, df).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    assert ann.search(df.limit(0), df).count() == 0


# ------------------------------------------------------------------ 2 toxicity


def test_toxicity_learns_words_and_locates_sentences(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        y = int(i % 4 == 0)
        sentences = [" ".join(rng.choices(WORDS, k=6)) for _ in range(rng.randint(1, 6))]
        if y:
            sentences[rng.randrange(len(sentences))] += rng.choice([" vile", " nastyone", " nastytwo"])
        rows.append((y, ". ".join(sentences)))
    model = toxicity.fit(rows[:400])
    held = docs_of(spark, [t for _, t in rows[400:]])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(held, model, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, (y, _) in enumerate(rows[400:])]) > 0.95
    found = toxicity.offending(docs_of(spark, ["alpha beta. you vile thing! gamma"]), model).collect()
    assert [(r["sentence"], "vile" in r["text"]) for r in found] == [(1, True)]


def test_toxicity_by_brute_force(spark):
    """Noisy-or and offending sentences, one word after another; very long, repeated and odd texts among them."""
    rng = random.Random(7)
    rows = [(int(i % 3 == 0), " ".join(rng.choices(WORDS, k=8)) + (rng.choice([" vile", " nastyone", " nastytwo"]) if i % 3 == 0 else "")) for i in range(300)]
    model = toxicity.fit(rows)
    weight = dict(zip(model["known"].tolist(), model["weights"].tolist(), strict=True))
    hashed = lambda word, mark=0: int(common.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) ^ mark
    weigh = lambda w: weight.get(hashed(w), 0.0) + sum(weight.get(hashed(w[:n], k + 1), 0.0) for k, n in enumerate(toxicity.PREFIXES) if len(w) >= n)
    texts = ["é VILE thing! ok. naïve nastytwo", "ok\nNastyone, you. vile", " ".join(rng.choices(WORDS, k=30_000)) + ". vile. ende", "vile", "vile", "... !", "nastyon nast. " * 40, *(t for _, t in rows[:40])]
    df = docs_of(spark, [*texts, "", None]).withColumn("offending", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model, ["doc_id", "offending"]).collect()}
    for i, text in enumerate(texts):
        each = []
        for s in regex.finditer(r"[^.!?\n]+", text):
            words = list(regex.finditer(r"[A-Za-z\u0080-\U0010ffff]+", s[0]))
            if words:
                logit = model["bias"] + sum(weigh(w[0].encode().lower()) for w in words)
                each.append((s.start() + words[0].start(), s.start() + words[-1].end(), 1 / (1 + np.exp(-logit))))
        score = 1 - np.prod([1 - p for *_, p in each]) if each else 0.0
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
        top = max(range(len(each)), key=lambda k: (each[k][2], -k)) if score >= toxicity.THRESHOLD else None
        want = [(k, a, b) for k, (a, b, p) in enumerate(each) if p >= toxicity.LOCATED or k == top]
        assert [(o["sentence"], o["start"], o["end"]) for o in got[i]["offending"]] == want, text[:60]
        assert [o["p"] for o in got[i]["offending"]] == pytest.approx([each[k][2] for k, *_ in want])
    assert any(r["offending"] for r in got.values()) and got[len(texts)]["offending"] == got[len(texts) + 1]["offending"] == []


def test_toxicity_odd_rows_and_no_labels(spark):
    df = docs_of(spark, ODD).withColumn("score", F.lit("clash"))
    got = toxicity.score(df, toxicity.fit([(1, "bad bad"), (0, "good good")] * 5), ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] == 0
    assert {r["score"] for r in toxicity.score(df, toxicity.fit([]), ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(empty(spark), toxicity.fit([]), ["doc_id"]).count() == 0


# ------------------------------------------------------------------ 3 near duplicates


def brute(texts, width, percent=80):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ITEMS", 8)  # so that groups are cut into tiles
    monkeypatch.setattr(neardup, "TILE_HASHES", 400)
    rng = random.Random(2)
    base = [rng.choices(WORDS, k=90) for _ in range(6)]
    texts = list(ODD)
    for _ in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        texts.append(rng.choice([str.upper, str.lower])(" ".join(t)))
    n, label = brute(texts, width)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, texts).withColumn("kept", F.lit(1)), width).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_empty_null_ids_and_repeats(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1)}
    assert sorted(str(r["doc_id"]) for r in neardup.deduplicated(df).collect()) == ["1", "None"]


def test_estimate_keeps_pairs_at_exactly_the_threshold():
    """20,000 pairs of each size at 0.8: nearly all reach the estimate's margin, and share a band."""
    rng = np.random.default_rng(31)
    sigma = (0.85 * 0.15 / neardup.HASHES) ** 0.5 / 0.75
    words = np.array([f"w{i}" for i in range(200_000)])
    for small, large in ((4, 5), (8, 10), (40, 50), (80, 100)):
        texts = []
        pairs = 20_000 if large < 50 else 2_000
        for _ in range(pairs):
            w = words[rng.integers(0, len(words), large)]
            texts += [" ".join(w[:small]), " ".join(w)]  # one-word shingles: the sets are the words
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
        out = pa.Table.from_batches(list(neardup._sketched(1)([batch])))
        n = out["n"].to_numpy()
        right = (n[::2] == small) & (n[1::2] == large)  # without chance repeats of a word
        packed = np.stack(out["signature"].to_numpy()).view(np.uint64)
        bands = np.stack(out["bands"].to_numpy())
        kept = neardup.estimated(packed[::2], packed[1::2]) >= 0.8 - 4 * sigma
        assert right.sum() > 0.9 * pairs and (~kept[right]).sum() <= 5 and (~(bands[::2] == bands[1::2]).any(1)[right]).sum() <= 1, (small, large)


def test_near_duplicates_of_a_large_group_with_chains(spark, monkeypatch):
    """Large groups are compared with their leader first; chains away from it must still be found."""
    monkeypatch.setattr(neardup, "TILE_ITEMS", 4)
    monkeypatch.setattr(neardup, "TILE_HASHES", 150)
    rng = random.Random(12)
    texts, words = [], [f"v{i}" for i in range(60)]
    for i in range(40):  # each step changes few words: neighbours link, ends don't
        texts.append(" ".join(words))
        for k in rng.sample(range(60), 2 if i % 3 else 1):
            words[k] = f"n{i}_{k}"
    texts += [texts[5] + f" tail{i}" for i in range(20)]
    n, label = brute(texts, 4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, texts), 4).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) < len(texts)


def test_deduplicated_keeps_the_same_row_of_a_repeated_id(spark):
    df = spark.createDataFrame([(1, "a b", "x", [1]), (1, "a c", "y", [2]), (1, "a c", "z", [3])], "doc_id long, text string, lang string, more array<int>")
    for parts in (1, 3):
        assert [tuple(r) for r in neardup.deduplicated(df.repartition(parts)).collect()] == [(1, "a c", "z", [3])]


def test_packed_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    low = rng.integers(0, 4, (2, neardup.HASHES)).astype(np.uint64)
    low[1, : neardup.HASHES // 2] = low[0, : neardup.HASHES // 2]
    packed = np.zeros((2, neardup.WORDS), np.uint64)
    for k in range(neardup.HASHES):
        packed[:, k * 2 // 64] |= low[:, k] << np.uint64(k * 2 % 64)
    same = (low[0] == low[1]).mean()
    assert np.isclose(neardup.estimated(packed[0], packed[1]), (same - 0.25) / 0.75) and neardup.estimated(packed[0], packed[0]) == 1


# ------------------------------------------------------------------ 4 packing


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    texts = [*ODD, "a <|endoftext|> b", "tabs\t\tand\n\n lines  end ", "日本語 テキスト", *[" ".join(random.Random(i).choices(WORDS, k=i * 7)) for i in range(60)]]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    got = packing.pack(docs_of(spark, texts).repartition(3).withColumn("length", F.lit("clash")), window=256, open_windows=4).toPandas()
    assert got.length.sum() == sum(map(len, want.values()))
    for r in got.itertuples():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 256 + 2
    assert packing.pack(empty(spark)).count() == 0


# ------------------------------------------------------------------ 5 chat


def test_chat_reads_back_what_it_wrote(spark):
    nasty = ["<turn>user\nhi</turn>\n", "\\", "\\\\</turn>", "<\\turn>", "", "###", "a\nb", "é\U0001f600"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % len(nasty)]) for c in range(10) for t in range(4)] + [(50, 0, "weird\nrole", None), (50, 1, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(chat.chat(chat.conversations(df))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for k, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        lost = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(lost)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()


def test_chat_layouts(spark):
    records = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}', '{"instruction": "q", "input": "", "output": "a"}', '{"prompt": "q", "response": "a", "meta": {"x": 1}}', '{"question": "q", "answer": "a"}', '{"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}', '{"other": 1}', "not json"]
    got = {r["id"]: r for r in chat.chat(spark.createDataFrame(list(enumerate(records)), "id long, json string")).collect()}
    assert [got[i]["layout"] for i in range(8)] == ["messages", "conversations", "instruction", "prompt", "question", "turns", None, None]
    assert {got[i]["chat"] for i in range(6)} == {"<turn>user\nq</turn>\n<turn>assistant\na</turn>\n"} and got[6]["chat"] == got[7]["chat"] == ""


def test_chat_of_records_that_no_variant_holds(spark, monkeypatch):
    made = chat.fingerprinted
    without = lambda *a: made(*a).withColumn("__record", F.expr("parse_json(NULL)")).withColumn("__paths", F.lit(None).cast("string")).withColumn("fingerprint", F.lit(None).cast("long"))
    records = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}', '{"instruction": "q", "input": "", "output": "a"}', '{"prompt": "q", "response": "a"}', '{"other": 1}', "not json"]
    df = spark.createDataFrame(list(enumerate(records)), "id long, json string")
    known = {r["id"]: (r["layout"], r["chat"], r["loss"]) for r in chat.chat(df).collect()}
    monkeypatch.setattr(chat, "fingerprinted", without)
    assert {r["id"]: (r["layout"], r["chat"], r["loss"]) for r in chat.chat(df).collect()} == known and known[0][0] == "messages"


def test_chat_keeps_roles_and_reports_what_it_cannot_read(spark):
    records = [
        '{"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]}',
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "q1 "}, {"type": "image", "url": "u"}, {"type": "text", "text": "q2"}]}, {"role": "assistant", "content": "a"}]}',
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "x": 1, "x": 2}',
        '{"prompt": "q", "response": null}',
        '{"messages": [{"role": "user", "content": null}]}',
        '{"other": 1}', '{"messages": [', None, "",
    ]
    got = {r["id"]: r for r in chat.chat(spark.createDataFrame(list(enumerate(records)), "id long, json string")).collect()}
    assert [got[i]["status"] for i in range(9)] == ["ok", "ok", "ok", "incomplete", "incomplete", "unknown layout", "malformed", "malformed", "malformed"]
    assert got[0]["chat"] == "<turn>human\nq</turn>\n<turn>gpt\na</turn>\n" and got[0]["loss"] == []
    assert got[1]["chat"] == "<turn>user\nq1 q2</turn>\n<turn>assistant\na</turn>\n"
    assert got[2]["chat"] == "<turn>user\nq</turn>\n<turn>assistant\na</turn>\n" and got[2]["layout"] == "messages"
    assert got[3]["chat"] == "<turn>user\nq</turn>\n<turn>assistant\n</turn>\n"
    rows = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", "a")], "conv_id long, turn long, role string, text string")
    told = chat.digest(chat.chat(chat.conversations(rows))).first()
    assert told["turns_sha256"] == hashlib.sha256(b"human\nq\ngpt\na\n").hexdigest() and told["loss_chars"] == 0 and told["status"] == "ok"
    assert chat.chat(chat.conversations(rows.limit(0))).count() == 0


def test_chat_layouts_by_true_nesting(spark):
    records = [
        ('{"meta": {"a": "x", "prompt": "p", "response": "r"}}', None, "unknown layout", ""),
        ('{"meta": {"a": 1, "messages": [{"role": "user", "content": "no"}]}, "prompt": "p", "response": "r"}', "prompt", "ok", "<turn>user\np</turn>\n<turn>assistant\nr</turn>\n"),
        ('{"prompt": ["a", "b"], "response": "r"}', "prompt", "ok", "<turn>user\nab</turn>\n<turn>assistant\nr</turn>\n"),
        ('{"prompt": {"deep": "a"}, "response": 5}', "prompt", "incomplete", "<turn>user\n</turn>\n<turn>assistant\n5</turn>\n"),
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}]}', "messages", "incomplete", "<turn>user\nq</turn>\n<turn>assistant\n</turn>\n"),
        ('{"messages": [{"role": "user", "content": "q"}, "loose"]}', "messages", "incomplete", "<turn>user\nq</turn>\n<turn>\n</turn>\n"),
        ('{"messages": {"role": "user", "content": "q"}}', None, "unknown layout", ""),
        ('{"a, prompt": "p", "`prompt`: STRING, response": "r"}', None, "unknown layout", ""),
        ('[{"prompt": "p", "response": "r"}]', None, "unknown layout", ""),
    ]
    df = spark.createDataFrame([(i, r[0], "x", "y", "z") for i, r in enumerate(records)], "id long, json string, layout string, record string, status string")
    got = {r["id"]: r for r in chat.chat(df).collect()}
    for i, (_, layout, status, text) in enumerate(records):
        assert (got[i]["layout"], got[i]["status"], got[i]["chat"]) == (layout, status, text), records[i]
    assert got[0]["record"] == "y" and set(chat.chat(df).columns) == {"id", "record", *chat.RESULT}


def test_chat_through_every_layout(spark):
    rows = [(c, t, role, f"{role} {c} \\ </turn>") for c in range(28) for t, role in enumerate(["user", "assistant"])]
    rows += [(c, t, role, "x") for c in range(100, 107) for t, role in enumerate(["system", "user", "gpt", "human"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.chat(chat.conversations(df, layouts=chat.LAYOUTS))
    assert {r["layout"] for r in made.collect()} == {x.name for x in chat.LAYOUTS} and made.select("fingerprint").distinct().count() == 7
    plain = chat.digest(chat.chat(chat.conversations(df)))
    assert chat.digest(made).exceptAll(plain).count() == 0 and made.count() == plain.count()


# ------------------------------------------------------------------ 6 decontamination


def test_decontamination_sees_through_parameters(spark):
    item = "A train leaves with Alice at 30 km every hour and then Bob pays 12 dollars to ride with Alice until the last stop of the line."
    same = "So then. " + item + " The end."
    renamed = item.replace("Alice", "Maria").replace("30 km", "75 miles").replace("Bob", "Jo").replace("12 dollars", "9 euros")
    mixed = item.replace("Alice", "Maria", 1).replace("with Alice until", "with Petra until")
    texts = [same, renamed, "Unrelated words about nothing in particular, repeated at length for the sake of it.", None, "", item.upper()[:20], mixed]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 7), (1, 7)}
    left = {r["doc_id"] for r in decontaminate.clean(docs_of(spark, texts).withColumn("item_id", F.lit(1)), bench).collect()}
    assert left == {2, 3, 4, 5, 6}
    assert decontaminate.matches(empty(spark), bench).count() == 0 and decontaminate.matches(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_of_slots_of_other_lengths(spark):
    item = "a big red van moves on with two boxes for Bob who then drives back to the shop"
    pens = "He buys 2 pens and needs 2 days to write the long letter that he owes his old aunt by the sea."
    plain = "the old harbour keeps thirty small boats for Alice and nobody knows where Bob sleeps when Carol sails away at night"
    mixed = "we saw that Alice lent the green kettle to a friend and later Alice lost the silver spoon near the mill"
    slots = "one two three four five six seven eight nine ten eleven twelve red green grey brown black white pink gold beige navy lime teal".split()
    bench = spark.createDataFrame([(1, item), (2, pens), (3, plain), (4, "Zebras yodel"), (5, mixed), (6, " ".join(slots))], "item_id long, text string")
    texts = [item.replace("Bob", "Mary Ann Lee"), pens.replace("2 pens", "3 pens").replace("2 days", "5"), plain.upper(), "Some say zebras yodel at dawn.", " ".join([*slots[:12], "blue", *slots[12:]]), mixed.replace("Alice", "Mia", 1).replace("Alice", "Petra"), "Nothing of the kind is told in these few words."]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, texts), bench).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 6)}


def brute_contaminated(texts, items):
    """The docstring's rule with tuples of tokens in place of hashes, every document against every item."""
    d, width = decontaminate, decontaminate.WIDTH
    number = lambda t: regex.sub(d._MEASURE, d.NUM, t)
    words = lambda t: regex.findall(d._WORD, t.lower())
    forms = lambda t: [words(regex.sub(d._NAMES, d.NAME, number(t))), words(number(t)), [m.group() for m in regex.finditer(rf"{d._MEASURE}|{d._WORD}", t.lower())]]
    values = lambda t: [m.group() for m in regex.finditer(rf"{d._NAMES}|{d._MEASURE}|{d._WORD}", t)]
    names = lambda marks, vals, i, w: [" ".join(v.lower().split()) for m, v in zip(marks[i : i + w], vals[i : i + w], strict=True) if m == d.NAME]
    literal = lambda win: sum(m not in (d.NUM, d.NAME) for m in win) >= d.LITERALS

    def cover(at, w):
        return len({k for p in at for k in range(p, p + w)})

    def of_item(text):
        out, (t, p, x) = [], forms(text)
        for form, marks in ((0, t), (1, p)):
            w = min(len(marks), width)
            wins = [tuple(marks[i : i + w]) for i in range(len(marks) - w + 1)] if marks else []
            told = {i: (0, win) for i, win in enumerate(wins) if literal(win)}
            rich = len(marks) > 0 and 2 * cover(told, w) >= len(marks)
            if rich and (form == 0 or d.NAME in t):
                out.append((form, w, told, marks))
            elif form == 1 and not rich and len(marks) >= width:
                out.append((2, w, {i: told.get(i, (2, tuple(x[i : i + w]))) for i in range(len(wins))}, marks))
        return out

    got = set()
    for k, text in enumerate(texts):
        t, p, x = forms(text)
        seen = {0: t} | ({1: p} if d.NAME in t else {}) | {2: x}
        for n, item in enumerate(items):
            for form, w, told, marks in of_item(item):
                groups = {}
                for doc_form, line in seen.items():
                    for at in range(max(0, len(line) - w + 1)):
                        for pos, (kind, win) in told.items():
                            if tuple(line[at : at + w]) == win and (doc_form == 2) == (kind == 2):
                                pairs = list(zip(names(marks, values(item), pos, w), names(line, values(text), at, w) if doc_form == 0 else [None] * 9, strict=False)) if form == 0 else []
                                shift = at - pos
                                for g in ((0, shift), (1, shift // 16), (2, (shift + 8) // 16)):
                                    groups.setdefault((2 if form == 2 else doc_form, g), []).append((pos, pairs, shift))
                for (doc_form, g), hits in groups.items():
                    at, pairs = sorted({p for p, _, _ in hits}), {q for _, qs, _ in hits for q in qs}
                    longest = max(sum(1 for j in range(i, len(at)) if at[j] == at[i] + j - i) for i in range(len(at)))
                    places = longest if form > 0 and doc_form > 0 else len(at)
                    if len(pairs) != len({a for a, _ in pairs}):
                        continue
                    if cover(at, w) >= d.SHARE * cover(told, w) or g[0] == 0 and places >= d.RUN - width + 1:
                        got.add((k, n))
                    elif g[0] and form == doc_form == 0 and 2 * cover(at, w) >= cover(told, w) and len(marks) >= d.FINE:
                        shifts = [s for _, _, s in hits]
                        low = max(0, min(shifts) - d.NEAR)
                        line = seen[doc_form][low : max(shifts) + len(marks) + d.NEAR]
                        fine = {tuple(line[i : i + d.FINE]) for i in range(max(0, len(line) - d.FINE + 1))}
                        own = [i for i in range(len(marks) - d.FINE + 1) if tuple(marks[i : i + d.FINE]) in fine and any(m not in (d.NUM, d.NAME) for m in marks[i : i + d.FINE])]
                        if cover(own, d.FINE) >= d.SHARE * len(marks):
                            got.add((k, n))
    return got


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(61)
    people = ["Ana", "Bob", "Carla", "Dev", "Eva Lee", "Finn"]
    common = "buys sells counts apples boxes with and then before lunch near the old mill for each day of work".split()

    def question():
        out = [rng.choice(people)] if rng.random() < 0.5 else ["the"]
        for _ in range(rng.randint(4, 24)):
            out.append(rng.choice([*common, *common, rng.choice(people), str(rng.randint(2, 99)), f"{rng.randint(2, 99)} km", rng.choice(common) + "."]))
        return " ".join(out)

    items = [question() for _ in range(25)] + ["12 7 45 88 3 19 20", "Cut 3 4 5 6 7 8 9 10 11 12 13", "two words", "5 6", "", "It is 4"]
    texts = []
    for item in items:
        w = item.split() or ["x"]
        k = rng.randrange(len(w))
        swap = {n: rng.choice(people) for n in people}
        texts += [
            f"so {item} end", " ".join([*w[:k], "extra", *w[k:]]), " ".join([*w[:k], "changed", *w[k + 1 :]]), item.upper(), " ".join(w[: len(w) // 2]),
            " ".join(swap.get(x, str(rng.randint(2, 99)) if x.isdigit() else x) for x in w), " ".join(rng.choice(people) if x in people else x for x in w),
        ]
    texts += [" ".join(rng.choices(common, k=60)), "3 4 5 6 7", "Numbers 12 7 45 88 3 19 21 here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, texts), bench).collect()}
    want = brute_contaminated(texts, items)
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    assert all((7 * n, n) in got for n, item in enumerate(items) if len(item.split()) > 4)


def test_decontamination_finds_numbers_insertions_and_first_names(spark):
    items = ["12 7 45 88 3 19 20 31", "the quick auditors counted all boxes twice before the harbour opened today", "Lena reads books to the tired old sailors"]
    texts = ["Sequence 12 7 45 88 3 19 20 31 given", "the quick auditors counted nearly all boxes twice before the harbour opened today", "Otto reads books to the tired old sailors", "12 7 45 88 4 19 20 30", "a \ue000 b \ue001 c reads books to nobody"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, texts), bench).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_templates_of_long_runs(spark):
    texts = ["Aa " * 60_000, "1," * 60_000, "Bb. " * 30_000, "7 kg " * 30_000]
    got = docs_of(spark, texts).select(F.size(decontaminate.template(F.col("text"))).alias("n"), F.size(decontaminate.values(F.col("text"))).alias("v")).collect()
    assert [r["n"] for r in got] == [r["v"] for r in got] == [1, 1, 30_000, 30_000]


def test_template_tokens_have_their_values(spark):
    texts = ["We met Mary  Ann Lee and 30 Km later Bob. Then 5% of 7m3 x9y, Élan Vital", "a \ue000 b Straße 1,000.5 hours Über Alles", ""]
    rows = docs_of(spark, texts).select("text", decontaminate.template(F.col("text")).alias("t"), decontaminate.values(F.col("text")).alias("v")).collect()
    for r in rows:
        assert len(r["t"]) == len(r["v"]) and all(m in decontaminate.SLOTS or m == v.lower() for m, v in zip(r["t"], r["v"], strict=True)), r


def test_units_of_another_kind_do_not_match(spark):
    items = spark.createDataFrame([(1, "a box of 5 kg rests beside another box of 5 kg on the old shelf"), (2, "1 2 3 4"), (3, "7 8"), (4, "12 kg 5 hours 3 dollars")], "item_id long, text string")
    texts = {
        10: "so a box of 9 grams rests beside another box of 12 lb on the old shelf today",  # masses both
        11: "so a box of 7 hours rests beside another box of 9 dollars on the old shelf today",  # neither
        12: "we count 1 2 3 4 and stop", 13: "we count 2 3 4 5 and 7 8 stop", 14: "it is 12 kg 5 hours 3 dollars now", 15: "it is 12 kg 5 hours 4 dollars now",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(10, 1), (12, 2), (14, 4)}


# ------------------------------------------------------------------ 7 personal data

CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = lambda: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def test_base_spans_match_the_contract(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "x.y@z", "é a@b.co.uk_d@e.f", "1.2.3.4.5.6.7.8", "0255.1.1.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44 20", "++1 234567890 12", "a@b.c@d.e", "1 2 3", "\U0001f600", "%@x.y", "+1+2 333 444 5555-", "12-34 56", "0" * 16, "\n", ". "]
    texts = [*ODD, "1" * 30_000, "+" * 2000, "a." * 5000 + "@b.c", *["".join(rng.choices([*bits, " ", "-", "."], k=12)) for _ in range(300)]]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs_of(spark, texts).withColumn("base", F.lit(1)), ["doc_id"])).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), j, m.end(), k) for j, (k, p) in enumerate(CONTRACT.items()) for m in re.finditer(p, t or "") if valid(k, m.group()))
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), (t, told, got[i]["spans"])


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    texts = [f"please call me on +1 555 01{i:02d} 44{i:02d} today" for i in range(12)] + ["please call me on X77-4410 now", "version 2024 of build 9981 is out", None]
    rows = pii.find(docs_of(spark, texts), ["doc_id"])
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in rows.collect()}
    assert got[12] == [len(pii.KINDS)] and got[13] == [] and got[14] == [] and got[0] == [3]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs_of(spark, texts)).collect()}
    assert out[0] == "please call me on <PHONE> today" and out[12] == "please call me on <ID> now" and out[13] == texts[13] and out[14] is None
    assert pii.find(empty(spark), ["doc_id"]).count() == 0


def test_redaction_matches_plain_slicing(spark):
    rng = random.Random(15)
    bits = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 555 123 4567", "\U0001f600", "é ", "x9-77ab", "\n"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(80)] + ["", None]
    found = pii.find(docs_of(spark, texts), ["doc_id", "text"]).withColumn("cut", pii.redact(F.col("text"), F.col("spans"))).collect()
    for r in found:
        if r["text"] is None:
            continue
        out, at = "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                out += r["text"][at : s["start"]] + f"<{[*pii.KINDS, pii.NEW][s['kind']].upper()}>"
            at = max(at, s["end"])
        assert r["cut"] == out + r["text"][at:]


def test_contexts_of_long_words_and_texts_of_numbers(spark):
    long = "customer" * 40
    texts = [f"{long} number +1 555 01{i:02d} 44{i:02d} today" for i in range(12)] + [f"{long} number Q55-1234 now", "customer number Q55-9999 now", " ".join(f"w{i * 7919 % 10**6}" for i in range(100_000)), "a@b.c " * 20_000]
    rows = pii.find(docs_of(spark, texts), ["doc_id"]).select("doc_id", F.size("spans").alias("n"), F.get("spans", F.lit(0))["kind"].alias("kind")).collect()
    got = {r["doc_id"]: (r["n"], r["kind"]) for r in rows}
    assert got[12] == (1, len(pii.KINDS)) and got[13] == (0, None) and got[14] == (0, None) and got[15] == (20_000, 0)


def test_running_sums_and_maxima(spark):
    rng = random.Random(16)
    rows = [([rng.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 17, 100, 101)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", pii.running(F.col("v"), 0, lambda a, b: a + b).alias("s"), pii.running(F.col("v"), -99, F.greatest).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))] and r["m"] == [max(r["v"][: i + 1]) for i in range(len(r["v"]))]


def test_keys_teach_patterns_that_find_others(spark):
    """Long keys are seeds; short codes after the same words are held out, and nothing else is found."""
    rng = random.Random(6)
    some = lambda n, of="0123456789abcdef": "7a" + "".join(rng.choices(of, k=n - 2))
    texts, planted = [], []
    for i in range(60):
        key = some(40) if i % 3 else some(6)
        texts.append(f"{rng.choice(WORDS)} {rng.choice(WORDS)} token = \"{key}\" {rng.choice(WORDS)}")
        planted.append(key)
    lone = some(40)
    texts += [f"the year {1900 + i} was good, {rng.choice(WORDS)} room {i}b12 said the {some(16, '0123456789')}" for i in range(40)] + [f"alpha {lone} beta"]
    found = pii.find(docs_of(spark, texts), ["doc_id", "text"]).collect()
    new = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == len(pii.KINDS)] for r in found}
    assert all(new[i] == [planted[i]] for i in range(60)) and not any(new[i] for i in range(60, 101))


def test_redaction_keeps_columns_that_clash(spark):
    df = docs_of(spark, ["mail a.b@c.org now", "plain"]).selectExpr("*", "1 AS base", "2 AS spans", "3 AS pattern", "18L AS n_chars")
    got = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert pii.redacted(df).columns == df.columns and (got[0]["text"], got[0]["base"], got[0]["spans"], got[0]["n_chars"]) == ("mail <EMAIL> now", 1, 2, 16) and got[1]["text"] == "plain"


# ------------------------------------------------------------------ 8 WARC


def test_warc_round_trip_and_order(spark):
    html = ["<p>a</p>", "<p>a</p>", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n", None, "", "é" * 500, "<p>a</p>", "x\n\r\n\r"]
    pages = spark.createDataFrame([(i, f"http://www.h{i % 2}.example.com/p{i}#f", h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    got = {r["id"]: r for r in warc.archived(pages).collect()}
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        body = (h or "").encode()
        assert got[i]["payload_bytes"] == len(body) and got[i]["type"] == ("response" if last[h or ""] == i else "revisit")
        assert got[i]["refers_to"] == (None if last[h or ""] == i else last[h or ""])
    order = warc.index(warc.archived(pages), per_range=3).orderBy("range", "position").collect()
    keys = [(r["key"], r["date"]) for r in order]
    assert keys == sorted(keys) and len(keys) == len(html) and len({r["range"] for r in order}) > 1
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_records_are_members_that_can_be_sought(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOB_RECORDS", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BLOBS", 2)
    monkeypatch.setattr(warc, "MEMBER_BYTES", 700)  # so that larger records are several members
    rng = random.Random(14)
    html = ["".join(rng.choices("abc <>é\r\n\0", k=rng.randint(0, 2000))) for _ in range(40)]
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i % 7}", h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("at", F.timestamp_seconds(F.col("page_id") * 60))
    pages = pages.union(pages.where("page_id = 5")).coalesce(1)
    path = common.shared_dir(spark)
    warc.write(pages, path, time_col="at")
    got = warc.read(spark, path, payload=True).collect()
    assert sorted(r["id"] for r in got) == sorted([*range(40), 5]) and len({r["file"] for r in got}) >= 41 // 6
    for r in got:
        assert bytes(r["payload"]) == (b"" if r["type"] == "revisit" else html[r["id"]].encode())
        name = r["file"].split(":", 1)[1].replace("///", "/")
        content = open(name, "rb").read()
        (_, length, head, body), *more = warc.members(content[r["start"] : r["start"] + r["length"]])
        assert not more and length == r["length"] and body == bytes(r["payload"]) and gzip.decompress(content)
        assert head[b"WARC-Date"].decode() == f"1970-01-01T00:{r['id']:02d}:00Z"


def test_warc_histories_across_ranges(spark):
    pages = spark.createDataFrame([(i, "http://hot.org/" if i % 3 else f"http://h{i % 5}.org/x", f"p{i}") for i in range(90)], "page_id long, url string, html string").repartition(6)
    rows = warc.histories(warc.index(warc.archived(pages), per_range=8, runs=3)).orderBy("range", "position").collect()
    want = sorted((r["key"], r["date"], r["id"]) for r in rows)
    assert [(r["key"], r["date"], r["id"]) for r in rows] == want and len(want) == 90 and len({r["range"] for r in rows}) > 5
    assert [r["before"] for r in rows] == [want[i - 1][1] if i and want[i - 1][0] == want[i][0] else None for i in range(90)]
    assert warc.histories(warc.index(warc.archived(pages.limit(0)))).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(7)
    for k in range(8):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# ------------------------------------------------------------------ 9 language


def test_language_field_on_held_out_and_switched_text(spark):
    rng = random.Random(8)
    stems = {"aa": ["tion", "the", "ing", "and"], "bb": ["ung", "der", "sch", "keit"], "cc": ["ción", "los", "ando", "que"]}
    make = lambda lang: " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 120)))
    rows = [(lang, make(lang)) for _ in range(60) for lang in stems]
    field = language.fit(rows)
    held = [(lang, make(lang)) for _ in range(30) for lang in stems]
    got = language.predict(docs_of(spark, [t for _, t in held]), field, ["doc_id"]).collect()
    assert np.mean([r["lang_pred"] == held[r["doc_id"]][0] for r in got]) > 0.97
    mixed = " ".join([make("aa")] * 3 + [make("bb")] * 3)
    runs = language.word_runs(docs_of(spark, [mixed]), field).orderBy("first_word").collect()
    assert runs[0]["lang"] == "aa" and runs[-1]["lang"] == "bb" and sum(r["words"] for r in runs) == len(mixed.split())


def test_language_odd_rows(spark):
    field = language.fit([("aa", "the thing and"), ("bb", "der schung keit")] * 10)
    df = docs_of(spark, [*ODD, "123 … !"]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, field, ["doc_id"]).collect()}
    assert {i for i, v in got.items() if v == ("und", 0.0)} == {0, 1, 2, 9} and all(0 <= s <= 1 for _, s in got.values())
    assert {r["doc_id"] for r in language.accepted(df, field).collect()} >= {3, 7, 8} and language.accepted(df, field).columns == df.columns
    assert {r["lang_pred"] for r in language.predict(df, language.fit([]), ["doc_id"]).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(9)
    field = language.Field(["a", "b", "c"], [])
    field.moves, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    e = rng.normal(size=(150, 3))
    fresh = rng.random(150) < 0.1
    fresh[0] = True
    got = field.marginals(e, fresh)
    for a, b in zip(np.flatnonzero(fresh), [*np.flatnonzero(fresh)[1:], 150], strict=True):
        x, move = np.exp(e[a:b]), np.exp(field.moves)
        f, g = [np.exp(field.start) * x[0]], [np.ones(3)]
        for t in range(1, b - a):
            f.append((f[-1] @ move) * x[t])
        for t in range(b - a - 1, 0, -1):
            g.append(move @ (x[t] * g[-1]))
        p = np.array(f) * np.array(g[::-1])
        assert np.allclose(got[a:b], p / p.sum(1, keepdims=True))


# ------------------------------------------------------------------ 10 licences


def test_license_cosine_and_inheritance(spark):
    mit = "Released under the MIT License."
    files = [("r/LICENSE", mit), ("r/a/x.py", "alpha beta"), ("r/a/b/y.py", "some code " * 40 + "\nThis work is licensed under the GNU General Public License, version 3.\nmore"), ("r/a/b/z.py", None), ("q/w.py", "gamma"), (None, ""), ("r/c/COPYING", "Licensed under CC BY-NC 4.0."), ("r/c/d/e.py", "x"), ("r/a/x.py", "alpha beta")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["evidence"], r["from_dir"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "r"), 2: ("GPL-3.0", "own", None), 3: ("MIT", "inherited", "r"), 4: (None, None, None), 5: (None, None, None), 6: ("CC-BY-NC-4.0", "own", None), 7: ("CC-BY-NC-4.0", "inherited", "r/c"), 8: ("MIT", "inherited", "r")}
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_families_versions_and_negations(spark):
    from claimloom.llm.license_texts import TEMPLATES

    comment = lambda t: "\n".join(f" * {line}" for line in re.sub(r"(.{60}\S*) ", r"\1\n", t).split("\n"))
    header = "either version {0} of the License, or (at your option) any later version."
    gnu = "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, {1}\n\nFoo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    code = "\n\nint main() { return compute(alpha, beta) + gamma; }\n" * 5
    cases = [("AGPL-3.0", comment(gnu.format("Affero General Public License", header.format(3))) + code), ("GPL-2.0", comment(gnu.format("General Public License", header.format(2))) + code), ("GPL-3.0", comment(gnu.format("General Public License", header.format(3))) + code), ("LGPL-3.0", comment(gnu.format("Lesser General Public License", header.format(3))) + code)]
    cases += [(None, "This code is not released under the MIT License."), (None, "We never use the MIT licence here."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("MIT", "Released under the MIT License. It comes with no support.")]
    by_name = {}
    for name, text in TEMPLATES:
        by_name[name] = max(by_name.get(name, ""), text, key=len)
    cases += [(name, "Copyright (c) 2024 Some Body\n\n" + re.sub(r"(.{70}\S*) ", r"\1\n", text)) for name, text in sorted(by_name.items()) if len(text) > 150]
    df = spark.createDataFrame([(i, f"p{i}/x.c", t) for i, (_, t) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["candidates"], r["cosine"]) for r in licenses.scan(df).collect()}
    assert [(i, got[i]) for i, (name, _) in enumerate(cases) if got[i][0] != name] == []


def test_license_files_license_their_directories(spark):
    from claimloom.llm.license_texts import TEMPLATES

    texts = dict(TEMPLATES[::-1])
    full = {name: max((t for n, t in TEMPLATES if n == name), key=len) for name in texts}
    files = [("a/LICENSE", full["BSD-2-Clause"]), ("a/src/x.py", "import os"), ("a/src/deep/y.py", "import re"), ("b/COPYING", full["Apache-2.0"]), ("b/z.py", ""), ("c/notes.txt", full["ISC"]), ("c/w.py", "pass"), ("d/v.py", "pass")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["evidence"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("BSD-2-Clause", "own"), 1: ("BSD-2-Clause", "inherited"), 2: ("BSD-2-Clause", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"), 5: ("ISC", "own"), 6: ("ISC", "inherited"), 7: (None, None)}
    assert sum(e == "inherited" for _, e in got.values()) == 4


def test_license_cosine_by_brute_force(spark):
    """Cosines of whole texts and of their best segments, one word after another, with frequencies over all texts."""
    from collections import Counter
    from math import log, sqrt

    from claimloom.llm.license_texts import TEMPLATES

    rng = random.Random(11)
    templates = sorted(TEMPLATES)
    words = lambda t: [w.encode().lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]
    texts = [t for _, t in templates[::3]]
    texts += [" ".join(rng.sample(t.split(), max(1, len(t.split()) * 3 // 4))) + " foo bar é" for _, t in templates[1::3]]
    texts += [" ".join(rng.choices(WORDS, k=5_000)) + "\n\n" + templates[0][1] + "\n\n" + "x " * 50, "plain words", "", None]
    vocab = {w for _, t in templates for w in words(t)}
    df = Counter(w for t in texts for w in set(words(t or "")) & vocab)
    idf = lambda w: log((1 + len(texts)) / (1 + df[w])) + 1
    rarest = log(1 + len(texts)) + 1
    unit = []
    for _, t in templates:
        v = {w: n * idf(w) for w, n in Counter(words(t)).items()}
        size = sqrt(sum(x * x for x in v.values()))
        unit.append({w: x / size for w, x in v.items()})
    plain = [len(words(t)) <= licenses.SHORT and not set(w.decode() for w in words(t)) & set(licenses.NEGATIONS) for _, t in templates]

    def cosine(segment):
        held = words(segment)
        denied = bool({w.decode("utf-8", "replace") for w in held} & set(licenses.NEGATIONS))
        v = {w: n * idf(w) for w, n in Counter(w for w in held if w in vocab).items()}
        size = sqrt(sum(x * x for x in v.values()) + sum(w not in vocab for w in held) * rarest**2)
        return max((sum(x * u.get(w, 0) for w, x in v.items()) / size for u, p in zip(unit, plain, strict=True) if not (p and denied)), default=0) if v else 0

    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in licenses.detected(files, ["doc_id"]).collect():
        text = texts[r["doc_id"]] or ""
        pieces = [s for line in text.split("\n") for s in re.split(r"(?<=[.!?]) ", line)] + text.split("\n\n") + [text]
        # What can't reach LEAST isn't worked out.
        most, whole = max(map(cosine, pieces)), cosine(text)
        assert r["cosine"] == pytest.approx(most if most >= licenses.LEAST else 0, abs=1e-6), text[:80]
        assert r["whole"] == pytest.approx(whole, abs=1e-6) or whole < licenses.LEAST, text[:80]
