"""The corpus pipeline end to end on small tables, and every registered operator query on the smallest given ones."""

import os
import random

import pytest

import corpus_pipeline
from claimloom.llm import registry

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the and with from have this that there which would about people other water first".split(), "der und mit von haben dieses dass dort welche würde über leute andere wasser zuerst".split()


def tables(spark, path, docs, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    rng = random.Random(5)
    docs = []
    for i in range(80):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        text = prose(rng, [f"{w}{k}" if rng.random() < 0.3 else w for w in words for k in "abcdefgh"], 60)
        docs.append((i, text, lang, "s", len(text)))
    item = "seventeen quiet painters carried eleven yellow ladders across the frozen market square before anybody noticed"
    docs += [(100, docs[3][1], "en", "s", 1), (101, docs[3][1] + " more", "en", "s", 1)]  # an exact and a near copy
    docs += [(102, prose(rng, EN, 20) + " " + item + " " + prose(rng, EN, 20), "en", "s", 1)]
    docs += [(103, prose(rng, EN, 15) + " write to joe.doe@example.org or +1 555 123 4567 then " + prose(rng, EN, 15), "en", "s", 1)]
    docs += [(104, None, None, None, None), (105, "", "en", "s", 0), (106, "12345 ... !!", "en", "s", 12), (None, prose(rng, EN, 30), "en", "s", 1), (7, docs[7][1], "en", "s", 1)]
    at = tables(spark, tmp_path / "t", docs, [(1, item), (2, None)])
    out = corpus_pipeline.run(spark, at).toPandas()
    kept = set(out.doc_id.dropna().astype(int))
    assert kept == {*range(80), 103} and len(out[out["start"] == 0]) == len(kept) + 1  # and the row without an id
    rows = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, at)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    cleaned = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert "<EMAIL>" in cleaned[103] and "<PHONE>" in cleaned[103] and "@" not in cleaned[103] and cleaned[5] == docs[5][1]


def test_pipeline_of_empty_tables_and_of_nothing_kept(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [], [])).count() == 0
    junk = [(i, t, "en", "s", 1) for i, t in enumerate(["...", "1 2 3", None, ""])]
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", junk, [(1, "alpha beta")])).count() == 0


NEEDED = {
    "op1": ("query_id", "rank", "vec_id", "score"), "op2": ("doc_id", "held_out", "score", "predicted"), "op3": ("doc_id", "n_shingles", "component_id", "kept"),
    "op4": ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "op5": ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), "op6": ("doc_id", "item_id"),
    "op7": ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"), "op8": ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "op9": ("doc_id", "held_out", "lang_pred", "score"), "op10": ("doc_id", "license"),
    "op11": ("page_id", "host", "path", "rule", "verdict"), "op12": ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"),
    "op13": ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"),
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_registered_query(spark, name):
    out = registry.QUERIES[name](spark, DIR)
    op = name.split("_")[0]
    assert set(NEEDED[op]) <= set(out.columns)
    got = out.toPandas()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    if op in ("op2", "op3", "op7", "op9", "op10"):
        assert sorted(got.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect())
    if op == "op1":
        assert set(got.groupby("query_id")["rank"].max()) == {10} and (got.query_id != got.vec_id).all()
    if op == "op2":
        assert got.score.between(0, 1).all() and ((got.score >= 0.7).astype(int) == got.predicted).all()
    if op == "op3":
        assert ((got.doc_id == got.component_id) == got.kept).all() and (got.component_id <= got.doc_id).all()
    if op == "op4":
        assert (got.groupby("sequence_id").length.sum() <= 1024).all() and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    if op == "op5":
        assert len(got) == spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id").distinct().count() + 1 and (got.status == "ok").all()
    if op == "op7":
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert all(int(end) <= len(texts[r.doc_id]) for r in got.itertuples() if r.spans for _, _, end in (s.split(":") for s in r.spans.split(",")))
    if op == "op8":
        pages = {r["page_id"]: len((r["html"] or "").encode()) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
        assert dict(zip(got.page_id, got.payload_bytes, strict=True)) == pages
        order = got.sort_values(["key_range", "position"])
        assert list(zip(order.url_key, order.captured, strict=True)) == sorted(zip(got.url_key, got.captured, strict=True))
    if op == "op9":
        truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
        held = got[got.held_out]
        assert (held.lang_pred == held.doc_id.map(truth))[held.doc_id.map(truth).notna() & (held.lang_pred != "und")].mean() > 0.9


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from claimloom.llm import common

    class Bare:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("K", (), {"get": staticmethod(lambda *_: None)}))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Bare())
