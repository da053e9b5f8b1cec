"""Operator 10: exact code lengths, held-out accuracy, edge rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF0001
from helpers import edge_rows, frame
from pyspark.sql import functions as F

import wayfarer.llm.queries as q
from wayfarer.llm.langid import ORDER, Trees, held_out, identify, keep_identified, train


def table(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


def plain_bits(train_texts, text):
    """PPM code length, byte by byte, from nested dictionaries."""
    counts = defaultdict(Counter)
    for t in train_texts:
        b = bytes(ORDER) + t.encode()
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1
    b, bits = bytes(ORDER) + text.encode(), 0.0
    for i in range(ORDER, len(b)):
        p = 1 / 256
        for k in range(ORDER + 1):
            c = counts.get(b[i - k : i])
            if c:
                total, kinds = sum(c.values()), len(c)
                p = c[b[i]] / (total + kinds) if c[b[i]] else kinds / (total + kinds) * p
        bits -= np.log2(p)
    return bits


def test_code_lengths_are_exact(spark):
    texts = ["the cat sat on the mat", "le chat est sur la table", "a théâtre"]
    docs = spark.createDataFrame([(i, t, "x" if i < 2 else "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trees = train(docs)
    for text in ["the mat", "zzz", "thé", "q"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = trees.text_bits(raw, np.array([0, len(raw)]))[0]
        assert got == pytest.approx([plain_bits(texts[:2], text), plain_bits(texts[2:], text)], rel=1e-5)


def test_held_out_accuracy(spark):
    got = q.QUERIES["op10_language_id"](spark, SF0001)
    rows = got.join(table(spark).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == table(spark).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows(spark):
    trees = train(table(spark).where(~held_out("doc_id")))
    got = identify(frame(spark, edge_rows()), trees).collect()
    assert len(got) == len(edge_rows())
    blank = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert {(r["lang_pred"], r["score"], r["bits_per_byte"]) for r in blank} == {("und", 0.0, None)}
    assert all(r["lang_pred"] in trees.langs for r in got if r["doc_id"] in (8, 9))
    assert identify(frame(spark, []), trees).collect() == []
    # nothing learned: everything is unknown
    assert train(frame(spark, [])) is None
    assert {r["lang_pred"] for r in identify(frame(spark, edge_rows()), None).collect()} == {"und"}
    no_label = frame(spark, [(1, "text", None), (2, None, "en")])
    assert train(no_label) is None


def test_stage_keeps_clean_documents(spark):
    docs = table(spark)
    junk = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("1234 5678 %%%").alias("text"), "lang", "source", "n_chars")
    kept = keep_identified(docs.unionByName(junk))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_empty_trees_shape():
    t = Trees(["a"], np.array([65], np.uint32), np.array([[1.0]])).freeze()
    assert t.text_bits(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [[0.0]]


def test_a_small_language_keeps_its_contexts(spark, monkeypatch):
    monkeypatch.setattr("wayfarer.llm.langid.MAX_NODES", 40, raising=False)  # a bound over all languages, if there is one
    big = [(k, f"the cat number {k} sat on the mat and ran", "big") for k in range(300)]
    small = [(1000 + k, "кот сидел на ковре и спал", "small") for k in range(3)]
    docs = spark.createDataFrame(big + small, "doc_id long, text string, lang string")
    trees = train(docs)
    assert trees.langs == ["big", "small"]
    for text, lang in (("кот спал", 1), ("the cat sat", 0)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert trees.text_bits(raw, np.array([0, len(raw)]))[0].argmin() == lang


def test_stage_drops_random_letters(spark):
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    words = noise(400).split()
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    # some training texts have noisy tails, so random letters cost under 7 bits a byte
    clean = [(k, " ".join(rng.choice(words, 80)) + ("" if held(k) or k % 4 else noise(1500)), "x") for k in range(300)]
    junk = [(-1 - k, noise(1000), None) for k in range(5)]
    kept = keep_identified(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sorted(x for x in kept if x < 0) == []
    assert {k for k, _, _ in clean if held(k) or k % 4} <= kept
