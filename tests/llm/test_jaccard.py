"""Operator 8 against all pairs of sets."""

import random

import numpy as np
import pytest
from helpers import edge_rows, frame, prose
from pyspark.sql import functions as F

from wayfarer.llm import jaccard
from wayfarer.llm.common import components
from wayfarer.llm.jaccard import jaccard_components, one_of_each


def sets_of(rows, n):
    out = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        out[k] = (i, grams)
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in sets.items():
        for y, (j, b) in sets.items():
            if x < y and a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    low = {}
    for k, (i, _) in sets.items():
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(g), low[find(k)] if i is not None else None) for k, (i, g) in sets.items()), key=repr)


def near_copies(seed, base, copies, first_id):
    rng = random.Random(seed)
    words = base.split()
    out = [(first_id, base)]
    for k in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["xx" + str(rng.randrange(99))], [], [w[at], "yy" + str(rng.randrange(99))]])
        out.append((first_id + 1 + k, " ".join(w)))
    return out


def corpus():
    rows = []
    for s in range(6):
        rows += near_copies(s, prose(s, 40 + 60 * s), 14, 100 * s + 20)
    shared = prose(77, 60)
    rows += [(1000 + s, shared + " " + prose(500 + s, 12)) for s in range(25)]  # one passage in many
    rows += [(2000 + s, prose(900 + s, s % 9, "abc")) for s in range(40)]  # short
    return rows + edge_rows()


def answer(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_equal_all_pairs(spark, n, percent):
    rows = corpus()
    assert answer(jaccard_components(frame(spark, rows), shingle=n, percent=percent)) == brute(rows, n, percent)


def test_tiles_larger_than_a_block(spark, monkeypatch):
    """Blocks of three members: tiles go through the block pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = corpus()
    assert answer(jaccard_components(frame(spark, rows), shingle=3, percent=70)) == brute(rows, 3, 70)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 600, rng.integers(0, 400)).astype(np.uint64)) for _ in range(2))
        signs = jaccard.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        differ = int(np.bitwise_count((signs[0] ^ signs[1]).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and differ % 2 == len(np.setxor1d(a, b)) % 2


def test_parity_rules_out_no_link(spark):
    """The condition on rows against the exact sets, at and around the threshold."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        a = rng.choice(5000, rng.integers(1, 300), replace=False).astype(np.uint64)
        b = np.concatenate([rng.choice(a, int(len(a) * rng.uniform(0.8, 1)), replace=False), rng.integers(9000, 9999, rng.integers(0, 40)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b):
            continue
        signs = jaccard.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).tolist()
        shared = len(np.intersect1d(a, b))
        rows.append(((len(a), *signs[0]), (len(b), *signs[1]), 100 * shared >= 90 * (len(a) + len(b) - shared)))
    side = "struct<size: int, q0: long, q1: long, q2: long, q3: long>"
    df = spark.createDataFrame(rows, f"x {side}, y {side}, links boolean").withColumn("may", jaccard.parity_allows("x", "y", 90))
    got = df.groupBy("links", "may").count().collect()
    found = {(r["links"], r["may"]): r["count"] for r in got}
    assert (True, False) not in found and found[True, True] > 20 and found[False, False] > 50


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [])).collect() == []


def test_one_of_each_keeps_clean_documents(spark):
    rows = corpus()
    df = frame(spark, rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    want = [(i, c) for i, _, c in brute(rows, 5, 80)]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, c in want if i == c), key=repr)


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)}
    assert components(links.where("a < 0")).collect() == []


def test_slices_bound_the_memory_of_a_batch():
    """A slice of 1 MB of texts took some 40 MB of arrays."""
    import tracemalloc

    import pyarrow as pa

    from wayfarer.llm.common import text_slices

    texts = pa.array([" ".join(f"w{i * j % 977}" for j in range(400)) for i in range(2000)])
    tracemalloc.start()
    try:
        sizes = [len(jaccard.shingle_sets(raw, offs, 5)[1]) - 1 for _, raw, offs in text_slices(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == len(texts) and peak < 20 << 20
