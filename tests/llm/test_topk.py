"""Operator 4 against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfarer.llm import topk
from wayfarer.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v int, qid int, cid int, dim int, query int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5, 6) for i, v in rows], SCHEMA)


def brute(df, k):
    rows = set()
    for r in df.collect():
        i, v = r["vec_id"], r["embedding"]
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.add((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    unit = lambda: [rng.gauss(0, 0.2) for _ in range(12)]
    rows = [(i, unit()) for i in range(400)]
    centre = unit()
    rows += [(400 + i, [x + rng.gauss(0, 0.01) for x in centre]) for i in range(150)]  # a dense cluster
    rows += [(1000 + i, rows[100][1]) for i in range(120)]  # one vector many times: ties
    rows += [(2000, [9.0, -9.0] * 6), (2050, [-20.0, 20.0] * 6)]  # beyond one byte
    rows += [(3000, [0.5, 0.25]), (3050, [0.1, 0.2])]  # another length
    rows += [(4000, None), (4050, [None] + [0.1] * 11), (4100, [float("nan")] * 12), (4150, [float("inf")] * 12), (None, unit()), (4200, [])]
    return rows + rows[:3]


def answer(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("chunk", "block"), [(16384, 2048), (64, 4)])
def test_exact(spark, monkeypatch, chunk, block):
    """One tile, and many tiles."""
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    df = frame(spark, corpus())
    assert answer(top_k(df, F.col("vec_id") % 50 == 0, 5)) == brute(df, 5)


def test_fewer_candidates_and_empty_table(spark):
    df = frame(spark, [(0, [0.5, 0.5]), (1, [0.1, 0.2]), (50, [0.0, -0.3])])
    assert answer(top_k(df, F.col("vec_id") % 50 == 0, 5)) == brute(df, 5)
    assert top_k(frame(spark, []), F.col("vec_id") % 50 == 0, 5).collect() == []
