"""Operator 13 against numpy's own eigensolver and exact integer sums."""

import math

import numpy as np
import pytest

from wayfarer.llm.queries import QUERIES
from wayfarer.llm.whitening import eigenvalues_below, leading_eigenpairs, tridiagonal, whitened

SF0001 = "/root/testdata/sf0.001"


def checked(a, k):
    values, vectors = leading_eigenpairs(a, k)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    scale = max(1.0, abs(want[0]))
    assert np.allclose(values, want, rtol=0, atol=1e-12 * scale)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * scale


@pytest.mark.parametrize("d", [1, 2, 3, 5, 17, 64, 130])
def test_eigenpairs_of_random_matrices(d):
    x = np.random.default_rng(d).normal(size=(3 * d, d)) * np.linspace(1, 9, d)
    checked(np.cov(x.T, bias=True).reshape(d, d), 8)


def test_equal_and_close_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(20, 20)))[0]
    for values in ([5.0] * 6 + [1.0] * 14, [5 + i * 1e-9 for i in range(20)], [3.0, 3.0, 2.0] + [0.0] * 17, [7.0] * 20):
        checked(q @ np.diag(values) @ q.T, 8)
    checked(np.eye(9), 8)  # already diagonal: every off-diagonal entry is 0
    checked(np.diag([4.0, 4.0, 4.0, 1.0, 9.0]), 8)


def test_sturm_count():
    a = np.random.default_rng(2).normal(size=(12, 12))
    a = a + a.T
    diag, off, _ = tridiagonal(a)
    want = np.linalg.eigvalsh(a)
    at = np.linspace(want[0] - 1, want[-1] + 1, 40)
    assert list(eigenvalues_below(diag, off, at)) == [int((want < t).sum()) for t in at]


def brute(rows, k):
    """rows of (id, x); {(id, component): (deviation, |whitened|)}, explained."""
    x = np.array([r[1] for r in rows], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for (i, row), c in zip(rows, centred):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        out += [(i, j + 1, deviation, abs(float(c @ v[:, j])) / math.sqrt(e[j])) for j in range(min(k, len(e)))]
    return out, e / e.sum()


def compare(got, rows, k=8):
    want, share = brute(rows, k)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (r["vec_id"], r["component"], r["deviation"])), sorted(want)):
        assert (g["vec_id"], g["component"], int(g["deviation"])) == w[:3]
        assert abs(abs(g["whitened"]) - w[3]) < 1e-8 and g["n"] == len(rows)
        assert abs(g["explained"] / share[g["component"] - 1] - 1) < 1e-9
        assert 0 <= g["identity_error"] < 1e-9


def to_x(v):
    return [math.floor(1024 * float(c)) + 100_000 for c in v]


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()
    got = QUERIES["op13_embedding_whitening"](spark, SF0001)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    compare(got.collect(), [(r["vec_id"], to_x(r["embedding"])) for r in table])


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("id", "v", "n", "component", "deviation", "w", "i"):
        df = df.selectExpr("*", f"7 as {c}")
    return df


def test_edge_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=3)]) for i in range(30)]
    good += [(5, good[5][1]), (5, good[5][1])]  # repeated rows count
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [0.0, float("inf"), 0.0]), (95, [1.0, 2.0])]
    bad += [(96, [3e38, 0.0, 0.0])]
    got = whitened(frame(spark, [(*r, 0) for r in good + bad])).collect()
    compare(got, [(i, to_x(v)) for i, v in good])


def test_null_ids_constant_vectors_and_empty_table(spark):
    got = whitened(frame(spark, [(None, [1.0, 2.0], 0), (2, [2.0, 2.0], 0)])).collect()
    assert sorted((str(r["vec_id"]), r["component"], round(abs(r["whitened"]), 9)) for r in got) == [("2", 1, 1.0), ("None", 1, 1.0)]
    assert whitened(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    assert whitened(frame(spark, [])).collect() == []
    assert whitened(frame(spark, [(1, None, 0)])).collect() == []


def test_wide_entries_stay_exact(spark):
    rows = [(i, [float(np.float32(2.0 ** (30 + i % 7) * (i % 5 - 2))), float(i)]) for i in range(40)]
    got = whitened(frame(spark, [(*r, 0) for r in rows])).collect()
    x = [to_x(v) for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want
