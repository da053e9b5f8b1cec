"""Whitening of embeddings by the leading components of their covariance.

Vectors become integers (``x = floor(scale * c) + shift``), so their sums are
exact and independent of how rows are dealt out.  Each task sums its own rows:
first the per-dimension sums, then the products of the rows centred on the
rounded mean, which are whole numbers too; the remaining fraction of the mean
is subtracted as a rank-one term.  The driver holds one matrix of dimension x
dimension, however many rows there are, and finds the leading eigenpairs:

1. Householder reflections make the covariance tridiagonal;
2. bisection on Sturm counts finds each leading eigenvalue;
3. inverse iteration finds its vector; vectors of eigenvalues that lie close
   together are orthogonalised again in every step;
4. the reflections, applied backwards, turn them into components.

The components travel to the tasks with the projecting function (components x
dimension numbers); rows never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(np.float64).eps
CLOSE = 1e-3  # of the matrix norm: eigenvalues that share a cluster
SAFE = 1 << 62
DIGITS = 10**38


@dataclass
class Whitening:
    """``n`` fitted vectors, their ``sums`` by dimension (Python ints), the
    leading unit ``components`` (rows), ``eigenvalues`` and the ``trace``."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


# ------------------------------------------------------------- eigenproblem

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix: reflector i
    is a unit vector that acts on dimensions i + 1 and up."""
    a = np.array(a, np.float64)
    reflectors = []
    for i in range(len(a) - 2):
        v = a[i + 1 :, i].copy()
        norm = np.linalg.norm(v)
        v[0] += norm if v[0] >= 0 else -norm
        size = np.linalg.norm(v)
        v = v / size if size else v
        reflectors.append(v)
        rest = a[i + 1 :, i + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[i + 1 :, i] -= 2 * v * (v @ a[i + 1 :, i])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def reflected_back(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (rows) of the tridiagonal matrix -> of the original one."""
    out = vectors.copy()
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        out[:, i + 1 :] -= 2 * np.outer(out[:, i + 1 :] @ v, v)
    return out


def eigenvalues_below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each point of ``at``."""
    tiny = np.finfo(np.float64).tiny / EPS
    q = diag[0] - at
    count = (q < 0).astype(np.int64)
    for d, e2 in zip(diag[1:], off**2):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        with np.errstate(over="ignore"):  # an infinite ratio has the right sign
            q = d - at - e2 / q
        count += q < 0
    return count


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection."""
    n = len(diag)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    bound = max(np.abs(diag - reach).max(), np.abs(diag + reach).max()) * (1 + 4 * EPS * n)
    low, high = np.full(k, -bound), np.full(k, bound)
    index = n - 1 - np.arange(k)  # of the rising order
    for _ in range(200):
        mid = (low + high) / 2
        above = eigenvalues_below(diag, off, mid) <= index
        low, high = np.where(above, mid, low), np.where(above, high, mid)
        if np.all(high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, at: float, b: np.ndarray, least: float) -> np.ndarray:
    """x of (T - at) x = b by elimination with row exchanges; vanishing pivots
    become ``least``."""
    n = len(diag)
    main, up, up2, x = diag - at, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(main[i]):
            main[i], low = low, main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if main[i] == 0:
            main[i] = least
        factor = low / main[i]
        main[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < least:
            main[i] = least if main[i] >= 0 else -least
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / main[i]
        if abs(x[i]) > 1e150:  # only the direction counts
            x /= abs(x[i])
    return x


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of falling ``values``."""
    n, rng = len(diag), np.random.Generator(np.random.PCG64(7))
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0))
    out, cluster, shift = [], 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * norm:
            cluster = k
        shift = min(value, shift - 4 * EPS * norm)  # equal values get shifts of their own
        x = rng.standard_normal(n)
        for _ in range(6):
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x), EPS * norm or EPS)
            for _ in range(2):
                for y in out[cluster:k]:
                    x = x / np.linalg.norm(x)
                    x = x - (x @ y) * y
        out.append(x / np.linalg.norm(x))
    return np.array(out)


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows), falling; only those that are
    positive beyond rounding, at most ``k``.  Each vector's largest entry (the
    first of equals) is positive."""
    diag, off, reflectors = tridiagonal(a)
    values = leading_eigenvalues(diag, off, min(k, len(a)))
    values = values[values > len(a) * EPS * max(values[0], 0)]
    if not len(values):
        return values, np.zeros((0, len(a)))
    vectors = reflected_back(inverse_iteration(diag, off, values), reflectors)
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return values, vectors * np.sign(largest)[:, None]


# ------------------------------------------------------------------- on rows

def usable(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows whose vector holds entries, all of them finite, whose scaled value
    is a long."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    # NaN sorts above every number, so it fails the comparison too
    good = (F.size(vector_col) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < 2.0**62, F.lit(False)))
    return vectors.where(F.col(vector_col).isNotNull() & F.coalesce(good, F.lit(False)))


def whole_numbers(col: pa.Array, d: int, scale: int, shift: int) -> np.ndarray:
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(flat * scale).astype(np.int64) + shift


def _within(x: np.ndarray, factor: int, plus: int = 0) -> bool:
    """No product of an entry and ``factor``, with ``plus``, leaves a long."""
    return not x.size or max(abs(int(x.max())), abs(int(x.min()))) * factor + plus < SAFE


def _summed(x: np.ndarray) -> list[int]:
    if _within(x, len(x)):
        return [int(s) for s in x.sum(axis=0)]
    return [sum(int(e) for e in column) for column in x.T]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly."""
    if _within(x, n, max(map(abs, sums))):
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _added(partial: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (i, array) rows by i; the result has one row per i and place."""
    got = partial.selectExpr("i", "posexplode(v) AS (j, s)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, dict[int, float]] = {}
    for i, j, s in got:
        out.setdefault(i, {})[j] = s
    return {i: np.array([row[j] for j in range(len(row))]) for i, row in out.items()}


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Fit on all usable vectors of the most frequent length (the longer of
    equals); None if there is none."""
    rows = usable(vectors, vector_col, scale).select(F.col(vector_col).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == d)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            total = [a + b for a, b in zip(total, _summed(whole_numbers(batch.column(0), d, scale, shift)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], ["i", "s"]
        )

    got = rows.mapInArrow(totals, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [int(s) for _, s in sorted((r["i"], r["s"]) for r in got)]
    middle = [round(Decimal(s) / n) for s in sums]
    left = np.array([s - n * m for s, m in zip(sums, middle)], np.float64) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            z = (whole_numbers(batch.column(0), d, scale, shift) - np.array(middle, np.int64)).astype(np.float64)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"]
        )

    got = _added(rows.mapInArrow(products, "i int, v array<double>"))
    covariance = np.array([got[i] for i in range(d)]) / n - np.outer(left, left)
    values, components = leading_eigenpairs((covariance + covariance.T) / 2, k)
    return Whitening(n, sums, components, values, float(np.trace(covariance)))


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums, whitened coordinates)."""
    y = _centred(x, model.n, model.sums)
    return y, (y.astype(np.float64) / model.n) @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    d, k = len(model.sums), len(model.eigenvalues)
    rows = usable(vectors, vector_col, scale).where(F.size(vector_col) == d).select(vector_col)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _projected(whole_numbers(batch.column(0), d, scale, shift), model)[1]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"]
        )

    got = _added(rows.mapInArrow(moments, "i int, v array<double>"))
    mean = got[k] / model.n
    covariance = np.array([got[i] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(
    vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000
) -> DataFrame:
    """One row per usable vector and component: id, component (from 1),
    deviation decimal(38,0) (sum of (n*x - sums)^2, null beyond 38 digits) and
    whitened double.  No row moves."""
    d, k = len(model.sums), len(model.eigenvalues)
    rows = usable(vectors, vector_col, scale).where(F.size(vector_col) == d)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, w = _projected(whole_numbers(batch.column(1), d, scale, shift), model)
            exact = y if y.dtype != object and _within(y, d * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))) else y.astype(object)
            squares = [None if s >= DIGITS else Decimal(s) for s in map(int, (exact * exact).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(squares, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))],
                ["id", "deviation", "w"],
            )

    out = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(
        project, f"id {id_type}, deviation decimal(38,0), w array<double>"
    )
    return out.select(
        F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("component", "whitened")
    ).withColumn("component", F.col("component") + 1)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """Fit on ``vectors`` and whiten them: the columns of ``whiten`` with n,
    explained and identity_error.

    Defined cases: vectors that are null, empty, or hold a null or non-finite
    entry (or one beyond 2^62 when scaled) take no part, nor do vectors of
    another length than the most frequent one; null ids stay null; repeated
    rows count and come out each time; components without variance are left
    out, so constant vectors and an empty table give no rows; other columns
    are ignored.
    """
    model = fit(vectors, vector_col, k)
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), "
    schema += "whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, vector_col)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return whiten(vectors, model, id_col, vector_col).select(
        id_col,
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
