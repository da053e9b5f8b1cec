"""Exact top-k search by inner product over vector-approximation files.

Every distinct vector has an approximation: one byte per component, the cell
of width ``CELL`` that holds it.  Blocks of queries scan chunks of
approximations for bounds of the score; a chunk passes on what may still be
among the best.  Exact vectors are then read in bound order: first the
``FIRST_READS`` best-bounded of each query, whose k-th score decides which of
the others can matter; those are read too, and the result is certain.

Scale: query blocks meet candidate chunks in tiles of bounded size, each one
group (a stated query set against all rows).  Equal vectors are one class with
its smallest ids, so a vector that a third of all rows hold costs one
comparison and cannot flood the candidates with ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import staged

CELL = 4
QUERY_BLOCK = 2048
CHUNK = 16384
SUB_BLOCK = 128
FIRST_READS = 16


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * component) of every usable vector.  Null ids,
    null vectors and vectors with a null or non-finite component take no part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.where(ok).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")
    )


def approximation(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.floor_divide(np.asarray(x, np.int64), CELL).clip(-128, 127).astype(np.int8).tobytes())


def is_wide(v: str) -> Column:
    """A component lies beyond the cells of one byte: no bound is known."""
    return F.exists(v, lambda x: (x < -127 * CELL) | (x >= 127 * CELL))


def scan_tile(k: int):
    """Bounds of all scores of a query block in a chunk; gives the pairs whose
    upper bound reaches the k-th best lower bound of the query."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        queries, chunk = t[t["cells"].isna()], t[t["cells"].notna()]
        none = pd.DataFrame(np.zeros((0, 4)), columns=["qid", "cid", "lower", "upper"]).astype({"qid": object, "cid": object})
        if not len(queries) or not len(chunk):
            return none
        q = np.stack(queries["v"].to_numpy()).astype(np.float64)
        cells = np.frombuffer(b"".join(chunk["cells"]), np.int8).reshape(len(chunk), -1).astype(np.float64)
        low = (cells * CELL).T
        wide = chunk["wide"].to_numpy(bool)
        parts = []
        for at in range(0, len(q), SUB_BLOCK):
            block = q[at : at + SUB_BLOCK]
            # a component lies in [low, low + CELL - 1]
            base = block @ low
            up = (CELL - 1) * np.maximum(block, 0).sum(axis=1, keepdims=True)
            down = (CELL - 1) * np.minimum(block, 0).sum(axis=1, keepdims=True)
            lower, upper = base + down, base + up
            lower[:, wide], upper[:, wide] = -np.inf, np.inf
            kth = np.partition(lower, -k, axis=1)[:, -k][:, None] if lower.shape[1] >= k else -np.inf
            i, j = np.nonzero(upper >= kth)
            parts.append(
                pd.DataFrame(
                    {
                        "qid": queries["name"].to_numpy()[at + i],
                        "cid": chunk["name"].to_numpy()[j],
                        "lower": lower[i, j],
                        "upper": upper[i, j],
                    }
                )
            )
        return pd.concat(parts) if parts else none

    return run


def inner_product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row but
    its own, by score, ties to the smaller id.

    ``is_query`` is a condition on ``id_col``.  Defined cases: vectors are
    compared with vectors of the same length only; rows with a query's id are
    its own, and rows that repeat both id and vector count once; with fewer
    than k candidates all are returned; an empty table gives no rows; other
    columns are ignored.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale).distinct()
    named = rows.withColumnRenamed("id", id_col).withColumn("query", is_query)
    rows = staged(named.withColumnRenamed(id_col, "id"), "topk-vectors")
    # classes of equal vectors with the k + 1 smallest ids (one may be the query's own)
    first = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    cid = F.concat_ws(":", F.element_at("ids", 1), F.xxhash64("v"))
    classes = staged(classes.withColumn("cid", cid).withColumn("dim", F.size("v")), "topk-classes")
    queries = rows.where("query").select("v").distinct().join(classes.select("v", F.col("cid").alias("qid"), "dim"), "v")
    queries = staged(queries, "topk-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    chunks = max(1, -(-classes.count() // CHUNK))

    cells = F.pandas_udf(approximation, "binary")
    near = classes.select(
        F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
        "dim", F.col("cid").alias("name"), F.lit(None).cast("array<long>").alias("v"), cells("v").alias("cells"), is_wide("v").alias("wide"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"),
        F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("b"),
        "dim", F.col("qid").alias("name"), "v", F.lit(None).cast("binary").alias("cells"), F.lit(False).alias("wide"),
    )
    found = (
        near.unionByName(asked)
        .groupBy("b", "c", "dim")
        .applyInPandas(scan_tile(k + 1), "qid string, cid string, lower double, upper double")
    )
    found = staged(found, "topk-bounds")
    by_lower, by_upper = (Window.partitionBy("qid").orderBy(F.desc(c), "cid") for c in ("lower", "upper"))
    floor = (
        found.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") <= k + 1)
        .groupBy("qid").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("m"))
        .select("qid", F.when(F.col("m") > k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))
    )
    alive = found.join(floor, "qid").where("upper >= floor").select("qid", "cid", "upper")
    ordered = staged(alive.withColumn("n", F.row_number().over(by_upper)), "topk-candidates")

    def read(pairs: DataFrame) -> DataFrame:
        """Exact scores, one row per id of the class."""
        exact = pairs.join(classes.select("cid", "ids", "v"), "cid").join(queries.select("qid", F.col("v").alias("qv")), "qid")
        return exact.select("qid", F.explode("ids").alias("vec_id"), inner_product("qv", "v").alias("score"))

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = lambda scored: scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    read_first = staged(top(read(ordered.where(F.col("n") <= FIRST_READS))), "topk-first")
    certain = read_first.where(F.col("n") == k + 1).select("qid", F.col("score").alias("kth"))
    others = ordered.where(F.col("n") > FIRST_READS).join(certain, "qid", "left").where("kth is null or upper >= kth")
    result = top(read_first.drop("n").unionByName(read(others.select("qid", "cid"))))
    # each query row of the class, without its own id
    asking = rows.where("query").select(F.col("id").alias("query_id"), "v").join(queries.select("v", "qid"), "v").drop("v")
    own = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    return (
        asking.join(result.drop("n"), "qid")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
