"""Positions within groups without sorting a whole group in one task.

Rows are range-partitioned by (group, order), sorted, numbered within the part
of their group that lies in their partition and written once, so a group that
holds a third of all rows lies in many neighbouring partitions.  Only the
first group of a partition can have rows in earlier ones: a table of one row
per partition holds how many, and is broadcast.  So a row is shuffled once,
and of the rows only the keys reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.session import shared_path


def _runs(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Index of each row in its run of equal values, through all batches."""
    last, count = None, 0  # the run that the last batch ended in
    for g in groups:
        n = len(g)
        if not n:
            yield pd.Series([], dtype="int64")
            continue
        values = g.to_numpy(dtype=object)
        new = np.append(values[0] != last, values[1:] != values[:-1])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        index = np.where(start < 0, at + count, at - start)
        last, count = values[-1], int(index[-1]) + 1
        yield pd.Series(index.astype("int64"))


def segmented_positions(df: DataFrame, keys: list[str], order_cols: list, out: str) -> DataFrame:
    """``df`` with ``out``: the position (from 1, long) of each row in
    ``order_cols`` order among the rows of its ``keys``.

    Null keys are a group of their own.  Rows that tie in all ``order_cols``
    get different positions, in no stated order.
    """
    spark = df.sparkSession
    order = [*keys, *order_cols]
    taken = {c.lower() for c in df.columns} | {out.lower()}
    at, index, segment, ahead = (next(f"{'_' * i}{n}" for i in range(1, 99) if f"{'_' * i}{n}" not in taken) for n in ("at", "index", "segment", "ahead"))
    group = F.to_json(F.struct(*keys))
    # a partition's rows pass in order; not deterministic, so that it stays above the sort
    index_in_run = F.pandas_udf(_runs, "long").asNondeterministic()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn(index, index_in_run(group)).withColumn(at, F.monotonically_increasing_id())
    path = shared_path(spark, "positions")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path).withColumn(segment, F.shiftright(at, 33))
    # what each partition begins and ends with
    ends = rows.groupBy(segment).agg(
        F.to_json(F.min_by(F.struct(*keys), at)).alias("first"),
        F.to_json(F.max_by(F.struct(*keys), at)).alias("last"),
        (F.max_by(index, at) + 1).alias("n"),
    )
    begins = ends.select(segment, F.col("first").alias("g"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"))
    before = Window.partitionBy("g").orderBy(segment, "k").rowsBetween(Window.unboundedPreceding, -1)
    steps = begins.unionByName(ends.select(segment, F.col("last").alias("g"), F.lit(1).alias("k"), "n"))
    offset = steps.withColumn(ahead, F.sum("n").over(before)).where(F.col("k") == 0).select(segment, ahead)
    placed = rows.drop(*[c for c in rows.columns if c.lower() == out.lower()]).join(F.broadcast(offset.where(F.col(ahead) > 0)), segment, "left")
    in_first = F.col(at) - F.shiftleft(segment, 33) == F.col(index)
    position = F.col(index) + 1 + F.when(in_first, F.coalesce(ahead, F.lit(0))).otherwise(F.lit(0))
    return placed.withColumn(out, position).select(*[c for c in df.columns if c != out], out)
