"""Order-aware aggregate helpers.

``first``/``collect_list`` depend on task order; every "first" here is the
value at the minimum arrival key, which is deterministic and partially
aggregatable (map-side combine), so a hot group never lands whole in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.text import strip


def seq_struct(order_cols) -> Column:
    return F.struct(*[F.col(c) for c in order_cols])


def first_non_null(col: str, seq: Column) -> Column:
    """Value of ``col`` at the minimum ``seq`` among rows where it is not NULL."""
    c = F.col(col)
    return F.min_by(c, F.when(c.isNotNull(), seq))


def first_non_empty(col: str, seq: Column) -> Column:
    """Stripped value at the minimum ``seq`` among rows where it is not blank."""
    s = strip(F.col(col))
    return F.min_by(s, F.when(s != "", seq))


def round_half_even_1(x: Column) -> Column:
    """One-decimal rounding rule (trap T4): prepare the binary value, then half-even."""
    return F.bround(F.round(x, 9), 1)


def first_distinct(
    df: DataFrame,
    keys: list[str],
    col: str,
    order_cols: list[str],
    n: int,
    sep: str | None = "\n\n",
    out: str | None = None,
) -> DataFrame:
    """First ``n`` distinct (stripped, non-NULL) values per group in arrival order, joined by ``sep``.

    Plan: distinct (key, value) with its first arrival (partial aggregate), then a
    ``row_number() <= n`` window, which Spark turns into a WindowGroupLimit that
    runs before the shuffle, so at most ``n`` rows per group per task move.
    """
    out = out or col
    seq = seq_struct(order_cols)
    d = (
        df.where(F.col(col).isNotNull())
        .select(*keys, strip(F.col(col)).alias("_v"), seq.alias("_s"))
        .groupBy(*keys, "_v")
        .agg(F.min("_s").alias("_s"))
    )
    w = Window.partitionBy(*keys).orderBy("_s")
    top = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("_s", "_v"))), lambda x: x["_v"])
    return top.groupBy(*keys).agg((F.array_join(arr, sep) if sep is not None else arr).alias(out))
