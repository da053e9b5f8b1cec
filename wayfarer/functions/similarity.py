"""Exact string similarity (H3, H4) as Spark expressions.

ratio(a, b) = 200 * LCS(a, b) / (|a| + |b|)   (indel similarity, 0-100)

The source compares the *rounded* integer ratio (half-even), so
``ratio > 90``  <=>  400*LCS >  181*(|a|+|b|)   (names)
``ratio > 85``  <=>  400*LCS >= 171*(|a|+|b|)   (descriptions)
which we evaluate in exact integer arithmetic.

Two LCS implementations (``functions/lcs.py`` decides many pairs at once):
* ``lcs_expr``: pure SQL higher-order functions (JVM-side, for short strings);
* ``lcs_udf``: Arrow-batched pandas UDF with the bit-parallel LCS recurrence
  on Python integers (long texts), O(|a| * |b| / 64) word operations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_sort_key(x, ascii_compat: bool = True) -> Column:
    """H4 preprocessing: (drop code points 128-255 when ``ascii_compat``), lower,
    non-alphanumerics -> space, split on whitespace, sort tokens, join by one space."""
    s = _c(x)
    if ascii_compat:
        s = F.regexp_replace(s, "[\\x{80}-\\x{FF}]", "")
    s = F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}]", " ")
    toks = F.filter(F.split(s, "\\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(toks), " ")


def lcs_expr(a, b) -> Column:
    """LCS length with SQL higher-order functions (row-by-row DP on arrays)."""
    a, b = _c(a), _c(b)
    sa, sb = F.split(a, ""), F.split(b, "")
    lb = F.length(b)

    def row(prev, ch):
        def step(acc, j):
            hit = F.element_at(sb, j) == ch
            val = F.when(hit, F.element_at(prev, j) + 1).otherwise(
                F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1))
            )
            return F.concat(acc, F.array(val))

        return F.aggregate(F.sequence(F.lit(1), lb), F.array(F.lit(0)), step)

    dp = F.aggregate(sa, F.array_repeat(F.lit(0), lb + 1), row)
    return F.when((F.length(a) == 0) | (lb == 0), F.lit(0)).otherwise(F.element_at(dp, -1))


def lcs_len(a: str, b: str) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro recurrence)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_len(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def ratio_from_lcs(lcs, la, lb) -> Column:
    """Integer ratio as the source reports it (half-even rounding)."""
    return F.when((la + lb) == 0, F.lit(0)).otherwise(F.bround(F.lit(200.0) * lcs / (la + lb), 0).cast("int"))
