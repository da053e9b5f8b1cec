"""Summaries: one row per place."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.aggs import first_distinct, first_non_empty, first_non_null, seq_struct
from wayfarer.schemas import CATEGORIES

KEY = ["country", "place"]


def _as_of(as_of):
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.strftime("%Y-%m-%d")
    return F.to_date(F.lit(as_of))


def place_summary(
    df: DataFrame,
    order_cols: list[str],
    num_descriptions: int = 3,
    as_of=None,
    keys: list[str] = KEY,
) -> DataFrame:
    """One row per (country, place).

    * metadata: first non-NULL in arrival order (E4);
    * scores: mean, NULLs ignored, all-NULL -> 0, cost doubled and clipped to
      [0, 10], then half-even integer rounding (E5, H12, H13);
    * description: first ``num_descriptions`` distinct stripped texts joined by a
      blank line (E6);
    * description_count: group size including NULL descriptions (E7);
    * last_updated: ``as_of`` (a fixed date for reproducible runs) or today.

    Rows with a NULL place drop out, as in a pandas ``groupby``.
    """
    rows = df.where(F.col("place").isNotNull())
    seq = seq_struct(order_cols)
    meta = [c for c in ["google_maps_url", "region", "place_type", "blog_source"] if c in df.columns and c not in keys]
    cats = [c for c in CATEGORIES if c in df.columns]
    agg = rows.groupBy(*keys).agg(
        *[first_non_null(c, seq).alias(c) for c in meta],
        *[F.avg(c).alias(c) for c in cats],
        F.count(F.lit(1)).alias("description_count"),
    )
    descs = first_distinct(rows, keys, "description", order_cols, num_descriptions)
    out = agg.join(descs, keys, "left")

    def _score(c):
        v = F.coalesce(F.col(c), F.lit(0.0))
        if c == "cost":
            v = F.least(F.greatest(v * 2, F.lit(0.0)), F.lit(10.0))
        return F.bround(v, 0).cast("int").alias(c)

    return out.select(
        *keys,
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in meta],
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        *[_score(c) for c in cats],
        F.col("description_count"),
        _as_of(as_of).alias("last_updated"),
    )


def first_nonempty_metadata(df: DataFrame, order_cols: list[str], keys: list[str] = KEY) -> DataFrame:
    """First non-blank (stripped) metadata per resolved place over all its rows.

    ``google_maps_url`` falls back to ``map_link`` when that column exists.
    Missing values become ''.
    """
    seq = seq_struct(order_cols)
    if "google_maps_url" not in df.columns and "map_link" in df.columns:
        df = df.withColumnRenamed("map_link", "google_maps_url")
    meta = [c for c in ["google_maps_url", "region", "place_type", "blog_source"] if c in df.columns]
    agg = df.groupBy(*keys).agg(*[first_non_empty(c, seq).alias(c) for c in meta])
    return agg.select(*keys, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in meta])


def category_means(df: DataFrame, keys: list[str] = ["country"], default: float = 5.0, prefix: str = "") -> DataFrame:
    """Per-group mean of every category, NULLs ignored; ``default`` where
    the table has no such column.  A column that is all NULL has no mean, as in
    the source, which only replaces missing columns."""
    return df.groupBy(*keys).agg(
        *[(F.avg(F.col(c).cast("double")) if c in df.columns else F.lit(default)).alias(f"{prefix}{c}") for c in CATEGORIES]
    )
