"""Cleaning, contracts and the data-quality report.

All of it is column expressions over one scan: no shuffle except the report's
aggregate (partial + final, with a grand total from ROLLUP).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.text import clean_text, contains_placeholder, is_placeholder, strip
from wayfarer.schemas import CATEGORIES


class ContractError(ValueError):
    pass


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """The required columns that are absent (schema only, no job)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """C7, update variant: raise when a required column is absent."""
    miss = missing_columns(df, required)
    if miss:
        raise ContractError(f"Missing required columns: {', '.join(miss)}")
    return df


def normalize_headers(df: DataFrame, lower: bool = False) -> DataFrame:
    """Strip (optionally lower-case) column names."""
    names = [c.strip().lower() if lower else c.strip() for c in df.columns]
    return df.toDF(*names)


def rename_legacy_text(df: DataFrame) -> DataFrame:
    """``text`` becomes ``description`` only when ``description`` is absent."""
    if "description" not in df.columns and "text" in df.columns:
        return df.withColumnRenamed("text", "description")
    return df


def add_missing(df: DataFrame, cols: list[str], default=None, dtype: str = "string") -> DataFrame:
    """Add absent columns with a default value."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default).cast(dtype))
    return df


def parse_bool(c: Column) -> Column:
    """H21 with quirk Q5 fixed: the text 'False' is false; unparseable -> false."""
    return F.coalesce(c.cast("string").try_cast("boolean"), F.lit(False))


def fill_blog_source(df: DataFrame) -> DataFrame:
    """Blank (or NULL, quirk Q4 fixed) blog_source takes ``source``; still
    blank on a manual entry -> 'user_review'."""
    bs = F.col("blog_source")
    if "source" in df.columns:
        bs = F.when(F.coalesce(strip(bs), F.lit("")) != "", bs).otherwise(F.col("source"))
    if "is_manual_entry" in df.columns:
        blank = F.coalesce(strip(bs), F.lit("")) == ""
        bs = F.when(parse_bool(F.col("is_manual_entry")) & blank, F.lit("user_review")).otherwise(bs)
    return df.withColumn("blog_source", bs)


def normalize_new_data(df: DataFrame) -> DataFrame:
    """Bring incoming rows to the catalogue contract.

    strip headers -> legacy rename -> required columns (raise) -> default
    metadata columns -> blog_source fill -> clean country/place/description ->
    drop rows with an empty required value -> drop placeholder descriptions.
    """
    df = rename_legacy_text(normalize_headers(df))
    require_columns(df, ["country", "place", "description"])
    df = add_missing(df, ["region", "place_type", "google_maps_url", "blog_source"], "")
    df = fill_blog_source(df)
    df = df.withColumns({c: clean_text(c) for c in ["country", "place", "description"]})
    return df.where(
        (F.col("country") != "") & (F.col("place") != "") & (F.col("description") != "") & ~is_placeholder("description")
    )


def drop_invalid_places(df: DataFrame) -> DataFrame:
    """C5 (aggregation variant): place and description stripped, non-empty, not 'nan',
    and the description is not a placeholder (C1)."""
    p, d = strip(F.coalesce(F.col("place"), F.lit("nan"))), strip(F.coalesce(F.col("description"), F.lit("nan")))
    return (
        df.withColumn("place", p)
        .withColumn("description", d)
        .where((p != "") & (F.lower(p) != "nan") & (d != "") & (F.lower(d) != "nan") & ~is_placeholder(d))
    )


def has_complete_ratings(df: DataFrame) -> Column:
    """C14: all ten categories present and non-NULL."""
    if any(c not in df.columns for c in CATEGORIES):
        return F.lit(False)
    cond = F.lit(True)
    for c in CATEGORIES:
        cond = cond & F.col(c).isNotNull()
    return cond


def quality_report(df: DataFrame, key: str = "country", required: list[str] = ["place", "country", "description"]) -> DataFrame:
    """Per-key rows, missing required columns, blank descriptions (NULL or
    blank after strip, quirk Q11 fixed), placeholder-phrase rows; ROLLUP adds
    the grand total (key NULL); ``status`` 2 if any required column is
    missing, else 0 (the empty-input status 1 is the caller's check)."""
    miss = len(missing_columns(df, required))
    if "description" in df.columns:
        d = F.col("description")
        blank = F.when(d.isNull() | (strip(d) == ""), 1).otherwise(0)
        ph = F.when(contains_placeholder(F.lower(F.coalesce(d, F.lit("nan")))), 1).otherwise(0)
    else:
        blank = ph = F.lit(0)
    rep = df.rollup(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(blank).cast("bigint").alias("blank_descriptions"),
        F.sum(ph).cast("bigint").alias("placeholder_descriptions"),
    )
    return rep.select(
        key,
        "rows",
        F.lit(miss).alias("missing_required"),
        "blank_descriptions",
        "placeholder_descriptions",
        F.lit(2 if miss else 0).alias("status"),
    )


def drop_duplicate_columns(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Drop the given columns, then keep only the first of any duplicate
    column names (Spark allows duplicates after joins or CSV reads)."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c in drop or c in seen:
            continue
        seen.add(c)
        keep.append(i)
    cols = df.columns
    renamed = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return renamed.select(*[F.col(f"_c{i}").alias(cols[i]) for i in keep])
