"""User reviews: single-record source, admission, auto-fill and the review log
(A14, B4, C24, D12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.text import strip
from wayfarer.schemas import NEW_DATA


def review_record(spark: SparkSession, record: dict) -> DataFrame:
    """One review dict -> a one-row DataFrame with the new-data schema."""
    row = {f.name: record.get(f.name) for f in NEW_DATA.fields}
    return spark.createDataFrame([row], NEW_DATA)


def first_catalog_rows(catalog: DataFrame, cols: list[str] = ["country", "region", "place_type", "google_maps_url"]) -> DataFrame:
    """D12 lookup: per place name the first catalogue row (ordered by country)."""
    return catalog.groupBy("place").agg(F.min_by(F.struct(*cols), F.col("country")).alias("_cat"))


def admit_reviews(reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """C24 + D12: auto-fill missing fields from the place's first catalogue row;
    ``admitted`` = text not blank and, for a new place, name and country given."""
    f = first_catalog_rows(catalog)
    j = reviews.join(f, "place", "left")
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    ok = ~blank(F.col("description")) & (~F.col("is_new_place") | (~blank(F.col("place")) & ~blank(F.col("country"))))
    return j.select(
        *[c for c in reviews.columns if c not in ("country",)],
        F.coalesce(F.col("country"), F.col("_cat.country")).alias("country"),
        F.col("_cat.region").alias("region"),
        F.col("_cat.place_type").alias("place_type"),
        F.col("_cat.google_maps_url").alias("google_maps_url"),
        ok.cast("int").alias("admitted"),
    )


def append_reviews(df: DataFrame, path: str) -> None:
    """Append admitted reviews to the review log (no read-modify-write)."""
    df.write.mode("append").parquet(path)
