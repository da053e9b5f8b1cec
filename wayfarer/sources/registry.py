"""Source registry: nested JSON of blogs and their destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.schemas import SOURCE_REGISTRY


def write_registry(reg: DataFrame, path: str) -> None:
    reg.select("blog_name", "base_url", "destinations").write.mode("overwrite").json(path)


def read_registry(spark, path: str, multiline: bool = False) -> DataFrame:
    """Nested registry with an explicit schema (``multiline`` for one JSON
    array per file)."""
    return spark.read.schema(SOURCE_REGISTRY).option("multiLine", multiline).json(path)


def explode_registry(reg: DataFrame) -> DataFrame:
    """One row per (blog, destination)."""
    return reg.select("blog_name", "base_url", F.explode("destinations").alias("d")).select(
        "blog_name", "base_url", "d.country", "d.category_url"
    )


def select_tasks(tasks: DataFrame, blog: str = "All", country: str = "All") -> DataFrame:
    """blog = X or All, country = Y or All."""
    if blog != "All":
        tasks = tasks.where(F.col("blog_name") == blog)
    if country != "All":
        tasks = tasks.where(F.col("country") == country)
    return tasks
