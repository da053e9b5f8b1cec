"""The catalogue as files: one named CSV per country, published in two phases,
checked file by file and loaded through a cache (A7, A10, B1, B9, B10, E14)."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.text import contains_placeholder, strip
from wayfarer.session import shared_path
from wayfarer.sources.csv import _fs, _split_header, file_headers, read_csv_dir

# The name of a country's file and the mark that opens it.
SUFFIX = "_processed.csv"
BOM = "﻿"

GLOB = f"*{SUFFIX}"
REQUIRED = ["place", "country", "description"]


def csv_field(c: Column) -> Column:
    """A value as CSV text: NULL is empty, quotes only where needed."""
    s = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull(), "").when(s.rlike('[",\r\n]'), quoted).otherwise(s)


def file_name(country: str) -> str:
    """A country's file; characters that a path can't hold are percent-encoded."""
    return re.sub(r"[/\\:%\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", country) + SUFFIX


def publish_catalog(df: DataFrame, path: str, order_by: str = "place") -> list[str]:
    """Write ``path/{country}_processed.csv`` (UTF-8 with BOM, header, rows by
    ``order_by``) for every country of ``df``; files of other countries stay.
    Rows without a country go nowhere.  Returns the file names.

    Phase 1 writes all files into ``path/_next-<id>`` and marks the folder as
    ready; until then the old files are untouched.  Phase 2 moves each file
    into place.  If it is interrupted, ``finish_publish`` (called first by every
    publish) moves the rest, so no file is ever half old and half new.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    finish_publish(spark, path)
    header = BOM + ",".join(df.columns)
    at = F.col("country").cast("string")
    line = F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns])
    rows = df.where(F.col("country").isNotNull()).select(at.alias("c"), F.lit(1).alias("k"), F.col(order_by).cast("string").alias("o"), line.alias("value"))
    heads = rows.select("c").distinct().select("c", F.lit(0).alias("k"), F.lit("").alias("o"), F.lit(header).alias("value"))
    # a file is one country's places, one row each: one task writes it
    lines = heads.unionByName(rows).repartition("c").sortWithinPartitions("c", "k", "o", "value")
    stage = f"{path}/_next-{uuid.uuid4().hex[:12]}"
    lines.select("c", "value").write.partitionBy("c").text(stage)
    fs, ready = _fs(spark, f"{stage}/_READY")
    fs.create(ready).close()
    return finish_publish(spark, path)


def finish_publish(spark: SparkSession, path: str) -> list[str]:
    """Move the files of every complete staging folder of ``path`` into place
    and drop incomplete ones; the names of the moved files."""
    fs, root = _fs(spark, path)
    jvm, done = spark.sparkContext._jvm, []
    if not fs.exists(root):
        return done
    for entry in fs.listStatus(root):
        stage = entry.getPath()
        if not stage.getName().startswith("_next-"):
            continue
        if fs.exists(jvm.org.apache.hadoop.fs.Path(stage, "_READY")):
            for folder in fs.listStatus(stage):
                name = folder.getPath().getName()
                if not folder.isDirectory() or not name.startswith("c="):
                    continue
                target = jvm.org.apache.hadoop.fs.Path(root, file_name(unquote(name[2:])))
                for part in fs.listStatus(folder.getPath()):
                    if part.getPath().getName().startswith("part-"):
                        if fs.exists(target):
                            fs.delete(target, False)
                        if not fs.rename(part.getPath(), target):
                            raise OSError(f"cannot move {part.getPath()} to {target}")
                        done.append(target.getName())
        fs.delete(stage, True)
    return sorted(done)


def quality_report_files(spark: SparkSession, root: str, glob: str = GLOB, required: list[str] = REQUIRED) -> DataFrame:
    """One row per file of the folder ``root`` and a total (``file``
    NULL): rows, missing required columns, blank descriptions (NULL or blank),
    placeholder descriptions, status.

    A file's columns are judged by its own header, so files of several layouts
    may lie in one folder; a file without a description column has no blank
    one.  Status: 2 if a required column is missing (in any file, for the
    total), else 0; a folder without files gives one total with status 1.
    """
    path = shared_path(spark, "heads")
    file_headers(spark, root, glob).write.parquet(path)  # one row per file, used twice
    heads = spark.read.schema("file string, header string").parquet(path)
    layouts = [r["header"] for r in heads.select("header").distinct().collect()]  # one row per layout
    judged = []
    for h in layouts:
        names = [n.strip() for n in _split_header(h or "")]
        missing = [c for c in required if c not in names]
        judged.append((h, len(missing), ", ".join(missing), "description" in names))
    schema = "header string, missing_required int, missing_columns string, has_text boolean"
    files = heads.join(F.broadcast(spark.createDataFrame(judged, schema)), "header")
    rows = read_csv_dir(spark, root, glob)
    d = F.col("description") if "description" in rows.columns else F.lit(None).cast("string")
    blank = d.isNull() | (strip(d) == "")
    counts = rows.groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank).alias("blank"),
        F.count_if(contains_placeholder(F.lower(F.coalesce(d, F.lit(""))))).alias("held"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    per_file = files.join(counts, "file", "left").select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        F.element_at(F.split("file", "/"), -2).alias("folder"),
        zero("rows").alias("rows"),
        "missing_required",
        "missing_columns",
        F.when(F.col("has_text"), zero("blank")).otherwise(F.lit(0)).cast("long").alias("blank_descriptions"),
        F.when(F.col("has_text"), zero("held")).otherwise(F.lit(0)).cast("long").alias("placeholder_descriptions"),
        F.when(F.col("missing_required") > 0, 2).otherwise(0).alias("status"),
    )
    total = per_file.agg(
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("string").alias("folder"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("missing_required"), F.lit(0)).cast("int").alias("missing_required"),
        F.lit(None).cast("string").alias("missing_columns"),
        F.coalesce(F.sum("blank_descriptions"), F.lit(0)).alias("blank_descriptions"),
        F.coalesce(F.sum("placeholder_descriptions"), F.lit(0)).alias("placeholder_descriptions"),
        F.coalesce(F.max("status"), F.lit(1)).alias("status"),
    )
    return per_file.unionByName(total)


def source_files(spark: SparkSession, root: str, glob: str = GLOB) -> DataFrame:
    """(path, length, modified) of the files below ``root``; none is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def load_catalog(spark: SparkSession, root: str, cache_path: str, glob: str = GLOB) -> DataFrame:
    """All catalogue files below ``root``, through a materialised copy.

    The copy is kept with the paths, sizes and times of its sources and is
    valid until one of them changes, appears or goes; then the files are read
    again into a new version.  The sources are listed before they are read, so
    a file that changes meanwhile makes the next load read it again.
    """
    cache_path = cache_path.rstrip("/")
    now = source_files(spark, root, glob)
    fs, folder = _fs(spark, f"{cache_path}/sources")
    jvm = spark.sparkContext._jvm
    versions = []
    if fs.exists(folder):
        for s in fs.listStatus(folder):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                versions.append(int(s.getPath().getName()[2:]))
    if versions:
        kept = spark.read.schema(now.schema).parquet(f"{cache_path}/sources/v={max(versions)}")
        if now.exceptAll(kept).isEmpty() and kept.exceptAll(now).isEmpty():
            return spark.read.parquet(f"{cache_path}/data/v={max(versions)}")
    version = max(versions, default=0) + 1
    now.write.mode("overwrite").parquet(f"{cache_path}/listed/v={version}")
    read_csv_dir(spark, root, glob).write.mode("overwrite").parquet(f"{cache_path}/data/v={version}")
    spark.read.schema(now.schema).parquet(f"{cache_path}/listed/v={version}").write.mode("overwrite").parquet(f"{cache_path}/sources/v={version}")
    return spark.read.parquet(f"{cache_path}/data/v={version}")
