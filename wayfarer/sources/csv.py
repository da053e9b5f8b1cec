"""CSV sources and sinks with the source system's dialect (A1-A3, A9, A10, A15,
B1, B10, traps T1, T2, T5).

Spark's CSV reader maps columns by *position*; the source maps them by *name*
per file and files in one folder may have different headers.  So:

1. header probe (one distributed text scan): the first line of every file;
2. files are grouped by header layout (a handful of layouts, collected);
3. each layout is read with ``header`` + ``multiLine`` and a string schema named
   by that header, then all layouts are combined with
   ``unionByName(allowMissingColumns=True)``.

pandas' NA spellings become NULL (T2); the folder name fills a missing or NULL
``country`` (A2, quirk Q1 fixed; Hive-style ``country=X`` folders give X).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.schemas import CSV_NA_VALUES

EXCLUDE_AGG = ("_enriched", "_unified")


def _split_header(line: str) -> list[str]:
    import csv

    return next(csv.reader([line.lstrip("﻿")]))


def _source_path() -> Column:
    """The file of a row as a plain path (the metadata column is a URI, in
    which a space reads %20)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_headers(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(file, header): the first line of every file below ``root``; an empty
    file has none and is left out.

    The place of the first line is a long, which hashing aggregates, and a
    second scan of the same splits picks the line; a least line per file would
    sort all lines of a task's splits."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root)
        .select("value", _source_path().alias("file"), F.col("_metadata.file_block_start").alias("_start"))
        .where(F.col("_start") == 0)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    first = lines.groupBy("file").agg(F.min("_id").alias("_id"))
    return lines.join(F.broadcast(first.select("_id")), "_id").select("file", F.col("value").alias("header"))


def header_layouts(spark: SparkSession, root: str, glob: str = "*.csv") -> dict[tuple, list[str]]:
    """Map header layout -> files (the only driver-side collect: one row per layout)."""
    by_layout = file_headers(spark, root, glob).groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    out: dict[tuple, list[str]] = {}
    for r in by_layout:
        key = tuple(_split_header(r["header"] or ""))
        out.setdefault(key, []).extend(sorted(r["files"]))
    return out


def read_csv_dir(
    spark: SparkSession,
    root: str,
    glob: str = "*.csv",
    exclude_substrings: tuple[str, ...] = (),
    exclude_suffixes: tuple[str, ...] = (),
    na_values: list[str] = CSV_NA_VALUES,
    lower_headers: bool = False,
) -> DataFrame:
    """All CSVs under ``root`` (recursive), name-mapped per file,
    with ``_file`` (path), ``_row`` (0-based row in the file; arrival order is
    (``_file``, ``_row``)) and ``_folder`` (parent folder name) columns.
    Unreadable files are skipped (``ignoreCorruptFiles``), malformed rows kept
    with NULLs (PERMISSIVE)."""
    layouts = header_layouts(spark, root, glob)
    frames = []
    for header, files in layouts.items():
        files = [
            f
            for f in files
            if not any(x in f.rsplit("/", 1)[-1] for x in exclude_substrings)
            and not any(f.endswith(x) for x in exclude_suffixes)
        ]
        if not files or not header:
            continue
        names = [h.strip().lower() if lower_headers else h.strip() for h in header]
        # duplicate header names keep the first (pandas would mangle; we keep it simple)
        seen, uniq = set(), []
        for i, n in enumerate(names):
            uniq.append(n if n not in seen else f"{n}.{i}")
            seen.add(n)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in uniq])
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("mode", "PERMISSIVE")
            .option("ignoreCorruptFiles", True)
            .csv(files)
            .withColumn("_file", _source_path())
            # multiLine files are never split: ids rise in row order within a file
            .withColumn("_mid", F.monotonically_increasing_id())
        )
        frames.append(df)
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField("_file", T.StringType())]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out = out.withColumn("_folder", F.regexp_replace(F.element_at(F.split("_file", "/"), -2), "^[^=/]+=", ""))
    # Reproducible arrival order = (file, row position in the file)
    out = out.withColumn("_row", F.col("_mid") - F.min("_mid").over(Window.partitionBy("_file"))).drop("_mid")
    na = set(na_values)
    return out.withColumns({c: F.when(F.col(c).isin(*na), F.lit(None)).otherwise(F.col(c)) for c in out.columns if not c.startswith("_")})


def with_folder_country(df: DataFrame) -> DataFrame:
    """A2 (Q1 fixed): missing or NULL country -> the containing folder's name."""
    if "country" not in df.columns:
        return df.withColumn("country", F.col("_folder"))
    return df.withColumn("country", F.coalesce(F.col("country"), F.col("_folder")))


def with_maps_alias(df: DataFrame) -> DataFrame:
    """``map_link`` is an alias of ``google_maps_url``."""
    if "map_link" in df.columns:
        if "google_maps_url" in df.columns:
            return df.withColumn("google_maps_url", F.coalesce("google_maps_url", "map_link")).drop("map_link")
        return df.withColumnRenamed("map_link", "google_maps_url")
    return df


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Header, every field quoted, '"' escaped; with ``partition_by`` and
    dynamic partition overwrite only the partitions present are replaced (B1)."""
    w = df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_catalog(df: DataFrame, path: str, partition_by: list[str] = ["country"]) -> None:
    """B1: the catalogue as Parquet partitioned by country; only the countries
    in ``df`` are overwritten (``partitionOverwriteMode=dynamic``)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_catalog(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """The catalogue; a country filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("country") == country) if country is not None else df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_output(
    df: DataFrame, input_path: str, output_path: str | None = None, overwrite: bool = False, suffix: str = "_summarized"
) -> str:
    """B2: in place (``overwrite``), to ``output_path``, or to a ``<input><suffix>``
    sibling.  Spark cannot overwrite a path the same plan reads (T9), so an
    in-place write goes to a staging folder first and is swapped in by rename."""
    spark = df.sparkSession
    if overwrite:
        stage = input_path.rstrip("/") + "._staging"
        df.write.mode("overwrite").parquet(stage)
        fs, src = _fs(spark, input_path)
        _, tmp = _fs(spark, stage)
        _, old = _fs(spark, input_path.rstrip("/") + "._old")
        fs.delete(old, True)
        # the source stays, under another name, until the new table is in place
        if not fs.rename(src, old):
            raise OSError(f"cannot move {src} aside; the new table is in {tmp}")
        if not fs.rename(tmp, src):
            fs.rename(old, src)
            raise OSError(f"cannot move {tmp} to {src}; the old table is back in place")
        fs.delete(old, True)
        return input_path
    target = output_path or input_path.rstrip("/") + suffix
    df.write.mode("overwrite").parquet(target)
    return target


def write_enriched(df: DataFrame, input_path: str) -> str:
    """The enriched sibling table ``<input>_enriched``."""
    return write_output(df, input_path, suffix="_enriched")


def append_raw(df: DataFrame, path: str) -> None:
    """Accumulating raw sink, one folder per (blog_source, country)."""
    df.write.mode("append").partitionBy("blog_source", "country").parquet(path)


def new_files_only(rows: DataFrame, ledger_path: str) -> DataFrame:
    """B7 (quirk Q9 fixed): rows of files not yet in the processed-file ledger."""
    spark = rows.sparkSession
    fs, p = _fs(spark, ledger_path)
    if not fs.exists(p):  # nothing processed yet; any other trouble is an error
        return rows
    done = spark.read.parquet(ledger_path).select(F.col("file").alias("_file"))
    return rows.join(done, "_file", "left_anti")


def record_processed(rows: DataFrame, ledger_path: str) -> None:
    """Append the files just merged to the ledger (after a successful merge)."""
    rows.select(F.col("_file").alias("file")).distinct().write.mode("append").parquet(ledger_path)
