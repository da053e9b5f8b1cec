"""A keyed table that a stream upserts, one hash bucket at a time.

Layout under ``path``: ``data/v=<version>/bucket=<b>/`` holds rows and
``pointer/v=<version>`` names the version that each bucket was last written in
(at most ``buckets`` rows).  An upsert reads the buckets that its rows fall
into, writes them anew under its own version and then publishes a new pointer;
all other buckets stay as they are.  Readers see the last published pointer.

An upsert that is run again (same version) starts from the pointers before
that version and overwrites its own files, so it is idempotent; one that dies
half-way leaves the old pointer in force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


class BucketStore:
    """``keys`` decide a row's bucket; ``schema`` is that of the stored rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, buckets: int = 256):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder)]
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return [int(n[2:]) for n, p in names if n.startswith("v=") and done(p)]

    def pointer(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version; at most ``buckets`` entries."""
        versions = [v for v in self._versions() if before is None or v < before]
        if not versions:
            return {}
        rows = self.spark.read.schema(f"{BUCKET} int, version int").parquet(f"{self.path}/pointer/v={max(versions)}")
        return {r[BUCKET]: r["version"] for r in rows.collect()}

    def _rows(self, pointer: dict[int, int]) -> DataFrame:
        files = [f"{self.path}/data/v={v}/{BUCKET}={b}" for b, v in sorted(pointer.items())]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def read(self) -> DataFrame:
        """All current rows."""
        return self._rows(self.pointer())

    def upsert(self, rows: DataFrame, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``combine(current rows, rows)`` in place of the buckets that
        ``rows`` fall into; returns those buckets."""
        spark = rows.sparkSession
        # written first: a micro-batch that is read twice would run twice
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/arrived/v={version}")
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/arrived/v={version}")
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())
        if not touched:
            return []
        old = self.pointer(before=version)
        current = self._rows({b: v for b, v in old.items() if b in set(touched)})
        out = combine(current, rows).select(*self.schema.names).withColumn(BUCKET, self._bucket())
        out = out.repartition(F.col(BUCKET))  # one file a bucket
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(f"{self.path}/data/v={version}")
        entries = sorted({**old, **dict.fromkeys(touched, version)}.items())
        new = spark.createDataFrame(entries, f"{BUCKET} int, version int").coalesce(1)
        new.write.mode("overwrite").parquet(f"{self.path}/pointer/v={version}")
        return touched


def replaced(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A combining function: a new row takes the place of the one with its keys."""

    def combine(current: DataFrame, rows: DataFrame) -> DataFrame:
        both = current.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        payload = [c for c in current.columns if c not in keys]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*payload), "_new").alias("_r"))
        return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload])

    return combine
