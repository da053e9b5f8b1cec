"""Exact de-duplication by a stateful stream (native: DataFrame operations only).

A Structured Streaming aggregation keyed by the text's SHA-256 keeps, in the
RocksDB state store (on disk, checkpointed to the shared folder, no watermark
and so no expiry): the digest, the stable identifier (largest id), the content
locator (where that row's text stands) and the group's size.  A hit, a row
whose digest the state has for another row, is then checked byte for byte
against the text at the locator; rows that share a digest but not the bytes
are grouped by their whole text instead.

Scale: the stream shuffles one (digest, id, size) row per partial group, not
texts.  Only the texts of hits and of the rows that they hit move afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.common import among, fresh, maybe_among, shared_path, staged, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DIGEST_BITS = 256


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), DIGEST_BITS)


def stream_state(spark: SparkSession, rows_path: str, schema, max_files: int | None = None) -> DataFrame:
    """Run the stateful stream over the (digest, id) files in ``rows_path``;
    (digest, keep_id, group_size), one row per digest.

    With ``max_files`` the input arrives in several micro-batches; each emits
    the digests it touched, and the latest version of a digest counts.  A
    micro-batch that is run again overwrites its own folder.
    """
    out = shared_path(spark, "dedup-state")
    # a session of its own: state store settings must not leak to the caller's
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    # a store otherwise preallocates about 4 MB of local disk, however little it holds
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    reader = own.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    state = (
        reader.parquet(rows_path)
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )

    def version(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        state.writeStream.outputMode("update")
        .foreachBatch(version)
        .option("checkpointLocation", shared_path(spark, "dedup-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    empty = "digest string, keep_id long, group_size long"
    if not query.lastProgress:  # no input file at all
        return spark.createDataFrame([], empty)
    seen = spark.read.schema(f"{empty}, epoch int").parquet(out)
    return seen.groupBy("digest").agg(
        F.max_by("keep_id", "epoch").alias("keep_id"), F.max_by("group_size", "epoch").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    max_files: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    row with the largest id stays.  Defined cases: a null id never beats
    another id (a group with null ids only keeps id null); rows that repeat
    the kept id and its text count as group members, all with ``kept`` true,
    since an id names a document; an empty table gives no rows; other columns
    are ignored.  ``digest`` may be any deterministic text -> string
    expression; texts that share a digest without being equal are separated by
    the byte check.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    src = src.withColumn("digest", digest(F.col("text")))
    path = shared_path(spark, "dedup-digests")
    rows_df = src.select("digest", "id")
    rows_df.write.parquet(path)
    rows = spark.read.schema(rows_df.schema).parquet(path)
    state = staged(stream_state(spark, path, rows_df.schema, max_files), "dedup-groups")

    # full bytes of hits only: a digest whose rows hold more than one text.
    # min and max are combined on the map side, so a group of copies leaves a
    # task as one row however many rows it has.
    hits = among(src, state.where("group_size > 1"), ["digest"])
    clash = staged(
        hits.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest"),
        "dedup-clashes",
    )
    plain = rows.join(clash, "digest", "left_anti").join(state, "digest")
    # rows of clashing digests: the whole text is the key
    mixed = among(src, clash, ["digest"]).join(clash, "digest", "left_semi")
    by_text = mixed.groupBy("digest", "text").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    apart = mixed.join(by_text, ["digest", "text"])
    cols = ["id", "keep_id", "group_size", "digest"]
    out = plain.select(cols).unionByName(apart.select(cols))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (all columns).  Rows
    whose text surely stands alone pass where they are; only rows that may be
    in a group are shuffled."""
    mark, kid, kdig, may, ing = (fresh(docs, x) for x in ("digest", "keep_id", "keep_digest", "may", "in_group"))
    groups = staged(exact_dedup(docs, id_col, text_col).where("group_size > 1 and kept"), "dedup-kept")
    keep = groups.select(F.col(id_col).alias(kid), F.col("digest").alias(kdig)).distinct()
    marked = docs.withColumn(mark, sha256(text_of(text_col)))
    flagged = maybe_among(marked, keep.select(F.col(kdig).alias(mark)), [mark], may)
    # a flagged row is in a group (then only the kept one goes on) or alone
    grouped = keep.select(F.col(kdig).alias(mark), F.lit(True).alias(ing)).distinct()
    held = flagged.where(may).join(grouped, mark, "left")
    alone = held.where(F.col(ing).isNull()).select(docs.columns)
    on = F.col(mark).eqNullSafe(F.col(kdig)) & F.col(id_col).cast("long").eqNullSafe(F.col(kid))
    kept = held.where(F.col(ing)).join(keep, on, "left_semi").dropDuplicates([id_col, mark])
    return flagged.where(~F.col(may)).select(docs.columns).unionByName(alone).unionByName(kept.select(docs.columns))
