"""Session construction and the shared scratch location.

Scratch data (lineage cuts, staged writes, stream checkpoints) always lives
under the cluster's shared ``spark.checkpoint.dir``.  Only when a session has
none (local tests) do we create one, once per session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # streaming state in RocksDB (off-heap, spills to local disk, checkpointed)
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Recommended settings for a large cluster (~1000 executors, ~100 TB input).
# Not applied automatically: a cluster's own configuration wins.
CLUSTER_CONF = {
    # start wide and let AQE coalesce to ~256 MB per reducer; split skewed
    # partitions (a key may hold a third of all rows) in joins
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    # ~256 MB scan splits; columnar reads with pushdown
    "spark.sql.files.maxPartitionBytes": "256m",
    # broadcast only what the planner measured to be small (size-checked)
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Arrow batches for the Python stages; bounded memory per batch
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # streaming state off-heap in RocksDB
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, app: str = "wayfarer", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; set our own only where it is unset (local tests).
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        # setCheckpointDir appends a per-application uuid folder; use its parent
        return root.rstrip("/")
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="wayfarer-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def released(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go from the executors' disks: they stay
    until the driver happens to collect its garbage, beside those of the steps
    that follow; so it does that now (some tenths of a second)."""
    spark.sparkContext._jvm.System.gc()


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; the write's
    shuffle files are released."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the few local-only helpers (tests)."""
    return path[len("file:"):] if path.startswith("file:") else path


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wayfarer`` importable on executors (Arrow UDFs and mapInPandas
    functions are pickled by reference): zip the package once and hand it to
    ``addPyFile``, which distributes it with the job."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="wayfarer-pkg-"), "wayfarer.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(app)


def cpu_parallelism(spark: SparkSession, factor: int = 2) -> int:
    """Partitions for CPU-heavy Python stages: AQE sizes partitions by bytes,
    which packs small-but-expensive rows (text pairs for an exact LCS) into a
    few tasks; an explicit-count repartition keeps every core busy."""
    return max(1, spark.sparkContext.defaultParallelism * factor)


def python_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle that feeds a CPU-heavy Python stage: the
    session's shuffle width, which follows the data, but several tasks a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cpu_parallelism(spark, 4))


def spread_for_python(df):
    """Before a CPU-heavy Python stage: if the input has fewer partitions than
    the cluster has cores (a small table read as one split), spread it by a
    round-robin repartition; a large input already has enough partitions and is
    left alone (no extra shuffle).  Only scan-like plans (no exchange) are
    inspected, where counting partitions only plans and runs no job."""
    # with AQE, asking a plan that contains a shuffle for its partition count
    # would run the shuffle: such inputs are left to AQE's own partitioning
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    target = cpu_parallelism(df.sparkSession, 1)
    if df.rdd.getNumPartitions() < target:
        return df.repartition(cpu_parallelism(df.sparkSession))
    return df


ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """At most ``ARROW_ROWS`` texts per Arrow batch (the default of 10,000
    texts would hold tens of MB at once); a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


SLICE_ROWS = 512  # rows that a Python stage turns into pandas at once
SLICE_BYTES = 2 << 20  # or so many bytes of its inputs


def with_python_columns(df, inputs: list[str], fn, fields, keep: list[str] | None = None):
    """``df`` (its columns ``keep``) with the columns ``fields`` that ``fn``
    makes of the columns ``inputs``, a pandas DataFrame each.

    Rows come in Arrow batches of at most ``ARROW_ROWS``; pandas copies of one
    slice exist at a time, so a worker's memory follows neither the table nor
    the batch.  ``fn`` makes a new column of each row by itself."""
    import pyarrow as pa
    from pyspark.sql import types as T

    bounded_batches(df.sparkSession)
    kept = df.columns if keep is None else keep
    arrow = {T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    new = [(f.name, arrow[f.dataType]) for f in fields]
    rows, size = SLICE_ROWS, SLICE_BYTES

    def run(batches):
        for batch in batches:
            given = batch.select(inputs)
            step = max(1, min(rows, batch.num_rows * size // max(given.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                made = fn(given.slice(at, step).to_pandas())
                added = [pa.Array.from_pandas(made[c], type=t) for c, t in new]
                part = batch.select(kept).slice(at, step)
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*kept, *(c for c, _ in new)])

    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    return spread_for_python(df).mapInArrow(run, schema)
