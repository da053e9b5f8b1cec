"""Model side: labelled reviews, label vectors, splits, training and MAE
(D8, E18, H16, H17, J5, K1-K5, A12, B6).

The source fine-tunes a transformer on one machine; the distributed re-aim is
a Spark ML pipeline (tokenise -> hashed term frequencies -> IDF) with one
linear regression per category, trained and evaluated on the cluster.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.schemas import CATEGORIES, LABELLED_REVIEW

LABEL_KEYS = [c.capitalize() for c in CATEGORIES]  # distribution keys are capitalised


def ordinal_positions(df: DataFrame, order_cols: list, col: str = "position") -> DataFrame:
    """Zero-based position of every row in ``order_cols`` order, as a long.

    Rows are range-partitioned and sorted, and written once under the shared
    checkpoint folder with their partition number and their index in it
    (``monotonically_increasing_id``'s two parts).  Both the partitions' row
    counts and the result are read from that one table, so they can't disagree
    as two separately sampled partitionings would.  The counts are one row per
    partition."""
    from pyspark.sql import Window

    from wayfarer.session import shared_path

    spark = df.sparkSession
    s = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    path = shared_path(spark, "ordinals")
    s.write.parquet(path)
    s = spark.read.schema(s.schema).parquet(path).withColumn("_pid", F.shiftright("_mid", 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    pos = F.col("_base") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return s.join(F.broadcast(offsets), "_pid").withColumn(col, pos).drop("_mid", "_pid", "_base")


def ordinal_ids(df: DataFrame, order_cols: list[str], fmt: str = "th-r-%05d", col: str = "review_id") -> DataFrame:
    """Zero-based position in ``order_cols`` order, formatted."""
    return ordinal_positions(df, order_cols, "_position").withColumn(col, F.format_string(fmt, "_position")).drop("_position")


def label_with_scorer(df: DataFrame, factory, text_col: str = "review") -> DataFrame:
    """A pluggable labeller fills ``distribution`` (ten integer scores);
    a failed row gets all zeros, as the source's labeller does."""
    from wayfarer.operators.scoring import raw_scores, rescale

    r = raw_scores(df, factory, text_col, on_error="zero")
    return r.withColumn("distribution", distribution_map({c: rescale(c) for c in CATEGORIES})).drop(*CATEGORIES, "score_error")


def distribution_map(cols: dict[str, F.Column] | None = None) -> F.Column:
    """Ten integer scores as a map with capitalised keys."""
    cols = cols or {c: F.col(c) for c in CATEGORIES}
    return F.create_map(*[x for c in CATEGORIES for x in (F.lit(c.capitalize()), cols[c].cast("int"))])


def label_vector(dist: str = "distribution") -> F.Column:
    """K1: labels in fixed category order, each divided by 10."""
    return F.transform(F.array(*[F.lit(k) for k in LABEL_KEYS]), lambda k: F.element_at(F.col(dist), k).cast("double") / 10.0)


def write_labelled(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append labelled reviews as JSON lines (each batch is one append)."""
    df.select("review_id", "review", "distribution").write.mode(mode).json(path)


def read_labelled(spark, path: str) -> DataFrame:
    """Labelled reviews with an explicit map schema (no inference)."""
    return spark.read.schema(LABELLED_REVIEW).json(path)


def unlabelled(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume by key, not by a row counter: items not labelled yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """K2: deterministic train/test assignment by a hash of the key (independent
    of partitioning, unlike ``randomSplit`` on recomputation)."""
    b = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000))
    return df.withColumn("split", F.when(b < int(test_fraction * 1000), F.lit("test")).otherwise(F.lit("train")))


def mae(df: DataFrame, pred_cols: list[str], label_cols: list[str], scale: float = 10.0) -> DataFrame:
    """Mean absolute error over every (row, label) pair on the 0-10 scale,
    per category and overall ('all')."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("category"), F.abs(F.col(p) - F.col(l)).alias("err")) for c, p, l in zip(CATEGORIES, pred_cols, label_cols)])
    )
    e = df.select(pairs.alias("e")).select("e.category", "e.err")
    per = e.groupBy("category").agg((F.avg("err") * scale).alias("mae"))
    tot = e.agg((F.avg("err") * scale).alias("mae")).select(F.lit("all").alias("category"), "mae")
    return per.unionByName(tot)


def text_features(text_col: str = "review", max_tokens: int | None = None, num_features: int = 1 << 16) -> list:
    """K5: tokenise (and optionally truncate to ``max_tokens``) -> TF -> IDF stages."""
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="\\W+", minTokenLength=1)]
    tok = "_tok"
    if max_tokens:
        stages.append(SQLTransformer(statement=f"SELECT *, slice(_tok, 1, {int(max_tokens)}) AS _tok_cut FROM __THIS__"))
        tok = "_tok_cut"
    stages += [HashingTF(inputCol=tok, outputCol="_tf", numFeatures=num_features), IDF(inputCol="_tf", outputCol="features")]
    return stages


def train_regressors(train: DataFrame, text_col: str = "review", label_col: str = "labels", max_tokens: int | None = None, reg: float = 0.1):
    """K3: features fitted once, then one linear regression per category on the
    0-1 label vector.  The feature matrix is persisted (recomputable from
    lineage if an executor is lost) so the ten fits do not re-tokenise; the fits
    are independent and run concurrently.  Refit on old + new labels to
    'continue' training (Spark's linear regression has no warm start)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel
    from pyspark.ml import PipelineModel

    feats = Pipeline(stages=text_features(text_col, max_tokens)).fit(train)
    fx = feats.transform(train).select("features", *[F.col(label_col)[i].alias(f"_y_{c}") for i, c in enumerate(CATEGORIES)])
    fx = fx.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def fit(c):
            lr = LinearRegression(featuresCol="features", labelCol=f"_y_{c}", predictionCol=f"pred_{c}", regParam=reg, maxIter=20)
            return lr.fit(fx)

        with ThreadPoolExecutor(max_workers=4) as pool:
            models = list(pool.map(fit, CATEGORIES))
    finally:
        fx.unpersist()
    return PipelineModel(stages=[*feats.stages, *models])


def evaluate(model, test: DataFrame, label_col: str = "labels") -> DataFrame:
    """K4: MAE of the fitted model on the test rows."""
    p = model.transform(test)
    p = p.select(*[F.col(f"pred_{c}") for c in CATEGORIES], *[F.col(label_col)[i].alias(f"_l_{c}") for i, c in enumerate(CATEGORIES)])
    return mae(p, [f"pred_{c}" for c in CATEGORIES], [f"_l_{c}" for c in CATEGORIES])
