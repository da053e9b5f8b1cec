"""Catalogue queries: labelled reviews, ids, label vectors, MAE, resume,
JSON round trip, split, training.

Reviews = documents that have a ``labels`` row; the labeller's distribution
is a deterministic function of the keys and the two label flags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.scoring import KEYWORDS, raw_scores
from wayfarer.operators.training import (
    distribution_map,
    evaluate,
    hash_split,
    label_vector,
    mae,
    ordinal_ids,
    read_labelled,
    train_regressors,
    unlabelled,
    write_labelled,
)
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import strip
from wayfarer.schemas import CATEGORIES
from wayfarer.session import shared_path, table


def _dist_cols():
    d, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    return {c: ((d * (k + 1) + q * 3 + t * 7) % 11).cast("int") for k, c in enumerate(CATEGORIES)}


def reviews(spark, sf_dir):
    """Labelled reviews: review_id by doc order, stripped text, distribution map."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = docs.join(lab, "doc_id").select("doc_id", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("review"), "quality", "toxic")
    j = j.select("doc_id", "review", distribution_map(_dist_cols()).alias("distribution"))
    return ordinal_ids(j, ["doc_id"])


def _dist_sql(k):
    return f"CAST((doc_id * {k + 1} + quality * 3 + toxic * 7) % 11 AS INTEGER)"


REVIEWS_SQL = f"""SELECT doc_id, printf('th-r-%05d', row_number() OVER (ORDER BY doc_id) - 1) AS review_id,
  {strip('d.text')} AS review, {', '.join(f'{_dist_sql(k)} AS d_{c}' for k, c in enumerate(CATEGORIES))}
FROM documents d JOIN labels l USING (doc_id)"""


@query("label_ids", sql=f"SELECT doc_id, review_id FROM ({REVIEWS_SQL})")
def q_label_ids(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", "review_id")


@query(
    "label_vectors",
    sql=f"SELECT review_id, {', '.join(f'round(d_{c} / 10.0, 4) AS l_{c}' for c in CATEGORIES)} FROM ({REVIEWS_SQL})",
)
def q_label_vectors(spark, sf_dir):
    r = reviews(spark, sf_dir).withColumn("_v", label_vector())
    return r.select("review_id", *[F.round(F.col("_v")[i], 4).alias(f"l_{c}") for i, c in enumerate(CATEGORIES)])


def _dens_sql(c, text):
    low = f"lower({text})"
    kw = KEYWORDS[c]
    cnt = f"((length({low}) - length(replace({low}, '{kw}', ''))) // {len(kw)})"
    return f"(CASE WHEN length({low}) > 0 THEN {cnt} * 100.0 / length({low}) ELSE 0.0 END)"


@query(
    "mae_eval",
    sql=f"""WITH r AS ({REVIEWS_SQL}),
e AS ({' UNION ALL '.join(f"SELECT '{c}' AS category, abs(({_dens_sql(c, 'review')} / 10.0) - d_{c} / 10.0) AS err FROM r" for c in CATEGORIES)})
SELECT category, round(avg(err) * 10.0, 4) AS mae FROM e GROUP BY category
UNION ALL SELECT 'all', round(avg(err) * 10.0, 4) FROM e""",
)
def q_mae_eval(spark, sf_dir):
    r = reviews(spark, sf_dir)
    p = raw_scores(r, text_col="review")
    p = p.select(*CATEGORIES, *[(F.element_at("distribution", c.capitalize()) / 10.0).alias(f"_l_{c}") for c in CATEGORIES])
    m = mae(p, CATEGORIES, [f"_l_{c}" for c in CATEGORIES])
    return m.select("category", F.round("mae", 4).alias("mae"))


@query("resume_labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return unlabelled(docs, table(spark, sf_dir, "labels"), "doc_id")


@query(
    "labelled_json",
    sql=f"SELECT review_id, md5(review) AS review_md5, {', '.join(f'd_{c} AS {c}' for c in CATEGORIES)} FROM ({REVIEWS_SQL})",
)
def q_labelled_json(spark, sf_dir):
    """B6 + A12: labelled reviews appended as JSON in two batches (resumable:
    the second batch is the anti-join of all reviews against the first), read
    back with an explicit schema."""
    r = reviews(spark, sf_dir)
    path = shared_path(spark, "labelled-json")
    first = r.where(F.col("doc_id") % 2 == 0)
    write_labelled(first, path)
    done = read_labelled(spark, path)
    write_labelled(unlabelled(r, done, "review_id"), path)
    back = read_labelled(spark, path)
    return back.select(
        "review_id", F.md5("review").alias("review_md5"), *[F.element_at("distribution", c.capitalize()).alias(c) for c in CATEGORIES]
    )


@query("hash_split")
def q_hash_split(spark, sf_dir):
    """K2: deterministic 90/10 split of the reviews."""
    return hash_split(reviews(spark, sf_dir), "review_id").select("review_id", "split")


@query("train_eval")
def q_train_eval(spark, sf_dir):
    """K3-K5: TF-IDF + per-category linear regression on the training split,
    MAE on the test split (0-10 scale)."""
    r = hash_split(reviews(spark, sf_dir), "review_id").withColumn("labels", label_vector())
    model = train_regressors(r.where(F.col("split") == "train"))
    return evaluate(model, r.where(F.col("split") == "test"))
