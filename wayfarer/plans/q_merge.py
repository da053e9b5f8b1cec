"""Catalogue queries: incremental merge.

Base = summary of P over returnflag R/A rows but those of one country and of
some places; new = all other rows of P.  So every row takes part, and every
merge status occurs: unchanged, merged, new, and a country with no base.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.merge import merge_catalog, merge_stats
from wayfarer.operators.summary import place_summary
from wayfarer.plans.places import ORDER, place_rows_once
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import NL2, SEQ, summary_sql, with_p
from wayfarer.schemas import CATEGORIES

AS_OF = "2024-06-01"
MERGE_DAY = "2024-07-01"
HELD_COUNTRY = "NATION_3"


def _split(spark, sf_dir):
    p = place_rows_once(spark, sf_dir)  # read by base and new rows several times each
    h = F.length("place") + F.length("country")
    in_base = F.col("l_returnflag").isin("R", "A") & (h % 7 != 0) & (F.col("country") != HELD_COUNTRY)
    pbase, pnew = p.where(in_base), p.where(~F.coalesce(in_base, F.lit(False)))
    base = place_summary(pbase, ORDER, as_of=AS_OF)
    return base, pnew


def merged_catalog(spark, sf_dir):
    base, pnew = _split(spark, sf_dir)
    return merge_catalog(base, pnew, ORDER, as_of=MERGE_DAY)


SPLIT_SQL = f"""pbase AS (SELECT * FROM p WHERE l_returnflag IN ('R','A') AND (length(place) + length(country)) % 7 <> 0
                   AND country <> '{HELD_COUNTRY}'),
pnew AS (SELECT * FROM p WHERE NOT coalesce(l_returnflag IN ('R','A') AND (length(place) + length(country)) % 7 <> 0
                   AND country <> '{HELD_COUNTRY}', false)),
base AS ({summary_sql('pbase', AS_OF)}),
bc AS (SELECT DISTINCT country FROM base),
nin AS (SELECT * FROM pnew WHERE country IN (SELECT country FROM bc)),
nout AS (SELECT * FROM pnew WHERE country NOT IN (SELECT country FROM bc)),
nagg AS (SELECT country, place, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}' for c in CATEGORIES)},
         arg_min({{'google_maps_url': google_maps_url, 'description': description, 'region': region,
                   'place_type': place_type, 'blog_source': blog_source,
                   {', '.join(f"'{c}': {c}" for c in CATEGORIES)}}}, {SEQ}) AS f
         FROM nin GROUP BY country, place),
ntop AS (SELECT country, place, list(description ORDER BY rn) AS top
         FROM (SELECT country, place, description,
                      row_number() OVER (PARTITION BY country, place ORDER BY {SEQ}) AS rn FROM nin)
         WHERE rn <= 5 GROUP BY country, place),
j AS (SELECT coalesce(b.country, n.country) AS country, coalesce(b.place, n.place) AS place,
             CASE WHEN b.place IS NOT NULL AND n.place IS NOT NULL THEN 'merged'
                  WHEN b.place IS NOT NULL THEN 'unchanged' ELSE 'new' END AS merge_status,
             b.google_maps_url AS b_google_maps_url, b.description AS b_description, b.region AS b_region,
             b.place_type AS b_place_type, b.blog_source AS b_blog_source,
             {', '.join(f'CAST(b.{c} AS DOUBLE) AS b_{c}' for c in CATEGORIES)},
             b.description_count AS b_description_count, b.last_updated AS b_last_updated,
             n.n, {', '.join(f'n.m_{c}' for c in CATEGORIES)}, n.f, t.top
      FROM base b FULL OUTER JOIN nagg n ON b.country = n.country AND b.place = n.place
      LEFT JOIN ntop t ON n.country = t.country AND n.place = t.place),
merged AS (
  SELECT country, place, merge_status,
    CASE merge_status WHEN 'merged' THEN b_google_maps_url WHEN 'unchanged' THEN b_google_maps_url ELSE f.google_maps_url END AS google_maps_url,
    CASE merge_status
      WHEN 'merged' THEN array_to_string(list_slice(list_concat(coalesce(string_split(b_description, {NL2}), []), top), 1, 5), {NL2})
      WHEN 'unchanged' THEN b_description ELSE f.description END AS description,
    CASE merge_status WHEN 'new' THEN f.region ELSE b_region END AS region,
    CASE merge_status WHEN 'new' THEN f.place_type ELSE b_place_type END AS place_type,
    CASE merge_status WHEN 'new' THEN f.blog_source ELSE b_blog_source END AS blog_source,
    {', '.join(f'''CASE merge_status
      WHEN 'merged' THEN round_even(round((b_{c} * coalesce(b_description_count, 1) + m_{c} * n)
                                     / (coalesce(b_description_count, 1) + n), 9), 1)
      WHEN 'unchanged' THEN b_{c} ELSE CAST(f.{c} AS DOUBLE) END AS {c}''' for c in CATEGORIES)},
    CASE merge_status WHEN 'merged' THEN coalesce(b_description_count, 1) + n
      WHEN 'unchanged' THEN b_description_count ELSE 1 END AS description_count,
    CASE merge_status WHEN 'unchanged' THEN b_last_updated ELSE '{MERGE_DAY}' END AS last_updated
  FROM j
  UNION ALL
  SELECT country, place, 'new_country' AS merge_status, google_maps_url, description, region, place_type, blog_source,
         {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CATEGORIES)}, 1 AS description_count, '{MERGE_DAY}' AS last_updated
  FROM nout)"""

_OUT = ", ".join(["country", "place", "merge_status", "google_maps_url", "description", "region", "place_type", "blog_source"]
                 + CATEGORIES + ["description_count", "last_updated"])


def _fmt(df):
    return df.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("merge_full", sql=with_p(SPLIT_SQL) + f"\nSELECT {_OUT} FROM merged")
def q_merge_full(spark, sf_dir):
    return _fmt(merged_catalog(spark, sf_dir)).select(*_OUT.split(", "))


@query(
    "weighted_merge",
    sql=with_p(SPLIT_SQL)
    + f"\nSELECT country, place, description, {', '.join(CATEGORIES)}, description_count FROM merged WHERE merge_status = 'merged'",
)
def q_weighted_merge(spark, sf_dir):
    m = merged_catalog(spark, sf_dir).where(F.col("merge_status") == "merged")
    return m.select("country", "place", "description", *CATEGORIES, "description_count")


@query(
    "merge_unchanged",
    sql=with_p(SPLIT_SQL)
    + "\nSELECT country, place, description_count, last_updated FROM merged WHERE merge_status = 'unchanged'",
)
def q_merge_unchanged(spark, sf_dir):
    m = _fmt(merged_catalog(spark, sf_dir)).where(F.col("merge_status") == "unchanged")
    return m.select("country", "place", "description_count", "last_updated")


@query(
    "merge_new",
    sql=with_p(SPLIT_SQL)
    + f"\nSELECT country, place, description, {', '.join(CATEGORIES)}, description_count, last_updated FROM merged WHERE merge_status IN ('new', 'new_country')",
)
def q_merge_new(spark, sf_dir):
    m = _fmt(merged_catalog(spark, sf_dir)).where(F.col("merge_status").isin("new", "new_country"))
    return m.select("country", "place", "description", *CATEGORIES, "description_count", "last_updated")


@query(
    "merge_overlap",
    sql=with_p(SPLIT_SQL) + "\nSELECT country, place FROM base INTERSECT SELECT country, place FROM nin",
)
def q_merge_overlap(spark, sf_dir):
    """INTERSECT of place keys as a left-semi join."""
    base, pnew = _split(spark, sf_dir)
    keys = ["country", "place"]
    return base.select(*keys).join(pnew.select(*keys), keys, "left_semi").distinct()


@query(
    "merge_stats",
    sql=with_p(SPLIT_SQL) + "\nSELECT country, merge_status, count(*) AS places FROM merged GROUP BY 1, 2",
)
def q_merge_stats(spark, sf_dir):
    return merge_stats(merged_catalog(spark, sf_dir))
