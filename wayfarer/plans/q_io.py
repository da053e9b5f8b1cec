"""Catalogue queries: CSV round trip with heterogeneous headers, partitioned
catalogue write/read, distinct places, review admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.quality import normalize_headers
from wayfarer.operators.summary import place_summary
from wayfarer.plans.places import place_rows
from wayfarer.plans.q_summary import AS_OF, summary_of_p
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import summary_sql, with_p
from wayfarer.session import shared_path, table
from wayfarer.sources.catalog import load_catalog, publish_catalog, quality_report_files
from wayfarer.sources.csv import read_catalog, read_csv_dir, with_folder_country, with_maps_alias, write_catalog, write_csv

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _p_for_csv(spark, sf_dir):
    p = place_rows(spark, sf_dir)
    ln = F.col("l_linenumber")
    return p.withColumns(
        {
            # multi-line quoted text and pandas NA spellings
            "description": F.when(ln == 2, F.replace("description", F.lit(" "), F.lit("\n"))).otherwise(F.col("description")),
            "region": F.when(ln == 3, F.lit("N/A")).when(ln == 5, F.lit("null")).otherwise(F.col("region")),
        }
    )


@query(
    "csv_roundtrip",
    sql=with_p()
    + """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, place, country,
       CASE WHEN l_linenumber IN (3, 5) THEN NULL ELSE region END AS region, google_maps_url,
       md5(CASE WHEN l_linenumber = 2 THEN replace(description, ' ', chr(10)) ELSE description END) AS description_md5
FROM p""",
)
def q_csv_roundtrip(spark, sf_dir):
    """P written as CSV in three header
    layouts (R: all columns; A: no country column, Hive-style country folders,
    ``map_link``; N: padded header names, other column order), read back by name."""
    p = _p_for_csv(spark, sf_dir)
    root = shared_path(spark, "csv-roundtrip")
    cols = ["place", "country", "region", "place_type", "google_maps_url", "description", "blog_source", *KEYS]
    write_csv(p.where(F.col("l_returnflag") == "R").select(*cols), f"{root}/layout_r")
    write_csv(
        p.where(F.col("l_returnflag") == "A").select("country", "description", "place", F.col("google_maps_url").alias("map_link"), "region", *KEYS),
        f"{root}/layout_a",
        partition_by=["country"],
    )
    write_csv(
        p.where(F.col("l_returnflag") == "N").select(*[F.col(c).alias(f" {c} ") for c in reversed(cols)]),
        f"{root}/layout_n",
    )
    back = with_maps_alias(with_folder_country(normalize_headers(read_csv_dir(spark, root))))
    return back.select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        F.col("l_partkey").cast("bigint").alias("l_partkey"),
        F.col("l_suppkey").cast("bigint").alias("l_suppkey"),
        "place",
        "country",
        "region",
        "google_maps_url",
        F.md5("description").alias("description_md5"),
    )


def _catalog_path(spark, sf_dir):
    path = shared_path(spark, "catalog")
    write_catalog(summary_of_p(spark, sf_dir), path)
    return path


@query(
    "catalog_by_country",
    sql=with_p(f"s AS ({summary_sql()})")
    + "\nSELECT place, country, description_count, romance, cost FROM s WHERE country = 'NATION_3'",
)
def q_catalog_by_country(spark, sf_dir):
    """B1 + A8: catalogue written partitioned by country, one country read back
    (partition pruning)."""
    c = read_catalog(spark, _catalog_path(spark, sf_dir), "NATION_3")
    return c.select("place", "country", "description_count", "romance", "cost")


@query(
    "distinct_places",
    sql=with_p(f"s AS ({summary_sql()})") + "\nSELECT DISTINCT place FROM s",
)
def q_distinct_places(spark, sf_dir):
    """A6 + G5: every distinct place name of the written catalogue."""
    return read_catalog(spark, _catalog_path(spark, sf_dir)).select("place").distinct()


def reviews(spark, sf_dir):
    """Turns as reviews: conv_id -> a catalogue place (part of that key) or,
    for conv_id % 3 = 2, a new place whose country is missing on even turns;
    text blank on turn % 5 = 4."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = c.join(part, c.conv_id == part.p_partkey, "left")
    new = F.col("conv_id") % 3 == 2
    return j.select(
        "conv_id",
        "turn",
        F.when(new, F.concat(F.lit("Place "), F.col("conv_id").cast("string"))).otherwise(F.col("p_name")).alias("place"),
        F.when(new & (F.col("turn") % 2 == 1), F.lit("NATION_1")).alias("country"),
        F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text")).alias("description"),
        new.alias("is_new_place"),
    )


@query(
    "review_admission",
    sql=with_p(f"s AS ({summary_sql()})")
    + """,
r AS (SELECT c.conv_id, c.turn,
             CASE WHEN c.conv_id % 3 = 2 THEN 'Place ' || CAST(c.conv_id AS VARCHAR) ELSE pt.p_name END AS place,
             CASE WHEN c.conv_id % 3 = 2 AND c.turn % 2 = 1 THEN 'NATION_1' END AS country,
             CASE WHEN c.turn % 5 = 4 THEN '  ' ELSE c.text END AS description, c.conv_id % 3 = 2 AS is_new_place
      FROM conversations c LEFT JOIN part pt ON c.conv_id = pt.p_partkey),
f AS (SELECT place, arg_min({'country': country, 'region': region}, country) AS v FROM s GROUP BY place)
SELECT r.conv_id, r.turn, r.place, coalesce(r.country, f.v.country) AS country, f.v.region AS region,
       CAST(regexp_replace(coalesce(r.description, ''), '^\\s+|\\s+$', '', 'g') <> ''
            AND (NOT r.is_new_place OR (coalesce(r.place, '') <> '' AND coalesce(r.country, '') <> '')) AS INTEGER) AS admitted
FROM r LEFT JOIN f ON r.place = f.place""",
)
def q_review_admission(spark, sf_dir):
    """Reviews auto-filled from the first catalogue row of
    their place, admitted when the text is not blank and a new place has a
    name and a country; admitted rows are appended to a review log."""
    from wayfarer.operators.reviews import admit_reviews, append_reviews

    r = admit_reviews(reviews(spark, sf_dir), summary_of_p(spark, sf_dir))
    log = shared_path(spark, "review-log")
    append_reviews(r.where(F.col("admitted") == 1), log)
    return r.select("conv_id", "turn", "place", "country", "region", "admitted")


@query("rebuild_places")
def q_rebuild_places(spark, sf_dir):
    """Full rebuild over P: clean, resolve names, de-duplicate
    descriptions, metadata, score, summarise."""
    from wayfarer.plans.rebuild import full_rebuild

    p = place_rows(spark, sf_dir).drop(*["romance", "family", "cost", "nature", "adventure", "culture", "food", "relaxation", "service", "accessibility"])
    from wayfarer.plans.places import ORDER

    s = full_rebuild(p, ORDER, as_of=AS_OF)
    return s.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("incremental_update")
def q_incremental_update(spark, sf_dir):
    """Incremental update: documents as new rows (legacy ``text``
    column, noise) normalised, scored where incomplete, merged into the
    document-place catalogue, touched countries written."""
    from wayfarer.plans.docs import docs_new_data
    from wayfarer.plans.rebuild import incremental_update
    from wayfarer.plans.q_scoring import docs_places

    base = place_summary(docs_places(spark, sf_dir).where(F.col("doc_id") % 2 == 0), ["doc_id"], as_of=AS_OF)
    new = docs_new_data(spark, sf_dir).where(F.col("doc_id") % 2 == 1)
    merged, stats = incremental_update(new, base, ["doc_id"], as_of="2024-07-01", output_path=shared_path(spark, "update-out"))
    return stats


@query(
    "published_catalog",
    sql=with_p(f"s AS ({summary_sql()})")
    + """
SELECT country || '_processed.csv' AS file, country, place, region, place_type, md5(description) AS description_md5,
       romance, cost, description_count FROM s""",
)
def q_published_catalog(spark, sf_dir):
    """One named CSV per country, published in two phases, read
    back by name."""
    root = shared_path(spark, "published")
    publish_catalog(summary_of_p(spark, sf_dir), root)
    back = read_csv_dir(spark, root, glob="*_processed.csv")
    return back.select(
        F.element_at(F.split("_file", "/"), -1).alias("file"),
        "country",
        "place",
        F.coalesce("region", F.lit("")).alias("region"),
        F.coalesce("place_type", F.lit("")).alias("place_type"),
        F.md5(F.coalesce("description", F.lit(""))).alias("description_md5"),
        *[F.col(c).cast("int").alias(c) for c in ("romance", "cost")],
        F.col("description_count").cast("bigint").alias("description_count"),
    )


@query(
    "catalog_cache",
    sql=with_p(f"s AS ({summary_sql()})") + "\nSELECT country, count(*) AS places, sum(description_count) AS descriptions FROM s GROUP BY country",
)
def q_catalog_cache(spark, sf_dir):
    """The published catalogue loaded through its cache; the second load
    reads the copy."""
    root, cache = shared_path(spark, "published"), shared_path(spark, "cache")
    publish_catalog(summary_of_p(spark, sf_dir), root)
    load_catalog(spark, root, cache)
    c = load_catalog(spark, root, cache)
    return c.groupBy("country").agg(
        F.count(F.lit(1)).alias("places"), F.sum(F.col("description_count").cast("bigint")).alias("descriptions")
    )


_REPORT_ROWS = """SELECT CASE l_returnflag WHEN 'R' THEN 'all' WHEN 'A' THEN 'no_text' ELSE 'no_place' END AS folder, country,
         CASE WHEN l_linenumber = 2 THEN '  ' WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'Not enough information here'
              ELSE description END AS d FROM p"""


@query(
    "quality_report_files",
    sql=with_p(
        f"""r AS ({_REPORT_ROWS}),
f AS (SELECT country || '_processed.csv' AS file, folder, count(*) AS rows,
             CASE folder WHEN 'all' THEN 0 ELSE 1 END AS missing_required,
             CASE folder WHEN 'all' THEN '' WHEN 'no_text' THEN 'description' ELSE 'place' END AS missing_columns,
             CASE folder WHEN 'no_text' THEN 0 ELSE count(*) FILTER (d IS NULL OR trim(d) = '') END AS blank_descriptions,
             CASE folder WHEN 'no_text' THEN 0 ELSE count(*) FILTER (d = 'Not enough information here') END AS placeholder_descriptions,
             CASE folder WHEN 'all' THEN 0 ELSE 2 END AS status
      FROM r GROUP BY country, folder)"""
    )
    + """
SELECT * FROM f
UNION ALL
SELECT NULL, NULL, sum(rows), sum(missing_required), NULL, sum(blank_descriptions), sum(placeholder_descriptions), max(status) FROM f""",
)
def q_quality_report_files(spark, sf_dir):
    """P published in three layouts, two of them short of a column,
    judged file by file."""
    ln, flag = F.col("l_linenumber"), F.col("l_returnflag")
    text = F.when(ln == 2, "  ").when(ln == 3, F.lit(None)).when(ln == 4, "Not enough information here").otherwise(F.col("description"))
    p = place_rows(spark, sf_dir).withColumn("description", text)
    root = shared_path(spark, "report")
    publish_catalog(p.where(flag == "R").select("place", "country", "description"), f"{root}/all")
    publish_catalog(p.where(flag == "A").select("country", "place", "region"), f"{root}/no_text")
    publish_catalog(p.where(flag == "N").select("region", "description", "country"), f"{root}/no_place", order_by="description")
    return quality_report_files(spark, root)
