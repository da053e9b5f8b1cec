"""Catalogue queries: small scalar and top-k operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.functions.text import safe_name, split_blank_line
from wayfarer.operators.scoring import rescale
from wayfarer.plans.places import ORDER, place_rows
from wayfarer.plans.q_summary import summary_of_p
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import NL2, summary_sql, with_p
from wayfarer.session import table


@query(
    "tail_preview",
    sql=with_p()
    + "\nSELECT place, country, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p "
    + "ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 5",
)
def q_tail_preview(spark, sf_dir):
    """F8: the last five rows in arrival order (a distributed top-k)."""
    p = place_rows(spark, sf_dir)
    return p.orderBy(*[F.col(c).desc() for c in ORDER]).limit(5).select("place", "country", *ORDER)


@query(
    "split_join",
    sql=with_p(f"s AS ({summary_sql()})")
    + f"\nSELECT country, place, len(string_split(description, {NL2})) AS parts, "
    + f"md5(array_to_string(string_split(description, {NL2}), ' | ')) AS joined_md5 FROM s",
)
def q_split_join(spark, sf_dir):
    """H5: split a merged description on blank lines and join the parts again."""
    s = summary_of_p(spark, sf_dir).withColumn("_p", split_blank_line("description"))
    return s.select("country", "place", F.size("_p").cast("bigint").alias("parts"), F.md5(F.array_join("_p", " | ")).alias("joined_md5"))


@query("safe_name", sql="SELECT p_partkey, replace(p_name, ' ', '_') || '.kml' AS file_name FROM part")
def q_safe_name(spark, sf_dir):
    """File-safe names (space -> underscore)."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(safe_name("p_name"), F.lit(".kml")).alias("file_name"))


@query(
    "rescale",
    sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "round_even(least(greatest((l_extendedprice / 100000.0) * 10.0, 0.0), 10.0), 0) AS score FROM lineitem",
)
def q_rescale(spark, sf_dir):
    """x10, clamp to [0, 10], half-even rounding of a 0-1 model output."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*ORDER, rescale(F.col("l_extendedprice") / 100000.0).alias("score"))


@query(
    "stamp",
    sql="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS review_date, '2024-06-01' AS last_updated FROM events",
)
def q_stamp(spark, sf_dir):
    """Review timestamp text and a fixed 'today' (``as_of``) date stamp."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("review_date"),
        F.date_format(F.to_date(F.lit("2024-06-01")), "yyyy-MM-dd").alias("last_updated"),
    )
