"""Mapping of the driver's star-schema tables onto the place model.

P = lineitem x part x supplier x nation x region, one row per line item:

* place = p_name, country = supplier nation, region = region name,
  place_type = p_type, blog_source = p_brand;
* google_maps_url derived from the name and supplier (NULL every 4th line);
* description = p_name || ' ' || p_type || ' ' || l_returnflag;
* ten integer scores derived from the keys (food NULL when l_orderkey % 13 = 0);
* arrival order = (l_orderkey, l_linenumber, l_partkey, l_suppkey), unique.

Scale: nation and region are fixed-size (25 and 5 rows), so that pair is
broadcast explicitly; part and supplier grow with the data and are left to the
planner's size-checked broadcast threshold / AQE, else sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.session import table, written_once

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def place_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined columns that P is made of, one row per line item."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supp_geo = supp.join(F.broadcast(geo(spark, sf_dir)), supp.s_nationkey == F.col("n_nationkey"))
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp_geo, li.l_suppkey == supp_geo.s_suppkey)
    return j.select(*li.columns, "p_name", "p_type", "p_brand", "n_name", "r_name")


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of_lines(place_lines(spark, sf_dir))


def place_rows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P for queries that read it many times: the joins run once, and their
    narrow columns are written to the shared folder (names and types repeat,
    so a row takes a few bytes); what is derived from them is not stored."""
    return rows_of_lines(written_once(place_lines(spark, sf_dir), "place-lines"))


def rows_of_lines(j: DataFrame) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    ok, ln, pk, sk = (F.col(c) for c in ORDER)

    def s(e):
        return (e % 11).cast("int")

    return j.select(
        F.col("p_name").alias("place"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("p_type").alias("place_type"),
        F.col("p_brand").alias("blog_source"),
        F.when(ln % 4 == 0, F.lit(None))
        .otherwise(
            F.concat(
                F.lit("https://maps.example.com/?q="),
                F.replace(F.col("p_name"), F.lit(" "), F.lit("+")),
                F.lit("&s="),
                sk.cast("string"),
            )
        )
        .alias("google_maps_url"),
        F.concat_ws(" ", "p_name", "p_type", "l_returnflag").alias("description"),
        s(q).alias("romance"),
        s(pk).alias("family"),
        s(sk).alias("cost"),
        s(ok).alias("nature"),
        s(ok + ln).alias("adventure"),
        s(ln).alias("culture"),
        F.when(ok % 13 == 0, F.lit(None)).otherwise(s(pk + sk)).alias("food"),
        s(pk * 3 + ln).alias("relaxation"),
        s(q + sk).alias("service"),
        s(ok * 7 + pk).alias("accessibility"),
        "l_returnflag",
        *ORDER,
    )


P_SQL = """
SELECT p.p_name AS place, n.n_name AS country, r.r_name AS region, p.p_type AS place_type,
       p.p_brand AS blog_source,
       CASE WHEN l.l_linenumber % 4 = 0 THEN NULL
            ELSE 'https://maps.example.com/?q=' || replace(p.p_name, ' ', '+') || '&s=' || CAST(l.l_suppkey AS VARCHAR)
       END AS google_maps_url,
       p.p_name || ' ' || p.p_type || ' ' || l.l_returnflag AS description,
       CAST(CAST(l.l_quantity AS INTEGER) % 11 AS INTEGER) AS romance,
       CAST(l.l_partkey % 11 AS INTEGER) AS family,
       CAST(l.l_suppkey % 11 AS INTEGER) AS cost,
       CAST(l.l_orderkey % 11 AS INTEGER) AS nature,
       CAST((l.l_orderkey + l.l_linenumber) % 11 AS INTEGER) AS adventure,
       CAST(l.l_linenumber % 11 AS INTEGER) AS culture,
       CASE WHEN l.l_orderkey % 13 = 0 THEN NULL ELSE CAST((l.l_partkey + l.l_suppkey) % 11 AS INTEGER) END AS food,
       CAST((l.l_partkey * 3 + l.l_linenumber) % 11 AS INTEGER) AS relaxation,
       CAST((CAST(l.l_quantity AS INTEGER) + l.l_suppkey) % 11 AS INTEGER) AS service,
       CAST((l.l_orderkey * 7 + l.l_partkey) % 11 AS INTEGER) AS accessibility,
       l.l_returnflag, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
