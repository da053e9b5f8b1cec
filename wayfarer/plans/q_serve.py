"""Catalogue queries: facets, filters, thresholds, ranking, display fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.serve import (
    based_on,
    combined_score,
    facet_countries,
    facet_regions,
    facet_types,
    filter_places,
    location_line,
    score_label,
    search_place,
    selected_label,
    type_icon,
)
from wayfarer.plans.q_summary import summary_of_p
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import strip, summary_sql, with_p
from wayfarer.schemas import THRESHOLD_CATEGORIES

S = with_p(f"s AS ({summary_sql()})")
PT = strip("coalesce(place_type, 'General')")
RANK_CATS = ["nature", "culture", "romance"]
THRESHOLDS = {"nature": 3, "culture": 2, "romance": 4}


@query("facets_country", sql=S + "\nSELECT DISTINCT country FROM s WHERE country IS NOT NULL")
def q_facets_country(spark, sf_dir):
    return facet_countries(summary_of_p(spark, sf_dir))


@query(
    "facets_region",
    sql=S + f"\nSELECT DISTINCT country, region FROM s WHERE region IS NOT NULL AND {strip('region')} <> ''",
)
def q_facets_region(spark, sf_dir):
    return facet_regions(summary_of_p(spark, sf_dir))


@query(
    "facets_type",
    sql=S
    + f"\nSELECT DISTINCT place_type FROM (SELECT {PT} AS place_type FROM s) WHERE place_type <> ''",
)
def q_facets_type(spark, sf_dir):
    return facet_types(summary_of_p(spark, sf_dir))


@query(
    "filter_search",
    sql=S + "\nSELECT place, country, region, place_type, description_count FROM s WHERE country = 'NATION_7' AND region = 'ASIA'",
)
def q_filter_search(spark, sf_dir):
    f = filter_places(summary_of_p(spark, sf_dir), country="NATION_7", region="ASIA")
    return f.select("place", "country", "region", "place_type", "description_count")


@query(
    "filter_types",
    sql=S
    + f"\nSELECT place, country, place_type FROM s WHERE country = 'NATION_5' AND {PT} IN ('ECONOMY', 'SMALL')",
)
def q_filter_types(spark, sf_dir):
    f = filter_places(summary_of_p(spark, sf_dir), country="NATION_5", types=["ECONOMY", "SMALL"])
    return f.select("place", "country", "place_type")


_COMB = "(" + " + ".join(f"coalesce({c}, 0)" for c in RANK_CATS) + ") / nullif(" + " + ".join(
    f"CAST({c} IS NOT NULL AS INTEGER)" for c in RANK_CATS
) + ", 0)"


@query(
    "threshold_rank",
    sql=S
    + f"""
SELECT row_number() OVER (ORDER BY combined_score DESC NULLS LAST, place, country) AS rank, place, country,
       round(combined_score, 4) AS combined_score
FROM (SELECT place, country, {_COMB} AS combined_score FROM s
      WHERE {' AND '.join(f'{c} >= {t}' for c, t in THRESHOLDS.items())})""",
)
def q_threshold_rank(spark, sf_dir):
    """Every row that meets the thresholds, with its rank; ranks come from a
    distributed sort, not from one task's window."""
    from wayfarer.operators.training import ordinal_positions

    f = filter_places(summary_of_p(spark, sf_dir), thresholds=THRESHOLDS)
    scored = f.withColumn("combined_score", combined_score(RANK_CATS)).select("place", "country", "combined_score")
    ranked = ordinal_positions(scored, [F.col("combined_score").desc_nulls_last(), F.col("place"), F.col("country")])
    return ranked.select(
        (F.col("position") + 1).alias("rank"), "place", "country", F.round("combined_score", 4).alias("combined_score")
    )


def _label_sql(cats, positive=True):
    parts = []
    for c in cats:
        item = f"'**{c.capitalize()}:** ' || CAST({c} AS VARCHAR)"
        parts.append(f"CASE WHEN {c} > 0 THEN {item} END" if positive else item)
    return f"concat_ws(' • ', {', '.join(parts)})"


@query(
    "score_label",
    sql=S
    + f"\nSELECT place, country, {_label_sql(THRESHOLD_CATEGORIES)} AS score_label, {_label_sql(['nature', 'food', 'cost'], False)} AS selected_label FROM s",
)
def q_score_label(spark, sf_dir):
    s = summary_of_p(spark, sf_dir)
    return s.select("place", "country", score_label().alias("score_label"), selected_label(["nature", "food", "cost"]).alias("selected_label"))


@query(
    "place_lookup",
    sql=S
    + f"""
SELECT place, country, country || CASE WHEN region IS NOT NULL AND {strip('region')} <> '' THEN ' | ' || region ELSE '' END AS location,
       {_label_sql(THRESHOLD_CATEGORIES)} AS score_label, description
FROM s WHERE place = 'red widget'""",
)
def q_place_lookup(spark, sf_dir):
    s = search_place(summary_of_p(spark, sf_dir), "red widget")
    return s.select("place", "country", location_line().alias("location"), score_label().alias("score_label"), "description")


@query(
    "location_line",
    sql=S
    + f"""
SELECT place, country, country || CASE WHEN region IS NOT NULL AND {strip('region')} <> '' THEN ' | ' || region ELSE '' END AS location,
  CASE WHEN description_count > 0 THEN 'Based on ' || CAST(description_count AS VARCHAR) || ' description'
       || CASE WHEN description_count <> 1 THEN 's' ELSE '' END END AS based_on
FROM s""",
)
def q_location_line(spark, sf_dir):
    s = summary_of_p(spark, sf_dir)
    return s.select("place", "country", location_line().alias("location"), based_on().alias("based_on"))


_KIND = {"MEDIUM": "Hotel", "STANDARD": "Restaurant", "PROMO": "Museum", "ECONOMY": "Park", "LARGE": "Beach"}


def _kind_col():
    e = None
    for k, v in _KIND.items():
        e = F.when(F.col("place_type") == k, F.lit(v)) if e is None else e.when(F.col("place_type") == k, F.lit(v))
    return e.otherwise(F.col("place_type"))


def _icon_sql():
    from wayfarer.operators.serve import DEFAULT_ICON, TYPE_ICONS

    kind = "CASE place_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " ELSE place_type END"
    icon = "CASE kind " + " ".join(f"WHEN '{t}' THEN '{i}'" for t, i in TYPE_ICONS) + f" ELSE '{DEFAULT_ICON}' END"
    return f"SELECT place, country, kind, {icon} AS icon FROM (SELECT place, country, {kind} AS kind FROM s)"


@query("type_icon", sql=S + "\n" + _icon_sql())
def q_type_icon(spark, sf_dir):
    s = summary_of_p(spark, sf_dir).select("place", "country", _kind_col().alias("kind"))
    return s.select("place", "country", "kind", type_icon(F.col("kind")).alias("icon"))
