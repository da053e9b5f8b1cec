"""Serving: facets, filters, thresholds, ranking and display fields
(C11-C13, C25-C28, C34, C35, E11, E17, F6).

Everything is a projection or filter over the catalogue; facets are
``distinct`` (partial aggregate); ranking uses ``orderBy().limit(k)``, which
Spark runs as a per-task top-k merged once (TakeOrderedAndProject), never a
global single-task sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.text import capitalize, strip
from wayfarer.schemas import THRESHOLD_CATEGORIES

# --- fixed values: place-type icons shown in the timeline, default last ---
TYPE_ICONS = [
    ("Hotel", "\U0001F3E8"),
    ("Restaurant", "\U0001F37D️"),
    ("Museum", "\U0001F3DB️"),
    ("Park", "\U0001F333"),
    ("Beach", "\U0001F3D6️"),
]
DEFAULT_ICON = "\U0001F4CD"
# --- end of fixed values ---


def facet_countries(df: DataFrame) -> DataFrame:
    """Distinct non-NULL countries, sorted."""
    return df.where(F.col("country").isNotNull()).select("country").distinct().orderBy("country")


def facet_regions(df: DataFrame, country: str | None = None) -> DataFrame:
    """Distinct non-blank regions (per country, or of one country), sorted."""
    if country is not None:
        df = df.where(F.col("country") == country)
    r = df.where(F.col("region").isNotNull() & (strip("region") != ""))
    return r.select("country", "region").distinct().orderBy("country", "region")


def place_type_or_general(c: Column | None = None) -> Column:
    """NULL place type displays as 'General' (Q12: used by both facet and filter)."""
    return strip(F.coalesce(c if c is not None else F.col("place_type"), F.lit("General")))


def facet_types(df: DataFrame) -> DataFrame:
    """Place types with NULL -> 'General', stripped, non-blank, sorted."""
    t = df.select(place_type_or_general().alias("place_type"))
    return t.where(F.col("place_type") != "").distinct().orderBy("place_type")


def search_place(df: DataFrame, name: str) -> DataFrame:
    """C11: exact global place search (all countries)."""
    return df.where(F.col("place") == F.lit(name))


def filter_places(
    df: DataFrame,
    country: str | None = None,
    region: str | None = None,
    types: list[str] | None = None,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Country / region equality, place-type IN, minimum scores (AND)."""
    conds = []
    if country is not None:
        conds.append(F.col("country") == F.lit(country))
    if region is not None:
        conds.append(F.col("region") == F.lit(region))
    if types:
        conds.append(place_type_or_general().isin(*types))
    for c, t in (thresholds or {}).items():
        conds.append(F.col(c) >= F.lit(t))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def combined_score(cats: list[str]) -> Column:
    """Row-wise mean of the chosen categories, NULLs ignored."""
    vals = F.filter(F.array(*[F.col(c).cast("double") for c in cats]), lambda x: x.isNotNull())
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))


def rank_places(df: DataFrame, cats: list[str], k: int | None = None) -> DataFrame:
    """order by combined score descending (ties by place, country); top-k if ``k``."""
    scored = df.withColumn("combined_score", combined_score(cats))
    ordered = scored.orderBy(F.col("combined_score").desc_nulls_last(), "place", "country")
    return ordered.limit(k) if k else ordered


def _fmt_score(c: str) -> Column:
    return F.concat(F.lit("**"), F.lit(c.capitalize()), F.lit(":** "), F.col(c).cast("string"))


def score_label(cats: list[str] = THRESHOLD_CATEGORIES) -> Column:
    """C25: '**Cat:** v • …' over categories with a score > 0."""
    parts = [F.when(F.col(c) > 0, _fmt_score(c)) for c in cats]
    return F.concat_ws(" • ", *parts)


def selected_label(cats: list[str]) -> Column:
    """Every chosen category, also when 0."""
    return F.concat_ws(" • ", *[_fmt_score(c) for c in cats])


def location_line(sep: str = " | ") -> Column:
    """C26: 'country' plus 'sep region' when the region is not blank."""
    r = F.col("region")
    has = r.isNotNull() & (strip(r) != "")
    return F.concat(F.col("country").cast("string"), F.when(has, F.concat(F.lit(sep), r)).otherwise(F.lit("")))


def based_on(count_col: str = "description_count") -> Column:
    """C26: 'Based on n description(s)' when the count is positive."""
    n = F.col(count_col)
    return F.when(
        n > 0,
        F.concat(F.lit("Based on "), n.cast("bigint").cast("string"), F.lit(" description"), F.when(n.cast("bigint") != 1, F.lit("s")).otherwise(F.lit(""))),
    )


def type_icon(c: Column | None = None) -> Column:
    """Place type -> icon, default pin."""
    c = c if c is not None else F.col("place_type")
    e = None
    for t, icon in TYPE_ICONS:
        e = F.when(c == t, F.lit(icon)) if e is None else e.when(c == t, F.lit(icon))
    return e.otherwise(F.lit(DEFAULT_ICON))


def card_fields(df: DataFrame, index_col: str) -> DataFrame:
    """Itinerary card text: numbered upper-case title (> 40 chars -> 37 + '...'),
    type badge (upper, 13 chars, only when not blank), 'country, region', first 90
    chars of the stripped description, and per-category bar fill (clamped at 10)
    plus the shown integer (non-numeric -> 0)."""
    title = F.concat((F.col(index_col) + 1).cast("string"), F.lit(". "), F.upper(F.col("place").cast("string")))
    title = F.when(F.length(title) > 40, F.concat(F.substring(title, 1, 37), F.lit("..."))).otherwise(title)
    pt = F.col("place_type")
    badge = F.when(pt.isNotNull() & (strip(pt) != ""), F.substring(F.upper(pt), 1, 13))
    desc = F.substring(strip(F.coalesce(F.col("description").cast("string"), F.lit(""))), 1, 90)
    cols = [title.alias("title"), badge.alias("badge"), location_line(", ").alias("location"), desc.alias("card_description")]
    from wayfarer.schemas import CATEGORIES

    for c in CATEGORIES:
        v = F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
        cols.append((F.least(v, F.lit(10.0)) / 10).alias(f"{c}_bar"))
        cols.append(v.cast("bigint").alias(f"{c}_shown"))
    return df.select("*", *cols)


def capitalize_col(c: str) -> Column:
    return capitalize(F.col(c))
