"""Itineraries and exports (B8, C29, C33, C36, D9-D11, D15, E12, E13, E15, E16,
F4, F5, F7, G2, G3, G6, G7, H7, H9).

Itineraries are one long table ``(route, seq, day, <catalogue columns>)``;
``seq`` is the insertion order within a route.  Per-route strings (directions
URL, KML) are built with one ordered aggregation per route; the string of a
route, the result itself, is one row.  Positions within routes come from
``segmented_positions``, sections from the route's distinct days, so a route
with a third of all stops is never sorted whole inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.aggs import round_half_even_1
from wayfarer.functions.text import strip, xml_escape
from wayfarer.operators.ordering import segmented_positions
from wayfarer.session import written_once

# --- fixed values: export formats ---
DIRECTIONS_BASE = "https://www.google.com/maps/dir/"
KML_HEADER = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<kml xmlns="http://www.opengis.net/kml/2.2">\n'
    "  <Document><name>Travel Itinerary Map</name>"
)
KML_FOOTER = "</Document></kml>"
KML_PLACEMARK = (
    "\n    <Placemark>\n"
    "      <name>{name}</name>\n"
    '      <description><![CDATA[{desc}<br><br><a href="{link}">Open in Google Maps</a>]]></description>\n'
    "      <address>{name}, {country}</address>\n"
    "    </Placemark>"
)
MAX_DAY_ON_ADD = 30
LINK_PATTERN = "^https://.*"
# --- end of fixed values ---

KEY = "route"


def ordered_join(df: DataFrame, keys: list[str], order_col: str, value: Column, sep: str, out: str) -> DataFrame:
    """Per-group string of ``value`` in ``order_col`` order joined by ``sep``.

    The values are shuffled once, to the task that makes the group's string:
    an order key with gaps leaves a chunk of it too few values for strings of
    chunks to save anything."""
    v = df.select(*keys, F.struct(F.col(order_col).alias("_o"), value.alias("_v")).alias("_s"))
    return v.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_s")), lambda x: x["_v"]), sep).alias(out)
    )


def trip_metrics(it: DataFrame) -> DataFrame:
    """Per route: last day, stops, distinct countries and types, mean sources (1 dec)."""
    return it.groupBy(KEY).agg(
        F.max(F.col("day").cast("string").try_cast("double")).cast("int").alias("total_days"),
        F.count(F.lit(1)).alias("places"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("place_type").alias("types"),
        round_half_even_1(F.avg("description_count")).alias("avg_sources"),
    )


def value_counts(it: DataFrame, col: str) -> DataFrame:
    """Per route counts of ``col`` values (NULLs excluded), descending:
    ``rank`` is a value's place (from 1), of equal counts the smaller value
    first.  The sort is over a route's distinct values, not over its stops."""
    counts = it.where(F.col(col).isNotNull()).groupBy(KEY, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), "value")
    return counts.select(KEY, F.lit(col).alias("facet"), "value", "n", F.row_number().over(w).cast("long").alias("rank"))


def per_day_counts(it: DataFrame) -> DataFrame:
    """Stops per (route, day)."""
    return it.groupBy(KEY, "day").agg(F.count(F.lit(1)).alias("places"))


def stop_numbers(it: DataFrame) -> DataFrame:
    """stop number = insertion position + 1, kept through any re-sort."""
    return segmented_positions(it, [KEY], ["seq"], "stop_no")


def day_sections(it: DataFrame) -> DataFrame:
    """F7 + F4: stops by day, then insertion order; a new section starts
    whenever the day differs from the previous stop's.

    Sorted by day, the stops of one day are one section, so its number is the
    day's rank among the route's distinct days: a table of one row per route
    and day.  Stops without a day come first and each is a section of its own,
    as an unknown day differs from any other."""
    days = it.where("day IS NOT NULL").select(KEY, "day").distinct()
    rank = days.withColumn("section", F.row_number().over(Window.partitionBy(KEY).orderBy("day")).cast("long"))
    unknown = it.where("day IS NULL")
    ahead = unknown.groupBy(F.col(KEY).alias("_r")).agg(F.count(F.lit(1)).alias("_ahead"))
    known = it.alias("i").join(rank.alias("d"), (F.col(f"i.{KEY}").eqNullSafe(F.col(f"d.{KEY}"))) & (F.col("i.day") == F.col("d.day")))
    known = known.select(*[F.col(f"i.{c}") for c in it.columns], "d.section").join(ahead, F.col(KEY).eqNullSafe(F.col("_r")), "left")
    known = known.withColumn("section", F.col("section") + F.coalesce("_ahead", F.lit(0))).select(*it.columns, "section")
    return known.unionByName(segmented_positions(unknown, [KEY], ["seq"], "section"))


def quote_url(c: Column) -> Column:
    """H7: percent-encoding like Python's ``quote`` (``/`` safe, space -> %20)."""
    e = F.url_encode(c)
    for a, b in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def directions_url(it: DataFrame) -> DataFrame:
    """One directions URL per route with every stop in insertion order."""
    stop = quote_url(F.concat_ws(", ", F.col("place").cast("string"), F.col("country").cast("string")))
    j = ordered_join(it, [KEY], "seq", stop, "/", "_stops")
    return j.select(KEY, F.concat(F.lit(DIRECTIONS_BASE), F.col("_stops")).alias("url"))


def kml_documents(it: DataFrame) -> DataFrame:
    """One KML document per route (text escaped for XML)."""
    name = xml_escape(F.coalesce(F.col("place").cast("string"), F.lit("")))
    desc = xml_escape(F.coalesce(F.col("description").cast("string"), F.lit("")))
    link = xml_escape(F.coalesce(F.col("google_maps_url").cast("string"), F.lit("#")))
    country = F.coalesce(F.col("country").cast("string"), F.lit(""))
    pre, rest = KML_PLACEMARK.split("{name}", 1)
    mid1, rest = rest.split("{desc}", 1)
    mid2, rest = rest.split("{link}", 1)
    mid3, rest = rest.split("{name}", 1)
    mid4, post = rest.split("{country}", 1)
    pm = F.concat(F.lit(pre), name, F.lit(mid1), desc, F.lit(mid2), link, F.lit(mid3), name, F.lit(mid4), country, F.lit(post))
    j = ordered_join(it, [KEY], "seq", pm, "", "_pm")
    return j.select(KEY, F.concat(F.lit(KML_HEADER), F.col("_pm"), F.lit(KML_FOOTER)).alias("kml"))


def write_kml(kml: DataFrame, path: str) -> None:
    """B8 sink: one text file per route folder."""
    kml.select(KEY, "kml").write.mode("overwrite").partitionBy(KEY).text(path)


def merge_routes(it: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping(route, new_route, part)``: the routes of one new route are
    concatenated in ``part`` order (duplicates kept) and re-sequenced."""
    m = it.join(mapping, KEY).drop(KEY).withColumnRenamed("new_route", KEY)
    m = segmented_positions(m, [KEY], ["part", "seq"], "_position")
    return m.withColumn("seq", F.col("_position")).drop("part", "_position")


def duplicate_routes(it: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping(route, new_route)``: copy each route under its new name."""
    return it.join(mapping, KEY).drop(KEY).withColumnRenamed("new_route", KEY)


def remove_routes(it: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop every stop of the listed routes."""
    return it.join(removed.select(KEY).distinct(), KEY, "left_anti")


def apply_day_edits(it: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(route, seq, day)`` overrides the day of those stops."""
    e = edits.select(KEY, "seq", F.col("day").alias("_new_day"))
    return it.join(e, [KEY, "seq"], "left").withColumn("day", F.coalesce("_new_day", "day")).drop("_new_day")


def add_places(it: DataFrame, additions: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """Add (route, place, ...) rows only where the route lacks the place;
    new stops are sequenced after the route's last stop, in ``order_cols``
    order (arrival), else by place.  Of several additions of one place to one
    route the first stays, as each is checked against what was added before.
    The additions that get in are written before they are numbered, so that the
    shuffles that find them are gone when those of the numbering come."""
    order = order_cols or ["place"]
    one = Window.partitionBy(KEY, "place").orderBy(*order)  # the first only: limited before the shuffle
    additions = additions.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth")
    new = written_once(additions.join(it.select(KEY, "place").distinct(), [KEY, "place"], "left_anti"), "additions")
    last = it.groupBy(KEY).agg(F.max("seq").alias("_last"))
    placed = segmented_positions(new, [KEY], [*order, "place"], "_position").join(last, KEY, "left")
    return placed.withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("_position")).drop("_last", "_position")


def export_clean(it: DataFrame, text_cols: list[str]) -> DataFrame:
    """Drop stops without a place; day -> number (bad/NULL -> 1) -> int;
    other NULL text -> ''."""
    d = F.coalesce(F.col("day").cast("string").try_cast("double"), F.lit(1.0)).cast("int")
    out = it.where(F.col("place").isNotNull()).withColumn("day", d)
    return out.fillna("", subset=[c for c in text_cols if c in it.columns])


def check_additions(adds: DataFrame, link_col: str = "google_maps_url") -> DataFrame:
    """Flag stops that break the input rules (day an integer in 1-30,
    link ``^https://``) with a reason; callers keep ``ok`` rows and report the rest."""
    day_txt = F.col("day").cast("string")
    day_num = day_txt.try_cast("double")
    bad_day = day_num.isNull() | (day_num != F.floor(day_num)) | (day_num < 1) | (day_num > MAX_DAY_ON_ADD)
    bad_link = F.col(link_col).isNull() | ~F.col(link_col).rlike(LINK_PATTERN)
    reason = F.concat_ws(",", F.when(bad_day, F.lit("day")), F.when(bad_link, F.lit("link")))
    return adds.withColumn("reason", reason).withColumn("ok", reason == "")


def new_route_names(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """A new route name must be non-blank and not taken."""
    r = requests.where(F.col(KEY).isNotNull() & (strip(KEY) != ""))
    return r.join(existing.select(KEY).distinct(), KEY, "left_anti")


def station_cards(stations: DataFrame) -> DataFrame:
    """Station card text with the source's defaults."""
    return stations.select(
        "country",
        F.upper(F.coalesce(F.col("station_name"), F.lit("Unknown"))).alias("title"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.concat(F.lit("CONTACT: "), F.coalesce(F.col("phone"), F.lit("N/A"))).alias("contact"),
        F.coalesce(F.col("link"), F.lit("#")).alias("link"),
    )


def default_stations(stations: DataFrame, per_country: int | None = None, order_col: str = "station_name") -> DataFrame:
    """D9 lookup: all stations of each country, or the first ``per_country``."""
    if per_country is None:
        return stations
    w = Window.partitionBy("country").orderBy(order_col)
    return stations.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_country).drop("_r")


def add_station_defaults(route_countries: DataFrame, defaults: DataFrame, saved: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """D9 + D10: default stations of every visited country, skipping names the
    route already saved.

    ``saved(route, station_name)`` holds names, or ``saved(route, list)`` names
    lists of ``lists(list, station_name)``.  Lists are never written out per
    route: what they leave of a country's defaults is found once for each
    country and combination of lists that a route has, so the only rows of the
    size of the result are the result."""
    if lists is None:
        d = route_countries.join(defaults, "country")
        return d.join(saved.select(KEY, "station_name").distinct(), [KEY, "station_name"], "left_anti")
    have = saved.where("list IS NOT NULL").groupBy(KEY).agg(F.array_sort(F.collect_set("list")).alias("_lists"))
    none = F.array().cast(have.schema["_lists"].dataType)
    routes = route_countries.join(have, KEY, "left").withColumn("_lists", F.coalesce("_lists", none))
    at = ["country", "_lists"]
    wanted = routes.select(*at).distinct()
    names = wanted.select(*at, F.explode("_lists").alias("list")).join(lists.distinct(), "list").select(*at, "station_name")
    left = wanted.join(defaults, "country").join(names.distinct(), [*at, "station_name"], "left_anti")
    return routes.join(left, at).drop("_lists")


def insert_if_absent(existing: DataFrame, candidates: DataFrame, keys: list[str], ci_key: str) -> DataFrame:
    """Candidates whose ``ci_key`` (case-insensitive) is not present yet
    under the same ``keys``; of candidates that differ in case only, the first
    by ``ci_key`` goes in."""
    e = existing.select(*keys, F.lower(F.col(ci_key)).alias("_k")).distinct()
    w = Window.partitionBy(*keys, "_k").orderBy(ci_key)
    c = candidates.withColumn("_k", F.lower(F.col(ci_key))).withColumn("_nth", F.row_number().over(w))
    c = c.where("_nth = 1").drop("_nth")
    return c.join(e, [*keys, "_k"], "left_anti").drop("_k")
