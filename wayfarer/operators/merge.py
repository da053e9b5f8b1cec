"""Incremental merge of new rows into the catalogue.

One plan instead of per-place loops:

* new rows become a mergeable state per (country, place): count, unrounded
  sums, first row, first five descriptions - partial aggregates, so a hot place
  never lands whole in one task, and a stream can add to the state;
* the base keeps its first row per place (``min_by`` over the arrival key);
* a single full-outer equi-join on (country, place) labels every place
  unchanged / merged / new;
* countries absent from the base keep all their new rows as they are (Q8).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.aggs import round_half_even_1, seq_struct
from wayfarer.functions.text import split_blank_line
from wayfarer.schemas import CATEGORIES
from wayfarer.session import written_once

KEY = ["country", "place"]
CATALOG_TEXT = ["place", "country", "google_maps_url", "description", "region", "place_type", "blog_source"]
STAMPS = {"description_count": "bigint", "last_updated": "date"}
OUT_COLS = CATALOG_TEXT + CATEGORIES + list(STAMPS)


def _as_of(as_of):
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.strftime("%Y-%m-%d")
    return F.to_date(F.lit(as_of))


def keep_first(df: DataFrame, order_cols: list[str], keys: list[str] = KEY) -> DataFrame:
    """first row per key in arrival order (bounded: WindowGroupLimit k=1)."""
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def _with_catalog_cols(df: DataFrame) -> DataFrame:
    for c in CATALOG_TEXT:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    for c in CATEGORIES:
        df = df.withColumn(c, F.col(c).cast("double")) if c in df.columns else df.withColumn(c, F.lit(None).cast("double"))
    return df


def place_state(new: DataFrame, order_cols: list[str], max_descriptions: int = 5) -> DataFrame:
    """Mergeable state of new rows, one row per (country, place): the number of
    rows ``n``, unrounded ``sum_c`` and ``cnt_c`` of each category, ``first``
    (arrival and columns of the first row) and ``texts`` (arrival and text of
    the first ``max_descriptions`` descriptions).

    Any split of the rows gives the same state once its parts are combined.
    The sums are plain partial aggregates; of a hot place only its first rows
    move (``row_number() <= k`` limits them before the shuffle).
    """
    new = _with_catalog_cols(new)
    sums = new.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum_{c}") for c in CATEGORIES],
        *[F.count(c).alias(f"cnt_{c}") for c in CATEGORIES],
    )
    payload = [c for c in CATALOG_TEXT + CATEGORIES if c not in KEY] + [c for c in STAMPS if c in new.columns]
    seq = seq_struct(order_cols)
    w = Window.partitionBy(*KEY).orderBy("_s")
    top = new.select(*KEY, seq.alias("_s"), *payload).withColumn("_rn", F.row_number().over(w))
    top = top.where(F.col("_rn") <= max_descriptions)
    firsts = top.groupBy(*KEY).agg(
        F.min_by(F.struct("_s", *payload), "_rn").alias("first"),
        F.array_sort(F.collect_list(F.struct("_s", F.col("description").alias("t")))).alias("texts"),
    )
    same = F.lit(True)
    for c in KEY:  # null keys are groups like any other
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return sums.alias("l").join(firsts.alias("r"), same).select("l.*", "r.first", "r.texts")


def combine_states(a: DataFrame, b: DataFrame, max_descriptions: int = 5) -> DataFrame:
    """The state of all rows of two states (each has a place at most once)."""
    both = a.unionByName(b)
    numbers = [c for c in a.columns if c == "n" or c.startswith(("sum_", "cnt_"))]
    return both.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in numbers],
        F.min_by("first", "first._s").alias("first"),
        F.slice(F.array_sort(F.flatten(F.collect_list("texts"))), 1, max_descriptions).alias("texts"),
    )


def _catalog(base: DataFrame, base_order: list[str] | None) -> DataFrame:
    base = _with_catalog_cols(base)
    for c, kind in STAMPS.items():
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast(kind))
    return keep_first(base, base_order) if base_order else base


def merge_state(
    base: DataFrame, state: DataFrame, as_of=None, max_descriptions: int = 5, known: DataFrame | None = None
) -> DataFrame:
    """The catalogue after the rows of ``state`` are merged into ``base`` (one
    row per place): catalogue columns + ``merge_status`` in
    {unchanged, merged, new, new_country}.

    Places of a country without a base are summarised: mean scores (one
    decimal), the first descriptions, the number of rows.  ``known``: the
    distinct countries of ``base``, if the caller has them.
    """
    today = _as_of(as_of)
    base = _catalog(base, None)
    known = base.select("country").distinct() if known is None else known
    countries = known.withColumn("_known", F.lit(True))
    b = base.select(*[F.col(c).alias(f"_b_{c}") if c not in KEY else F.col(c) for c in OUT_COLS])
    # presence flags that do not depend on nullable payload columns
    j = b.withColumn("_in_base", F.lit(True)).join(state.withColumn("_in_new", F.lit(True)), KEY, "full_outer")
    # free text: whether it is small enough to broadcast is the planner's call
    j = j.join(countries, "country", "left")
    in_base, in_new = (F.coalesce(F.col(c), F.lit(False)) for c in ("_in_base", "_in_new"))
    status = F.when(in_base & in_new, "merged").when(in_base, "unchanged").when(F.col("_known"), "new").otherwise("new_country")
    j = j.withColumn("_st", status)

    oc = F.coalesce(F.col("_b_description_count"), F.lit(1)).cast("bigint")
    total = oc + F.col("n")
    have = state.schema["first"].dataType.names
    top = F.transform("texts", lambda x: x["t"])

    def pick(c):
        if c in KEY:
            return F.col(c)
        old, first = F.col(f"_b_{c}"), F.col(f"first.{c}") if c in have else F.lit(None)
        merged, summary = old, first
        if c == "description":
            known = F.coalesce(split_blank_line("_b_description"), F.array().cast("array<string>"))
            merged = F.array_join(F.slice(F.concat(known, top), 1, max_descriptions), "\n\n")
            summary = F.array_join(top, "\n\n")
        elif c in CATEGORIES:
            mean = F.when(F.col(f"cnt_{c}") > 0, F.col(f"sum_{c}") / F.col(f"cnt_{c}"))
            merged = round_half_even_1((old * oc + mean * F.col("n")) / total)
            summary = round_half_even_1(mean)
        elif c == "description_count":
            merged, summary, first = total, F.col("n"), F.coalesce(first, F.lit(1)).cast("bigint")
        elif c == "last_updated":
            merged = summary = today
            first = F.coalesce(first.cast("date"), today)
        at = F.when(F.col("_st") == "merged", merged).when(F.col("_st") == "unchanged", old)
        return at.when(F.col("_st") == "new", first).otherwise(summary).alias(c)

    return j.select(*[pick(c) for c in OUT_COLS], F.col("_st").alias("merge_status"))


def merge_catalog(
    base: DataFrame,
    new: DataFrame,
    new_order: list[str],
    base_order: list[str] | None = None,
    as_of=None,
    max_descriptions: int = 5,
    fuzzy: bool = False,
    new_countries: str = "rows",
) -> DataFrame:
    """Merge ``new`` (normalised, scored rows) into ``base`` (catalogue rows).

    Output: catalogue columns + ``merge_status`` in
    {unchanged, merged, new, new_country}.

    ``fuzzy``: names of new rows are first resolved against the catalogue's
    (``resolve_against``: its names lead in ``base_order``, by default by
    place); the default matches names exactly.  ``new_countries``: rows of a
    country without a base stay as they are ("rows") or are summarised, one row
    per place ("summary").
    """
    if new_countries not in ("rows", "summary"):
        raise ValueError(f"new_countries: {new_countries}")
    base = _catalog(base, base_order)
    new = _with_catalog_cols(new)
    known = written_once(base.select("country").distinct(), "countries")  # read several times
    if fuzzy:
        from wayfarer.operators.resolve import resolve_against

        inside = new.join(known, "country", "left_semi")
        inside = resolve_against(inside, base, ["country"], "place", new_order, base_order or ["place"], out_col="_name")
        inside = inside.withColumn("place", F.col("_name")).drop("_name")
        new = inside.select(new.columns).unionByName(new.join(known, "country", "left_anti"))
    if new_countries == "summary":
        return merge_state(base, place_state(new, new_order, max_descriptions), as_of, max_descriptions, known)
    state = place_state(new.join(known, "country", "left_semi"), new_order, max_descriptions)
    merged = merge_state(base, state, as_of, max_descriptions, known)
    today = _as_of(as_of)
    fresh = new.join(known, "country", "left_anti")
    count = F.coalesce(F.col("description_count"), F.lit(1)) if "description_count" in new.columns else F.lit(1)
    stamp = F.coalesce(F.col("last_updated").cast("date"), today) if "last_updated" in new.columns else today
    fresh = fresh.withColumn("description_count", count.cast("bigint")).withColumn("last_updated", stamp)
    return merged.unionByName(fresh.select(*OUT_COLS, F.lit("new_country").alias("merge_status")))


def merge_stats(merged: DataFrame) -> DataFrame:
    """Number of places per country and merge status."""
    return merged.groupBy("country", "merge_status").agg(F.count(F.lit(1)).alias("places"))
