"""The two end-to-end flows of the source system as single lazy Spark plans.

* ``aggregate_places`` (full rebuild, steps 1-3): clean -> drop placeholders ->
  resolve near-duplicate names per country -> drop near-duplicate descriptions
  per resolved place -> first non-empty metadata over all retained rows.
* ``full_rebuild``: aggregate -> score (length gate, group means) -> summary.
* ``incremental_update``: normalise -> score only incomplete rows -> merge
  into the catalogue -> write the touched countries (dynamic overwrite).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.merge import merge_catalog, merge_stats
from wayfarer.operators.quality import drop_invalid_places, normalize_new_data
from wayfarer.operators.resolve import _cut, dedupe_descriptions, resolve_names
from wayfarer.operators.scoring import keyword_scorer, overlay_scores, rebuild_scores
from wayfarer.operators.summary import first_nonempty_metadata, place_summary
from wayfarer.sources.csv import with_folder_country, with_maps_alias


def aggregate_places(raw: DataFrame, order_cols: list[str]) -> DataFrame:
    """cleaned_places: one row per kept description with resolved place name
    and first non-empty metadata (E1, E2, E3, C1, C5)."""
    raw = with_maps_alias(raw)
    if "_folder" in raw.columns:
        raw = with_folder_country(raw)
    # lineage cuts (tables in the shared checkpoint folder): the cleaned rows and
    # the resolved rows each feed several branches; recomputing them is costlier
    # than one write each
    rows = _cut(drop_invalid_places(raw).withColumn("country", F.trim(F.col("country").cast("string"))))
    resolved = resolve_names(rows, ["country"], "place", order_cols, out_col="_resolved")
    resolved = _cut(resolved.withColumn("place", F.col("_resolved")).drop("_resolved"))
    meta = first_nonempty_metadata(resolved, order_cols)
    kept = dedupe_descriptions(resolved, ["country", "place"], "description", order_cols).where("kept")
    out = kept.select("country", "place", "description", *order_cols).join(meta, ["country", "place"])
    return out.select("place", "country", "region", "description", "place_type", "google_maps_url", "blog_source", *order_cols)


def full_rebuild(
    raw: DataFrame, order_cols: list[str], scorer: Callable = keyword_scorer, as_of=None, force: bool = True
) -> DataFrame:
    """cleaned -> scored -> catalogue (one row per place)."""
    cleaned = aggregate_places(raw, order_cols)
    scored = rebuild_scores(cleaned, scorer, force=force).drop("score_error")
    return place_summary(scored, order_cols, as_of=as_of)


def incremental_update(
    new: DataFrame,
    base: DataFrame,
    new_order: list[str],
    scorer: Callable = keyword_scorer,
    as_of=None,
    output_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Returns (merged catalogue, merge statistics); writes the touched
    countries to ``output_path`` when given."""
    norm = normalize_new_data(new)
    scored = overlay_scores(norm, scorer).drop("score_error")
    merged = merge_catalog(base, scored, new_order, as_of=as_of)
    if output_path:
        from wayfarer.sources.csv import write_catalog

        write_catalog(merged.drop("merge_status"), output_path)
    return merged, merge_stats(merged)


def update_catalog_from_folder(
    spark,
    drop_folder: str,
    catalog_path: str,
    ledger_path: str,
    scorer: Callable = keyword_scorer,
    as_of=None,
) -> DataFrame | None:
    """Batch drop-folder update (A9, B1, B7, D1): only files not yet in the
    ledger are read; only the countries they touch are read from the
    partitioned catalogue (semi-join, partition pruning) and rewritten
    (dynamic partition overwrite); the files are then recorded as processed.
    Returns the run's statistics (E19: places per country and merge status), or
    None when nothing is new."""
    from wayfarer.sources.csv import new_files_only, read_catalog, read_csv_dir, record_processed, write_catalog

    rows = new_files_only(read_csv_dir(spark, drop_folder), ledger_path)
    if rows.isEmpty():
        return None
    norm = normalize_new_data(rows.drop("_folder"))
    scored = overlay_scores(norm, scorer).drop("score_error")
    touched = scored.select("country").distinct()
    base = read_catalog(spark, catalog_path).join(touched, "country", "left_semi")
    merged = merge_catalog(base, scored, ["_file", "_row"], as_of=as_of)
    stage = catalog_path.rstrip("/") + "._next"
    merged.write.mode("overwrite").parquet(stage)  # the plan reads the catalogue (T9)
    merged = spark.read.parquet(stage)
    write_catalog(merged.drop("merge_status"), catalog_path)
    record_processed(rows, ledger_path)
    return merge_stats(merged)
