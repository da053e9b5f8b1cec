"""Document-derived relations with injected null-like and placeholder values.

The driver's documents carry no NULLs, so the cases the cleaners exist for are
injected by ``doc_id`` modulus (whole texts are kept everywhere).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.session import table


def noisy_value(text_col: str = "text", id_col: str = "doc_id"):
    k = F.col(id_col) % 11
    t = F.col(text_col)
    return (
        F.when(k == 0, F.lit(None).cast("string"))
        .when(k == 1, F.lit("   "))
        .when(k == 2, F.lit(" NaN "))
        .when(k == 3, F.lit("None"))
        .when(k == 4, F.lit("n/a"))
        .when(k == 5, F.concat(t, F.lit(" There is NO specific description here.")))
        .when(k == 6, F.concat(F.lit("not enough\ninformation "), t))
        .when(k == 7, F.concat(F.lit("  "), t, F.lit("  ")))
        .otherwise(t)
    )


NOISY_SQL = """CASE doc_id % 11
  WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN ' NaN ' WHEN 3 THEN 'None' WHEN 4 THEN 'n/a'
  WHEN 5 THEN text || ' There is NO specific description here.'
  WHEN 6 THEN 'not enough' || chr(10) || 'information ' || text
  WHEN 7 THEN '  ' || text || '  '
  ELSE text END"""


def noisy_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return d.select("doc_id", "lang", "source", noisy_value().alias("v"))


def docs_new_data(spark, sf_dir):
    """Documents as incoming rows: country=lang, place=source, legacy ``text`` column."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 13 == 0, F.lit("null")).otherwise(F.col("lang")).alias("country"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(" ")).otherwise(F.col("source")).alias("place"),
        noisy_value().alias("text"),
    )


DOCS_NEW_SQL = f"""SELECT doc_id,
  CASE WHEN doc_id % 13 = 0 THEN 'null' ELSE lang END AS country,
  CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE source END AS place,
  {NOISY_SQL} AS text
FROM documents"""
