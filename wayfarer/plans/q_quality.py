"""Catalogue queries: cleaning, placeholder rules, contracts, quality report, E3."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.functions.text import clean_text, clean_text_agent, is_placeholder, is_placeholder_agent
from wayfarer.operators.quality import fill_blog_source, normalize_new_data, parse_bool, quality_report, add_missing
from wayfarer.operators.summary import first_nonempty_metadata
from wayfarer.plans.docs import DOCS_NEW_SQL, NOISY_SQL, docs_new_data, noisy_docs
from wayfarer.plans.places import ORDER, place_rows
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import SEQ, clean, placeholder, strip, with_p
from wayfarer.schemas import PLACEHOLDER_PHRASES


def _clean_agent_sql(x):
    return (
        f"CASE WHEN {x} IS NULL OR lower({strip(x)}) IN ('nan','none','null','n/a') THEN '' "
        f"ELSE regexp_replace({strip(x)}, '\\s+', ' ', 'g') END"
    )


def _ph_agent_sql(x):
    low = f"lower({_clean_agent_sql(x)})"
    return "(" + f"{low} = '' OR " + " OR ".join(f"strpos({low}, '{p}') > 0" for p in PLACEHOLDER_PHRASES) + ")"


@query(
    "placeholder_filter",
    sql=f"""SELECT doc_id, CAST(coalesce({placeholder('v')}, false) AS INTEGER) AS is_placeholder,
       CAST({_ph_agent_sql('v')} AS INTEGER) AS is_placeholder_agent
FROM (SELECT doc_id, {NOISY_SQL} AS v FROM documents)""",
)
def q_placeholder_filter(spark, sf_dir):
    d = noisy_docs(spark, sf_dir)
    return d.select(
        "doc_id",
        is_placeholder("v").cast("int").alias("is_placeholder"),
        is_placeholder_agent("v").cast("int").alias("is_placeholder_agent"),
    )


@query(
    "null_clean",
    sql=f"""SELECT doc_id, md5({clean('v')}) AS clean_md5, length({clean('v')}) AS clean_len,
       md5({_clean_agent_sql('v')}) AS agent_md5, length({_clean_agent_sql('v')}) AS agent_len
FROM (SELECT doc_id, {NOISY_SQL} AS v FROM documents)""",
)
def q_null_clean(spark, sf_dir):
    d = noisy_docs(spark, sf_dir).select("doc_id", clean_text("v").alias("c"), clean_text_agent("v").alias("a"))
    return d.select(
        "doc_id",
        F.md5("c").alias("clean_md5"),
        F.length("c").cast("bigint").alias("clean_len"),
        F.md5("a").alias("agent_md5"),
        F.length("a").cast("bigint").alias("agent_len"),
    )


@query(
    "required_filter",
    sql=f"""SELECT doc_id, country, place, md5(description) AS description_md5, length(description) AS description_len
FROM (SELECT doc_id, {clean('country')} AS country, {clean('place')} AS place, {clean('text')} AS description
      FROM ({DOCS_NEW_SQL}))
WHERE country <> '' AND place <> '' AND description <> '' AND NOT {placeholder('description')}""",
)
def q_required_filter(spark, sf_dir):
    n = normalize_new_data(docs_new_data(spark, sf_dir))
    return n.select(
        "doc_id",
        "country",
        "place",
        F.md5("description").alias("description_md5"),
        F.length("description").cast("bigint").alias("description_len"),
    )


def _new_with_sources(spark, sf_dir):
    d = docs_new_data(spark, sf_dir)
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        "country",
        "place",
        "text",
        F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit("blog-"), F.col("place"))).alias("blog_source"),
        F.when(i % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("src:"), F.col("country"))).alias("source"),
        F.when(i % 4 == 0, F.lit("true")).when(i % 4 == 1, F.lit("False")).when(i % 4 == 2, F.lit(None)).otherwise(F.lit("1")).alias("is_manual_entry"),
    )


_SOURCES_SQL = f"""SELECT doc_id, country, place, text,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '  ' ELSE 'blog-' || place END AS blog_source,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src:' || country END AS source,
  CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN NULL ELSE '1' END AS is_manual_entry
FROM ({DOCS_NEW_SQL})"""


@query(
    "source_fill",
    sql=f"""WITH s AS ({_SOURCES_SQL}),
b1 AS (SELECT doc_id, is_manual_entry,
  CASE WHEN coalesce({strip('blog_source')}, '') <> '' THEN blog_source ELSE source END AS bs FROM s)
SELECT doc_id, coalesce(CASE WHEN coalesce(TRY_CAST(is_manual_entry AS BOOLEAN), false) AND coalesce({strip('bs')}, '') = ''
  THEN 'user_review' ELSE bs END, '<null>') AS blog_source,
  CAST(coalesce(TRY_CAST(is_manual_entry AS BOOLEAN), false) AS INTEGER) AS is_manual
FROM b1""",
)
def q_source_fill(spark, sf_dir):
    s = fill_blog_source(_new_with_sources(spark, sf_dir))
    return s.select(
        "doc_id",
        F.coalesce("blog_source", F.lit("<null>")).alias("blog_source"),
        parse_bool(F.col("is_manual_entry")).cast("int").alias("is_manual"),
    )


@query(
    "contract_defaults",
    sql=f"""SELECT doc_id, '' AS region, '' AS place_type, '' AS google_maps_url, '' AS blog_source,
  length({clean('text')}) AS description_len
FROM ({DOCS_NEW_SQL})""",
)
def q_contract_defaults(spark, sf_dir):
    from wayfarer.operators.quality import rename_legacy_text

    d = add_missing(rename_legacy_text(docs_new_data(spark, sf_dir)), ["region", "place_type", "google_maps_url", "blog_source"], "")
    return d.select(
        "doc_id", "region", "place_type", "google_maps_url", "blog_source", F.length(clean_text("description")).cast("bigint").alias("description_len")
    )


_PH_COUNT = "(" + " OR ".join(f"strpos(lower(coalesce(v, 'nan')), '{p}') > 0" for p in PLACEHOLDER_PHRASES) + ")"


@query(
    "quality_report",
    sql=f"""SELECT lang AS country, count(*) AS rows, 0 AS missing_required,
  sum(CASE WHEN v IS NULL OR {strip('v')} = '' THEN 1 ELSE 0 END)::BIGINT AS blank_descriptions,
  sum(CASE WHEN {_PH_COUNT} THEN 1 ELSE 0 END)::BIGINT AS placeholder_descriptions, 0 AS status
FROM (SELECT doc_id, lang, {NOISY_SQL} AS v FROM documents)
GROUP BY ROLLUP (lang)""",
)
def q_quality_report(spark, sf_dir):
    d = noisy_docs(spark, sf_dir).select(F.col("lang").alias("country"), F.lit("x").alias("place"), F.col("v").alias("description"))
    return quality_report(d)


def _p_blanks(spark, sf_dir):
    p = place_rows(spark, sf_dir)
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return p.withColumns(
        {
            "region": F.when(ok % 3 == 0, F.lit("")).otherwise(F.col("region")),
            "place_type": F.when(ln == 1, F.lit("  ")).otherwise(F.col("place_type")),
            "blog_source": F.when(ok % 5 == 0, F.lit(None)).otherwise(
                F.concat(F.col("blog_source"), F.lit("-"), F.col("l_suppkey").cast("string"))
            ),
        }
    )


_P_BLANKS_SQL = """pb AS (SELECT country, place, google_maps_url,
  CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE region END AS region,
  CASE WHEN l_linenumber = 1 THEN '  ' ELSE place_type END AS place_type,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE blog_source || '-' || CAST(l_suppkey AS VARCHAR) END AS blog_source,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p)"""


def _fne(c):
    return f"coalesce(arg_min({strip(c)}, {SEQ}) FILTER (WHERE {strip(c)} <> ''), '') AS {c}"


@query(
    "first_nonempty_metadata",
    sql=with_p(_P_BLANKS_SQL)
    + f"""
SELECT country, place, {', '.join(_fne(c) for c in ['google_maps_url', 'region', 'place_type', 'blog_source'])}
FROM pb GROUP BY country, place""",
)
def q_first_nonempty_metadata(spark, sf_dir):
    return first_nonempty_metadata(_p_blanks(spark, sf_dir), ORDER)
