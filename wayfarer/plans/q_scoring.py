"""Catalogue queries: scoring paths (C14-C17, C30-C32, E10, H11, J1, J3) and the
description gate (C16, H18, H22).

Documents act as places (country = lang, place = source); existing scores are
complete for doc_id % 3 = 0, half present for doc_id % 3 = 1, absent otherwise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.scoring import KEYWORDS, default_scores, overlay_scores, rebuild_scores, score_struct
from wayfarer.operators.summarise import NO_DESCRIPTION, description_gate, summarise
from wayfarer.operators.summary import category_means
from wayfarer.plans.docs import NOISY_SQL, noisy_value
from wayfarer.plans.places import place_rows
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import strip, with_p
from wayfarer.schemas import CATEGORIES
from wayfarer.session import table


def docs_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    i = F.col("doc_id")
    cols = {}
    for k, c in enumerate(CATEGORIES):
        e = F.when(i % 3 == 0, (i + k) % 11)
        if k < 5:
            e = e.when(i % 3 == 1, (i * 2 + k) % 11)
        cols[c] = e.cast("int")
    return d.select("doc_id", F.col("lang").alias("country"), F.col("source").alias("place"), F.col("text").alias("description"), *[v.alias(c) for c, v in cols.items()])


def _score_col_sql(c, k):
    e = f"CASE WHEN doc_id % 3 = 0 THEN CAST((doc_id + {k}) % 11 AS INTEGER)"
    if k < 5:
        e += f" WHEN doc_id % 3 = 1 THEN CAST((doc_id * 2 + {k}) % 11 AS INTEGER)"
    return e + f" END AS {c}"


DOCS_PLACES_SQL = (
    "SELECT doc_id, lang AS country, source AS place, text AS description, "
    + ", ".join(_score_col_sql(c, k) for k, c in enumerate(CATEGORIES))
    + " FROM documents"
)
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in CATEGORIES)


def _kw_sql(c, text):
    low = f"lower({text})"
    kw = KEYWORDS[c]
    cnt = f"((length({low}) - length(replace({low}, '{kw}', ''))) // {len(kw)})"
    n = f"length({low})"
    dens = f"(CASE WHEN {n} > 0 THEN {cnt} * 100.0 / {n} ELSE 0.0 END)"
    return f"round_even(least(greatest(({dens} / 10.0) * 10.0, 0.0), 10.0), 0)"


def _r4(cols):
    return [F.round(F.col(c), 4).alias(c) for c in cols]


@query(
    "score_overlay",
    sql=f"""SELECT doc_id, CAST(({COMPLETE}) AS INTEGER) AS complete,
  {', '.join(f'round(CASE WHEN {COMPLETE} THEN CAST({c} AS DOUBLE) ELSE {_kw_sql(c, "description")} END, 4) AS {c}' for c in CATEGORIES)}
FROM ({DOCS_PLACES_SQL})""",
)
def q_score_overlay(spark, sf_dir):
    d = docs_places(spark, sf_dir)
    complete = F.lit(True)
    for c in CATEGORIES:
        complete = complete & F.col(c).isNotNull()
    d = d.withColumn("complete", complete.cast("int"))
    return overlay_scores(d).select("doc_id", "complete", *_r4(CATEGORIES))


@query(
    "score_short_fallback",
    sql=f"""WITH d AS ({DOCS_PLACES_SQL}),
m AS (SELECT country, {', '.join(f'avg({c}) AS m_{c}' for c in CATEGORIES)} FROM d GROUP BY country)
SELECT doc_id, {', '.join(f'''round(CASE WHEN length({strip('description')}) < 200 THEN m_{c}
   ELSE {_kw_sql(c, strip('description'))} END, 4) AS {c}''' for c in CATEGORIES)}
FROM d JOIN m USING (country)""",
)
def q_score_short_fallback(spark, sf_dir):
    r = rebuild_scores(docs_places(spark, sf_dir), force=True)
    return r.select("doc_id", *_r4(CATEGORIES))


@query(
    "score_default",
    sql=f"""SELECT doc_id, {', '.join(f'CASE WHEN {COMPLETE} THEN CAST({c} AS DOUBLE) ELSE coalesce(CAST({c} AS DOUBLE), 5.0) END AS {c}' for c in CATEGORIES)}
FROM ({DOCS_PLACES_SQL})""",
)
def q_score_default(spark, sf_dir):
    return default_scores(docs_places(spark, sf_dir)).select("doc_id", *CATEGORIES)


@query("score_struct")
def q_score_struct(spark, sf_dir):
    """Struct-valued 1-5 scorer (nine categories, crowded, short summary)."""
    return score_struct(docs_places(spark, sf_dir)).select("doc_id", "romance", "nature", "crowded", "short_summary")


def _gate_input(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return d.select(
        "doc_id",
        F.col("lang").alias("country"),
        F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 60).cast("string")).alias("place"),
        noisy_value().alias("description"),
    )


_WC = "(CASE WHEN {x} = '' THEN 0 ELSE len(string_split_regex({x}, '\\s+')) END)"


_GATE_SQL = f"""WITH d AS (SELECT doc_id, lang AS country, source || '/' || CAST(doc_id % 60 AS VARCHAR) AS place,
                  {NOISY_SQL} AS description FROM documents),
v AS (SELECT country, place, {strip('description')} AS v, min(doc_id) AS s FROM d
      WHERE description IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT country, place, list(v ORDER BY s) AS l
      FROM (SELECT *, row_number() OVER (PARTITION BY country, place ORDER BY s) AS rn FROM v) WHERE rn <= 3
      GROUP BY 1, 2),
g AS (SELECT country, place, list_filter(l, lambda x: x <> '') AS va FROM t)"""


@query(
    "description_gate",
    sql=f"""{_GATE_SQL}
SELECT country, place, len(va) AS n_valid,
  CASE WHEN len(va) = 0 THEN 'none' WHEN len(va) = 1 AND {_WC.format(x='va[1]')} < 15 THEN 'verbatim' ELSE 'summarise' END AS gate,
  md5(CASE WHEN len(va) = 0 THEN '{NO_DESCRIPTION}' WHEN len(va) = 1 AND {_WC.format(x='va[1]')} < 15 THEN va[1]
      ELSE array_to_string(list_transform(va, lambda x: '- ' || x), chr(10)) END) AS text_md5
FROM g""",
)
def q_description_gate(spark, sf_dir):
    g = description_gate(_gate_input(spark, sf_dir), ["country", "place"], "description", ["doc_id"])
    return g.select("country", "place", F.col("n_valid").cast("bigint").alias("n_valid"), "gate", F.md5("text").alias("text_md5"))


@query(
    "category_means",
    sql=with_p()
    + f"""
SELECT country, 5.0::DOUBLE AS service, NULL::DOUBLE AS relaxation,
       {', '.join(f'avg({c}) AS {c}' for c in CATEGORIES if c not in ('service', 'relaxation'))}
FROM p GROUP BY country""",
)
def q_category_means(spark, sf_dir):
    """A missing column counts as 5, one that is all NULL has no mean."""
    p = place_rows(spark, sf_dir).drop("service").withColumn("relaxation", F.lit(None).cast("int"))
    m = category_means(p)
    return m.select("country", *CATEGORIES)


_LEAD = f"""array_to_string(list_transform(list_filter(list_transform(
  string_split(array_to_string(va, chr(10) || '- '), chr(10) || '- '), lambda x: {strip('x')}), lambda x: x <> ''),
  lambda x: rtrim(string_split(x, '. ')[1], '.') || '.'), ' ')"""


@query(
    "summary_texts",
    sql=f"""{_GATE_SQL}
SELECT country, place, gate, md5(CASE gate WHEN 'none' THEN '{NO_DESCRIPTION}' WHEN 'verbatim' THEN va[1] ELSE {_LEAD} END) AS text_md5
FROM (SELECT *, CASE WHEN len(va) = 0 THEN 'none' WHEN len(va) = 1 AND {_WC.format(x='va[1]')} < 15 THEN 'verbatim'
                     ELSE 'summarise' END AS gate FROM g)""",
)
def q_summary_texts(spark, sf_dir):
    """One summary per place: the gate's own texts, or the summariser's."""
    g = description_gate(_gate_input(spark, sf_dir), ["country", "place"], "description", ["doc_id"])
    return summarise(g).select("country", "place", "gate", F.md5("text").alias("text_md5"))
