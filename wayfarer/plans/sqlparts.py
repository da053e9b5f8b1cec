"""SQL fragments shared by the DuckDB oracles (valid DuckDB SQL)."""

from __future__ import annotations

from wayfarer.plans.places import P_SQL
from wayfarer.schemas import CATEGORIES, PLACEHOLDER_PHRASES

SEQ = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
NL2 = "chr(10) || chr(10)"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def placeholder(x: str) -> str:
    low = f"lower({strip(x)})"
    return "(" + f"{low} = '' OR " + " OR ".join(f"strpos({low}, '{p}') > 0" for p in PLACEHOLDER_PHRASES) + ")"


def clean(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR lower({strip(x)}) IN ('nan','none','null') THEN '' ELSE {strip(x)} END"


def with_p(extra: str = "") -> str:
    return f"WITH p AS ({P_SQL}){(', ' + extra) if extra else ''}"


def summary_sql(src: str = "p", as_of: str = "2024-06-01") -> str:
    """The place summary over relation ``src`` as a SELECT (used as a CTE body)."""
    meta = ",\n".join(
        f"arg_min({c}, {SEQ}) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ["google_maps_url", "region", "place_type", "blog_source"]
    )
    avgs = ",\n".join(f"avg({c}) AS {c}" for c in CATEGORIES)

    def score(c):
        v = f"coalesce(a.{c}, 0)"
        if c == "cost":
            v = f"least(greatest({v} * 2, 0), 10)"
        return f"CAST(round_even({v}, 0) AS INTEGER) AS {c}"

    return f"""
SELECT a.country, a.place,
       coalesce(a.google_maps_url, '') AS google_maps_url, coalesce(a.region, '') AS region,
       coalesce(a.place_type, '') AS place_type, coalesce(a.blog_source, '') AS blog_source,
       coalesce(d3.description, '') AS description,
       {', '.join(score(c) for c in CATEGORIES)},
       a.description_count, '{as_of}' AS last_updated
FROM (SELECT country, place, {meta}, {avgs}, count(*) AS description_count
      FROM {src} WHERE place IS NOT NULL GROUP BY country, place) a
LEFT JOIN (
  SELECT country, place, string_agg(v, {NL2} ORDER BY s) AS description
  FROM (SELECT *, row_number() OVER (PARTITION BY country, place ORDER BY s) AS rn
        FROM (SELECT country, place, {strip('description')} AS v, min({SEQ}) AS s
              FROM {src} WHERE place IS NOT NULL AND description IS NOT NULL GROUP BY 1, 2, 3))
  WHERE rn <= 3 GROUP BY 1, 2) d3
ON a.country = d3.country AND a.place = d3.place
"""
