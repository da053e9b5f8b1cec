"""Catalogue queries: streaming ingest.

Events become new place rows: country = 'C' || user_id % 7, place =
event_type, description = event_type || ' ' || props, ten scores from the
value and the id.  They are written as files (one per event day) into a drop
folder under the shared checkpoint directory and consumed as a file stream.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.summary import place_summary
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import NL2, strip
from wayfarer.schemas import CATEGORIES
from wayfarer.session import shared_path, table
from wayfarer.streaming.ingest import file_stream, mean_view, read_current, running_means, seed_catalog, seen_filter, stream_merge


def event_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cols = {c: ((F.col("event_id") + k) % 11).cast("int") for k, c in enumerate(CATEGORIES)}
    cols["romance"] = (F.floor(F.col("value")) % 11).cast("int")
    return e.select(
        "event_id",
        F.concat(F.lit("C"), (F.col("user_id") % 7).cast("string")).alias("country"),
        F.col("event_type").alias("place"),
        F.concat_ws(" ", "event_type", "props").alias("description"),
        *[v.alias(c) for c, v in cols.items()],
        F.to_date("ts").alias("day"),
    )


def _drop_folder(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    path = shared_path(spark, "drop")
    rows.write.partitionBy("day").parquet(path)
    return rows.drop("day").schema, path


EVENTS_SQL = f"""SELECT event_id, 'C' || CAST(user_id % 7 AS VARCHAR) AS country, event_type AS place,
  event_type || ' ' || props AS description,
  {', '.join(('CAST(floor(value) % 11 AS INTEGER)' if c == 'romance' else f'CAST((event_id + {k}) % 11 AS INTEGER)') + f' AS {c}' for k, c in enumerate(CATEGORIES))}
FROM events"""


_MERGE_SQL = f"""WITH e AS ({EVENTS_SQL}),
cut AS (SELECT (min(event_id) + max(event_id)) // 2 AS m FROM e),
old AS (SELECT * FROM e, cut WHERE event_id <= m AND country <> 'C6' AND place <> 'error'),
new AS (SELECT * FROM e, cut WHERE NOT (event_id <= m AND country <> 'C6' AND place <> 'error')),
txt AS (SELECT country, place, array_to_string(list(v ORDER BY s)[1:3], {NL2}) AS description
        FROM (SELECT country, place, {strip('description')} AS v, min(event_id) AS s FROM old GROUP BY ALL) GROUP BY ALL),
b AS (SELECT country, place, count(*) AS n, t.description,
             {', '.join(f"round_even({'least(greatest(avg(cost) * 2, 0), 10)' if c == 'cost' else f'avg({c})'}, 0) AS {c}" for c in CATEGORIES)}
      FROM old JOIN txt t USING (country, place) GROUP BY country, place, t.description),
top AS (SELECT country, place, list(description ORDER BY rn) AS top
        FROM (SELECT *, row_number() OVER (PARTITION BY country, place ORDER BY event_id) AS rn FROM new) WHERE rn <= 5 GROUP BY ALL),
a AS (SELECT country, place, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in CATEGORIES)},
             {', '.join(f'arg_min({c}, event_id) AS f_{c}' for c in CATEGORIES)}, arg_min(description, event_id) AS f_description
      FROM new GROUP BY ALL),
j AS (SELECT coalesce(b.country, a.country) AS country, coalesce(b.place, a.place) AS place,
             CASE WHEN b.n IS NOT NULL AND a.n IS NOT NULL THEN 'merged' WHEN b.n IS NOT NULL THEN 'unchanged'
                  WHEN coalesce(b.country, a.country) IN (SELECT country FROM b) THEN 'new' ELSE 'new_country' END AS merge_status,
             {', '.join(f'b.{c} AS b_{c}, a.{c} AS a_{c}, f_{c}' for c in CATEGORIES)}, b.n AS b_n, a.n AS a_n, top,
             b.description AS b_description, f_description
      FROM b FULL OUTER JOIN a ON b.country = a.country AND b.place = a.place
      LEFT JOIN top t ON t.country = a.country AND t.place = a.place)
SELECT country, place, merge_status,
  {', '.join(f"""CAST(CASE merge_status WHEN 'merged' THEN round_even(round((b_{c} * b_n + a_{c} * a_n) / (b_n + a_n), 9), 1)
     WHEN 'unchanged' THEN b_{c} WHEN 'new' THEN f_{c} ELSE round_even(round(a_{c}, 9), 1) END AS DOUBLE) AS {c}""" for c in CATEGORIES)},
  CASE merge_status WHEN 'merged' THEN b_n + a_n WHEN 'unchanged' THEN b_n WHEN 'new' THEN 1 ELSE a_n END AS description_count,
  md5(CASE merge_status WHEN 'merged' THEN array_to_string(list_concat(string_split(b_description, {NL2}), top)[1:5], {NL2})
      WHEN 'unchanged' THEN b_description WHEN 'new' THEN f_description ELSE array_to_string(top, {NL2}) END) AS description_md5
FROM j"""


@query("stream_merge", sql=_MERGE_SQL)
def q_stream_merge(spark, sf_dir):
    """The catalogue is seeded with the summary of the first half of the
    events but those of one country and one place; all others arrive as a file
    stream, several files per micro-batch.  However the files are cut, the
    catalogue is that of one batch merge, which the oracle states."""
    rows = event_rows(spark, sf_dir)
    cut = rows.agg(F.expr("(min(event_id) + max(event_id)) DIV 2 AS m")).first()["m"]
    old = (F.col("event_id") <= cut) & (F.col("country") != "C6") & (F.col("place") != "error")
    seed = place_summary(rows.where(old), ["event_id"], as_of="2024-06-01")
    cat = shared_path(spark, "stream-catalog")
    seed_catalog(seed.withColumns({c: F.col(c).cast("double") for c in CATEGORIES}), cat)
    drop = shared_path(spark, "drop")
    rows.where(~old).write.partitionBy("day").parquet(drop)
    stream_merge(file_stream(spark, drop, rows.drop("day").schema, max_files=5), cat, ["event_id"], buckets=8)
    out = read_current(spark, cat, as_of="2024-07-01")
    return out.select("country", "place", "merge_status", *CATEGORIES, "description_count", F.md5("description").alias("description_md5"))


@query(
    "stream_running_mean",
    sql=f"""SELECT country, place, count(*) AS n, {', '.join(f'round(avg({c}), 4) AS {c}' for c in CATEGORIES)}
FROM ({EVENTS_SQL}) GROUP BY country, place""",
)
def q_stream_running_mean(spark, sf_dir):
    """Streaming (sum, count) state per place over every event file."""
    schema, drop = _drop_folder(spark, sf_dir)
    store = running_means(file_stream(spark, drop, schema, max_files=10), shared_path(spark, "running-mean"), buckets=8)
    m = mean_view(store.read())
    return m.select("country", "place", "n", *[F.round(c, 4).alias(c) for c in CATEGORIES])


@query("stream_seen", sql="SELECT DISTINCT event_type || ':' || CAST(user_id % 7 AS VARCHAR) AS source_url FROM events")
def q_stream_seen(spark, sf_dir):
    """A stream of 'URLs' (event type per country) where only unseen ones pass."""
    schema, drop = _drop_folder(spark, sf_dir)
    s = file_stream(spark, drop, schema, max_files=10).select(
        F.concat(F.col("place"), F.lit(":"), F.substring("country", 2, 10)).alias("source_url"), "event_id"
    )
    out = shared_path(spark, "seen")
    seen_filter(spark, s, "source_url", out)
    return spark.read.parquet(out).select("source_url")
