"""Catalogue queries over the page table: links, filters, top-100, seen URLs,
page text, extraction, URL choice, registry, JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.functions.urls import url_netloc, url_path_segment, url_scheme
from wayfarer.operators.itinerary import insert_if_absent
from wayfarer.plans.registry import query
from wayfarer.schemas import LINK_EXCLUDE
from wayfarer.session import shared_path, table
from wayfarer.sources.pages import (
    choose_urls,
    extract_places,
    filter_links,
    page_links,
    page_text,
    records_from_json,
    top_links,
    unseen,
)
from wayfarer.sources.registry import explode_registry, read_registry, select_tasks, write_registry

U = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)'"
# Links that the pages lack, put in front of them: other spellings of the tag
# and attribute, navigation links, and one page in ten with 150 links.
HARD = """<A data-href="/no" title='a > b' HREF=/bare/{id}><a title='href="/fake"' href='/tag/{id}'><a
 class=x href = "/two">2</a><abbr href="/abbr"><a name=top>"""

# The oracle cuts tags at '<a' and lists a tag's attributes, so it shares no
# pattern with the operator.
_PAIR = r"""[^\s=>/"'']+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)"""
_HARD_SQL = "'" + HARD.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{id}", "' || CAST(page_id AS VARCHAR) || '") + "'"
LINKS_SQL = f"""noisy AS (
  SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN {_HARD_SQL} ELSE '' END ||
    CASE WHEN page_id % 10 = 1 THEN array_to_string(list_transform(range(1, 151), lambda i: '<a href="/n/' || i || '">n</a>'), '') ELSE '' END
    || html AS html FROM pages),
tags AS (SELECT page_id, url, string_split_regex(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'),
                                                 '(?i)<a[\\s/]')[2:] AS t FROM noisy),
attrs AS (SELECT page_id, url, list_transform(t, lambda x: list_filter(regexp_extract_all(regexp_extract(x, '^(?:[^>"'']|"[^"]*"|''[^'']*'')*'),
                                                                        '{_PAIR}'), lambda y: regexp_matches(y, '(?i)^href\\s*='))) AS found FROM tags),
hrefs AS (SELECT page_id, url, list_transform(list_filter(found, lambda f: len(f) > 0), lambda f: regexp_replace(f[1], '^[^=]*=\\s*', '')) AS raw FROM attrs),
links AS (
  SELECT page_id, url, pos, href,
         CASE WHEN href LIKE '/%' THEN lower(regexp_extract(url, {U}, 1)) || '://' || regexp_extract(url, {U}, 2) || href
              ELSE href END AS link
  FROM (SELECT page_id, url,
               replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS href,
               pos
        FROM (SELECT page_id, url, CASE WHEN v[1] IN ('"', '''') THEN v[2:-2] ELSE v END AS h, pos
              FROM (SELECT page_id, url, unnest(raw) AS v, generate_subscripts(raw, 1) - 1 AS pos FROM hrefs)))),
filtered AS (SELECT * FROM links WHERE strpos(link, regexp_extract(url, {U}, 2)) > 0
             AND {' AND '.join(f"strpos(link, '{x}') = 0" for x in LINK_EXCLUDE)}),
top AS (SELECT page_id, url, link, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank
        FROM (SELECT page_id, url, link, min(pos) AS pos FROM filtered GROUP BY 1, 2, 3))"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _noisy_pages(spark, sf_dir):
    i = F.col("page_id")
    hard = F.when(i % 3 == 0, F.replace(F.lit(HARD), F.lit("{id}"), i.cast("string"))).otherwise(F.lit(""))
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: F.concat(F.lit('<a href="/n/'), k.cast("string"), F.lit('">n</a>'))), "")
    return _pages(spark, sf_dir).withColumn("html", F.concat(hard, F.when(i % 10 == 1, many).otherwise(F.lit("")), F.col("html")))


@query("page_links", sql=f"WITH {LINKS_SQL} SELECT page_id, pos, href, link FROM links")
def q_page_links(spark, sf_dir):
    return page_links(_noisy_pages(spark, sf_dir)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "link")


@query("link_filter", sql=f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM filtered")
def q_link_filter(spark, sf_dir):
    return filter_links(page_links(_noisy_pages(spark, sf_dir))).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("link_top100", sql=f"WITH {LINKS_SQL} SELECT page_id, link, rank FROM top WHERE rank <= 100")
def q_link_top100(spark, sf_dir):
    t = top_links(filter_links(page_links(_noisy_pages(spark, sf_dir))), 100)
    return t.select("page_id", "link", F.col("rank").cast("bigint"))


_SITE = f"""site AS (SELECT page_id, link, rank, regexp_extract(url, {U}, 2) AS blog,
                  coalesce(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/')[2], '') AS country
           FROM top),
seen AS (SELECT blog, country, link FROM site WHERE rank % 2 = 0 UNION ALL SELECT blog, 'elsewhere', link FROM site WHERE rank % 3 = 0)"""


@query(
    "unseen_urls",
    sql=f"""WITH {LINKS_SQL}, {_SITE}
SELECT page_id, link FROM site s
WHERE NOT EXISTS (SELECT 1 FROM seen k WHERE k.blog = s.blog AND k.country = s.country AND k.link = s.link)""",
)
def q_unseen_urls(spark, sf_dir):
    """Links not yet scraped for their blog and country.  Of every page's
    links the even ones were; others only under another country, so they stay."""
    site = top_links(filter_links(page_links(_noisy_pages(spark, sf_dir)))).withColumns(
        {"blog": url_netloc("url"), "country": url_path_segment("url", 1)}
    )
    here = site.where("rank % 2 = 0").select("blog", "country", F.col("link").alias("source_url"))
    other = site.where("rank % 3 = 0").select("blog", F.lit("elsewhere").alias("country"), F.col("link").alias("source_url"))
    return unseen(site, here.unionByName(other), per=["blog", "country"]).select("page_id", "link")


@query("url_choice_stub", sql=f"WITH {LINKS_SQL} SELECT page_id, link FROM top")
def q_url_choice_stub(spark, sf_dir):
    """J7 with the default chooser (keep all) followed by the domain check C20."""
    t = top_links(filter_links(page_links(_noisy_pages(spark, sf_dir))))
    return choose_urls(t).select("page_id", "link")


@query("page_text")
def q_page_text(spark, sf_dir):
    """Visible text of every page (whole text)."""
    t = page_text(_pages(spark, sf_dir))
    return t.select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_len"))


@query("extract_stub")
def q_extract_stub(spark, sf_dir):
    """J6 with the deterministic sentence extractor; requested country = the
    page's first path segment."""
    t = page_text(_pages(spark, sf_dir)).withColumn("country", url_path_segment("url", 1))
    r = extract_places(t, "country")
    return r.select("page_id", "place", "extracted_country", F.md5("description").alias("description_md5"))


def registry(spark, sf_dir):
    """Registry derived from the pages: blog = host, destination per path country."""
    p = _pages(spark, sf_dir).select(
        url_netloc("url").alias("blog_name"),
        F.concat(url_scheme("url"), F.lit("://"), url_netloc("url")).alias("base_url"),
        url_path_segment("url", 1).alias("country"),
        "url",
    )
    d = p.groupBy("blog_name", "base_url", "country").agg(F.min("url").alias("category_url"))
    return d.groupBy("blog_name", "base_url").agg(
        F.array_sort(F.collect_list(F.struct("country", "category_url"))).alias("destinations")
    )


REG_SQL = f"""reg AS (SELECT regexp_extract(url, {U}, 2) AS blog_name,
                    lower(regexp_extract(url, {U}, 1)) || '://' || regexp_extract(url, {U}, 2) AS base_url,
                    coalesce(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/')[2], '') AS country,
                    min(url) AS category_url
             FROM pages GROUP BY 1, 2, 3)"""


@query("registry_explode", sql=f"WITH {REG_SQL} SELECT blog_name, base_url, country, category_url FROM reg")
def q_registry_explode(spark, sf_dir):
    path = shared_path(spark, "registry")
    write_registry(registry(spark, sf_dir), path)
    return explode_registry(read_registry(spark, path))


@query("task_select", sql=f"WITH {REG_SQL} SELECT blog_name, country, category_url FROM reg WHERE country = 'en'")
def q_task_select(spark, sf_dir):
    t = explode_registry(registry(spark, sf_dir))
    return select_tasks(t, blog="All", country="en").select("blog_name", "country", "category_url")


@query(
    "insert_if_absent",
    sql=f"""WITH {REG_SQL}, ex AS (SELECT DISTINCT blog_name, country FROM reg WHERE country <> 'de'),
cand AS (SELECT DISTINCT upper(blog_name) AS blog_name, upper(country) AS country FROM reg)
SELECT blog_name, country FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM ex WHERE lower(ex.blog_name) = lower(c.blog_name) AND lower(ex.country) = lower(c.country))""",
)
def q_insert_if_absent(spark, sf_dir):
    """Destinations whose country (case-insensitive) is new within the blog."""
    t = explode_registry(registry(spark, sf_dir))
    existing = t.where(F.col("country") != "de").select(F.lower("blog_name").alias("b"), "country")
    cand = t.select(F.upper("blog_name").alias("blog_name"), F.upper("country").alias("country")).distinct()
    cand = cand.withColumn("b", F.lower("blog_name"))
    return insert_if_absent(existing, cand, ["b"], "country").select("blog_name", "country")


@query(
    "json_records",
    sql="""SELECT conv_id, turn, role || ' ' || CAST(conv_id AS VARCHAR) AS place,
  CASE WHEN turn % 3 = 0 THEN 'en' ELSE CASE WHEN turn % 3 = 1 THEN 'EN' ELSE 'english' END END AS extracted_country,
  md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS description_md5
FROM conversations
WHERE turn % 4 <> 3""",
)
def q_json_records(spark, sf_dir):
    """H17 + C21 + C22: conversations rendered as extracted-place JSON, parsed back
    with a schema; country '' (filled), 'EN', 'english' (plausible) or 'fr'
    (implausible, dropped) by turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    t = F.col("turn")
    ext = F.when(t % 4 == 3, F.lit("fr")).when(t % 3 == 0, F.lit("")).when(t % 3 == 1, F.lit("EN")).otherwise(F.lit("english"))
    rec = F.struct(
        F.concat_ws(" ", "role", F.col("conv_id").cast("string")).alias("place"),
        ext.alias("country"),
        F.lit("").alias("region"),
        F.lit("").alias("place_type"),
        F.lit("N/A").alias("google_maps_url"),
        F.col("text").alias("description"),
    )
    j = c.select("conv_id", "turn", F.lit("en").alias("req"), F.to_json(F.struct(F.array(rec).alias("places"))).alias("js"))
    r = records_from_json(j, "js", "req")
    return r.select("conv_id", "turn", "place", "extracted_country", F.md5("description").alias("description_md5"))
