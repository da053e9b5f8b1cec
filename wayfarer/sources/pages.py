"""Web-page table as a source.

Fetching is not rebuilt: pages arrive as a table ``(page_id, url, html)``.
Links come from JVM-side expressions that read tags attribute by attribute
(unquoted, single- and double-quoted values, any case); visible text from a stdlib ``html.parser``
run on slices of Arrow batches (nested subtree drops cannot be a regex).
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions.text import clean_text_agent, is_placeholder_agent
from wayfarer.functions.urls import absolutize, html_unescape_basic, url_netloc
from wayfarer.schemas import EXTRACTED_JSON, HTML_DROP_TAGS, LINK_EXCLUDE
from wayfarer.session import with_python_columns

# one attribute: a name, and a value in double or single quotes or without
_ATTRIBUTE = r"""[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""
# an <a> tag up to its first href: attributes before it are read whole, so
# quoted text that looks like one, '>' in a value or data-href do not count
HREF_RE = rf"""(?is)<a(?:[\s/]+{_ATTRIBUTE})*?[\s/]+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))"""
# script/style bodies and comments are not markup: links inside them do not count
NON_MARKUP_RE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def page_links(pages: DataFrame) -> DataFrame:
    """H19 + H6: every ``<a href>`` of a page with its position, made absolute."""
    markup = F.regexp_replace("html", NON_MARKUP_RE, " ")
    x = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(markup, F.lit(HREF_RE), 0)).alias("pos", "tag"))
    double, single, bare = (F.regexp_extract("tag", HREF_RE, i) for i in (1, 2, 3))  # at most one is not empty
    href = html_unescape_basic(F.concat(double, single, bare))
    return x.select("page_id", "url", "pos", href.alias("href"), absolutize(href, F.col("url")).alias("link"))


def filter_links(links: DataFrame) -> DataFrame:
    """Same domain (substring of the link) and no navigation fragments."""
    dom = url_netloc("url")
    bad = None
    for x in LINK_EXCLUDE:
        c = F.col("link").contains(x)
        bad = c if bad is None else bad | c
    return links.where(F.col("link").contains(dom) & ~bad)


def top_links(links: DataFrame, k: int | None = None) -> DataFrame:
    """distinct links per page with their rank by first position; only the
    first ``k`` if given."""
    d = links.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("page_id").orderBy("pos")
    ranked = d.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k) if k else ranked


def choose_urls(links: DataFrame, chooser: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """J7 + C20: a pluggable chooser marks article links (default: keep all);
    only links containing the page's domain survive."""
    if chooser is not None:
        schema = T.StructType(links.schema.fields + [T.StructField("_keep", T.BooleanType())])

        def run(it):
            for pdf in it:
                yield pdf.assign(_keep=chooser(pdf).astype(bool).to_numpy())

        links = links.mapInPandas(run, schema).where("_keep").drop("_keep")
    return links.where(F.col("link").contains(url_netloc("url")))


def unseen(links: DataFrame, seen: DataFrame, col: str = "link", seen_col: str = "source_url", per: list[str] | None = None) -> DataFrame:
    """Drop links already scraped; with ``per`` (such as blog and country,
    columns of both tables) only under the same values of those columns."""
    known = seen.select(*(per or []), F.col(seen_col).alias(col)).distinct().alias("k")
    same = F.lit(True)
    for c in [*(per or []), col]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}"))
    return links.alias("l").join(known, same, "left_anti")


class _TextParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.drop = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HTML_DROP_TAGS:
            self.drop += 1

    def handle_endtag(self, tag):
        if tag in HTML_DROP_TAGS and self.drop:
            self.drop -= 1

    def handle_data(self, data):
        if not self.drop:
            s = data.strip()
            if s:
                self.parts.append(s)


def html_to_text(html: str) -> str:
    p = _TextParser()
    p.feed(html or "")
    p.close()
    return " ".join(p.parts)


def _texts(pages: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"text": pages["html"].map(html_to_text)}, dtype=object)


def page_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """H20 (+ F10 when ``max_chars`` is given): visible text with script, style,
    nav, footer, header, aside and form subtrees removed."""
    pages = pages.select("page_id", "url", "html")
    out = with_python_columns(pages, ["html"], _texts, [T.StructField("text", T.StringType())], keep=["page_id", "url"])
    return out.withColumn("text", F.substring("text", 1, max_chars)) if max_chars else out


def sentence_extractor(texts: pd.Series, countries: pd.Series) -> pd.Series:
    """Deterministic stand-in for the extraction model: every sentence whose
    first word is capitalised becomes a place named by its first two words."""
    import json
    import re

    out = []
    for t, c in zip(texts.fillna(""), countries.fillna("")):
        places = []
        for s in re.split(r"(?<=[.!?])\s+", t):
            w = s.split()
            if len(w) >= 3 and w[0][:1].isupper():
                places.append({"place": " ".join(w[:2]).strip(".,"), "country": c, "region": "", "place_type": "",
                               "google_maps_url": "N/A", "description": s})
        out.append(json.dumps({"places": places}))
    return pd.Series(out, index=texts.index)


def extract_places(
    texts: DataFrame, requested_country: str = "country", extractor: Callable = sentence_extractor
) -> DataFrame:
    """Page text -> pluggable extractor (JSON) -> records (H17) -> C21
    plausibility -> C22 cleaning, filled country, no empty place or placeholder."""

    def extract(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_json": extractor(pdf["text"], pdf[requested_country]).to_numpy()})

    j = with_python_columns(texts, ["text", requested_country], extract, [T.StructField("_json", T.StringType())])
    return records_from_json(j, "_json", requested_country)


def records_from_json(df: DataFrame, json_col: str, requested_country: str) -> DataFrame:
    """H17 + C21 + C22 on a JSON column holding ``{"places": [...]}``."""
    rec = df.select("*", F.explode_outer(F.from_json(F.col(json_col), EXTRACTED_JSON)["places"]).alias("r")).where(
        F.col("r").isNotNull()
    )
    req = F.lower(F.col(requested_country))
    ext = F.lower(clean_text_agent(F.col("r.country")))
    plausible = (ext == "") | ext.contains(req) | req.contains(ext)
    rec = rec.where(plausible)
    out = rec.select(
        *[c for c in df.columns if c != json_col],
        clean_text_agent(F.col("r.place")).alias("place"),
        F.when(clean_text_agent(F.col("r.country")) == "", F.col(requested_country)).otherwise(clean_text_agent(F.col("r.country"))).alias("extracted_country"),
        clean_text_agent(F.col("r.region")).alias("region"),
        clean_text_agent(F.col("r.place_type")).alias("place_type"),
        clean_text_agent(F.col("r.google_maps_url")).alias("google_maps_url"),
        clean_text_agent(F.col("r.description")).alias("description"),
    )
    return out.where((F.col("place") != "") & ~is_placeholder_agent(F.col("description")))
