"""Published catalogue files (B1, B10), their report (E14, B9), the cached load
(A7) and links against an HTML parser (H19)."""

import os
from html.parser import HTMLParser

import pytest

from wayfarer.sources import catalog
from wayfarer.sources.catalog import finish_publish, load_catalog, publish_catalog, quality_report_files
from wayfarer.sources.csv import file_headers, read_csv_dir
from wayfarer.sources.pages import page_links, unseen

SCHEMA = "place string, country string, description string, romance double"


def rows(*changes):
    out = [("B", "Laos", 'quote " and, comma', 6.5), ("A", "Laos", "line\nbreak", None), ("Q", "Côte d'Ivoire/x", "", 7.0), ("N", None, "nowhere", 1.0)]
    return out + list(changes)


def files(folder):
    return {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".csv")}


def test_published_files_read_back_as_the_catalogue(spark, tmp_dir):
    root = f"{tmp_dir}/pub"
    names = publish_catalog(spark.createDataFrame(rows(), SCHEMA), f"file://{root}")
    assert names == ["Côte d'Ivoire%2Fx_processed.csv", "Laos_processed.csv"]
    text = files(root)["Laos_processed.csv"].decode("utf-8")
    assert text == '﻿place,country,description,romance\nA,Laos,"line\nbreak",\nB,Laos,"quote "" and, comma",6.5\n'
    back = read_csv_dir(spark, f"file://{root}", glob="*_processed.csv").orderBy("_file", "_row").collect()
    got = sorted((r.place, r.country, r.description, r.romance) for r in back)
    assert got == [("A", "Laos", "line\nbreak", None), ("B", "Laos", 'quote " and, comma', "6.5"), ("Q", "Côte d'Ivoire/x", None, "7.0")]
    # another publish replaces its countries and leaves the others
    publish_catalog(spark.createDataFrame([("Z", "Laos", "new", 1.0)], SCHEMA), f"file://{root}")
    now = files(root)
    assert now["Laos_processed.csv"].decode().endswith("\nZ,Laos,new,1.0\n") and len(now) == 2
    assert not [f for f in os.listdir(root) if f.startswith("_next")]


def test_an_interrupted_publish(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/pub"
    publish_catalog(spark.createDataFrame([("A", "Laos", "old", 1.0), ("B", "Peru", "old", 1.0)], SCHEMA), f"file://{root}")
    old = files(root)
    # phase 1 dies: the old files stay, the next publish drops the rest
    bad = spark.createDataFrame([("A", "Laos", "new", 1.0)], SCHEMA).selectExpr("place", "country", "raise_error('lost') AS description")
    with pytest.raises(Exception, match="lost"):
        publish_catalog(bad, f"file://{root}")
    assert files(root) == old
    # it dies before phase 2: finishing moves the complete files
    real = catalog.finish_publish
    calls = []
    monkeypatch.setattr(catalog, "finish_publish", lambda s, p: calls.append(1) or (real(s, p) if len(calls) == 1 else []))
    publish_catalog(spark.createDataFrame([("A", "Laos", "new", 1.0)], SCHEMA), f"file://{root}")
    assert files(root) == old
    assert finish_publish(spark, f"file://{root}") == ["Laos_processed.csv"]
    assert b"new" in files(root)["Laos_processed.csv"] and files(root)["Peru_processed.csv"] == old["Peru_processed.csv"]
    assert finish_publish(spark, f"file://{tmp_dir}/none") == []


def test_report_judges_each_file_by_its_own_header(spark, tmp_dir):
    def put(name, text):
        with open(f"{tmp_dir}/{name}", "w", encoding="utf-8") as f:
            f.write(text)

    put("a_processed.csv", "﻿place,country,description\nA,X,fine\nB,X,\nC,X,Sorry: NOT ENOUGH INFORMATION here\n")
    put("b_processed.csv", "place,country\nA,Y\n")
    put("c_processed.csv", " description ,place\n")
    put("other.csv", "x\n1\n")
    got = {r.file: tuple(r)[2:] for r in quality_report_files(spark, f"file://{tmp_dir}").collect()}
    assert got["a_processed.csv"] == (3, 0, "", 1, 1, 0)
    assert got["b_processed.csv"] == (1, 1, "description", 0, 0, 2)
    assert got["c_processed.csv"] == (0, 1, "country", 0, 0, 2)
    assert got[None] == (4, 2, None, 1, 1, 2) and len(got) == 4
    os.makedirs(f"{tmp_dir}/empty")
    assert [tuple(r) for r in quality_report_files(spark, f"file://{tmp_dir}/empty").collect()] == [(None, None, 0, 0, None, 0, 0, 1)]


def test_headers_of_files_in_many_splits_without_a_sort_of_lines(spark, tmp_dir):
    for k in range(6):
        with open(f"{tmp_dir}/f{k}.csv", "w", encoding="utf-8") as f:
            f.write("".join(f"{x}\n" for x in [f"z{k},a", *(f"{i:07d},b" for i in range(700 * k))]))
    open(f"{tmp_dir}/empty.csv", "w").close()
    sizes = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        heads = file_headers(spark, f"file://{tmp_dir}")
        assert sorted(r["header"] for r in heads.collect()) == [f"z{k},a" for k in range(6)]
        # lines were sorted by file to find the least one of each
        assert "Sort" not in heads._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cache_is_read_until_a_file_changes(spark, tmp_dir):
    root, cache = f"{tmp_dir}/pub", f"{tmp_dir}/cache"
    publish_catalog(spark.createDataFrame(rows(), SCHEMA), f"file://{root}")
    assert load_catalog(spark, f"file://{root}", f"file://{cache}").count() == 3
    again = load_catalog(spark, f"file://{root}", f"file://{cache}")
    assert os.listdir(f"{cache}/data") == ["v=1"] and again.count() == 3
    assert {f.rsplit("/", 2)[-2] for f in again.inputFiles()} == {"v=1"}
    publish_catalog(spark.createDataFrame([("Z", "Peru", "new", 1.0)], SCHEMA), f"file://{root}")
    assert load_catalog(spark, f"file://{root}", f"file://{cache}").count() == 4
    os.remove(f"{root}/Laos_processed.csv")
    assert load_catalog(spark, f"file://{root}", f"file://{cache}").count() == 2
    assert sorted(os.listdir(f"{cache}/data")) == ["v=1", "v=2", "v=3"]


class Hrefs(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        first = next((v for k, v in attrs if k == "href"), None)
        if tag == "a" and first is not None:
            self.found.append(first)


HARD = [
    '<a href="/x">1</a><A HREF=\'/y\'>2</A><a\n class=c\thref = /z >3</a>',
    '<a title="a > b" href="/q">1</a><a title=\'href="/fake"\' href=/real>2</a>',
    '<a data-href="/no">1</a><a data-href="/no" href="/yes">2</a><abbr href="/abbr">3</abbr><a name="n">4</a>',
    '<a href="/first" href="/second">1</a><a href="">2</a><area href="/area"><a/href="/slash">5</a>',
    '<a disabled href=/p?a=b&amp;c=d#e>1</a><a HrEf="x y">2</a><a href=\'it"s\'>3</a><a id=href href="/id">4</a>',
    '<!-- <a href="/hidden"> --><script>"<a href=\'/js\'>"</script><style><a href="/css"></style><a href="/shown">',
    "no links <a",
]


def test_links_agree_with_a_parser(spark):
    pages = spark.createDataFrame([(i, "https://x.com/en", h) for i, h in enumerate(HARD)] + [(99, "https://x.com/en", None)], "page_id long, url string, html string")
    got = {}
    for r in page_links(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.href)
    for i, h in enumerate(HARD):
        p = Hrefs()
        p.feed(h)
        p.close()
        assert got.get(i, []) == p.found, h
    assert 99 not in got


def test_seen_urls_of_another_blog_or_country_stay(spark):
    links = spark.createDataFrame([("b", "X", "u"), ("b", "Y", "u"), ("c", "X", "u"), (None, "X", "u")], "blog string, country string, link string")
    seen = spark.createDataFrame([("b", "X", "u"), (None, "X", "u"), ("b", "X", "v")], "blog string, country string, source_url string")
    got = unseen(links, seen, per=["blog", "country"]).collect()
    assert sorted(map(tuple, got)) == [("b", "Y", "u"), ("c", "X", "u")]
    assert unseen(links, seen).collect() == []
