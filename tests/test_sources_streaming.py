"""CSV dialect (A1, A2, A15, T1, T2, T5), pages (H19, H20, C19, F3, D7),
registry (A11, D14, C23), JSON labels (A12, B6, K1), streaming (I1-I3)."""

import os

import pytest
from pyspark.sql import functions as F

from wayfarer.operators.merge import merge_catalog
from wayfarer.operators.reviews import admit_reviews, append_reviews, review_record
from wayfarer.operators.training import label_vector, ordinal_ids, read_labelled, unlabelled, write_labelled
from wayfarer.schemas import CATEGORIES, NEW_DATA
from wayfarer.session import shared_path
from wayfarer.sources.csv import read_csv_dir, with_folder_country, with_maps_alias
from wayfarer.sources.pages import filter_links, html_to_text, page_links, top_links, unseen
from wayfarer.sources.registry import explode_registry, read_registry, select_tasks
from wayfarer.streaming.ingest import file_stream, mean_view, read_current, review_stream, running_means, seed_catalog, seen_filter, stream_merge
from wayfarer.streaming.store import BucketStore, replaced


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_row_positions(spark, tmp_dir):
    _w(f"{tmp_dir}/x/a.csv", "place,description\n" + "".join(f'"p{i}","line\n{i}"\n' for i in range(50)))
    _w(f"{tmp_dir}/x/b.csv", "place,description\nq0,d\nq1,d\n")
    df = read_csv_dir(spark, f"file://{tmp_dir}/x")
    rows = sorted((r._file.rsplit("/", 1)[-1], r._row, r.place) for r in df.collect())
    assert [(f, n, p) for f, n, p in rows if f == "a.csv"] == [("a.csv", i, f"p{i}") for i in range(50)]
    assert [(n, p) for f, n, p in rows if f == "b.csv"] == [(0, "q0"), (1, "q1")]


def test_csv_headers_by_name_bom_multiline_na(spark, tmp_dir):
    _w(f"{tmp_dir}/Spain/a.csv", '\ufeffplace,description,region\n"Alhambra","Line one\nline two",N/A\n')
    _w(f"{tmp_dir}/Laos/b.csv", ' description , place ,country,map_link\n"Wat","Pha That",,http://m\n')
    _w(f"{tmp_dir}/Laos/c_enriched.csv", "place,description\nskip,me\n")
    df = read_csv_dir(spark, f"file://{tmp_dir}", exclude_substrings=("_enriched", "_unified"))
    df = with_maps_alias(with_folder_country(df))
    got = sorted((r.place, r.country, r.description, r.region, r.google_maps_url) for r in df.collect())
    assert got == [
        ("Alhambra", "Spain", "Line one\nline two", None, None),
        ("Pha That", "Laos", "Wat", None, "http://m"),
    ]


PAGE = (
    '<html><head><title>T</title><script>var a="<a href=\\"/no\\">";</script></head><body>'
    '<nav><a href="/menu">menu</a></nav><p>Hello <b>world</b></p>'
    '<a href="/post/1">p1</a><a href="https://x.com/post/1">dup</a><a href="/tag/x">t</a>'
    '<a href="https://other.org/a">o</a><footer>foot</footer></body></html>'
)


def test_html_text_drops_subtrees():
    assert html_to_text(PAGE) == "T Hello world p1 dup t o"


def test_links_filter_top_and_unseen(spark):
    pages = spark.createDataFrame([(1, "https://x.com/en/1", PAGE + '<!-- <a href="/hidden">h</a> -->')], "page_id long, url string, html string")
    links = page_links(pages)
    assert [r.link for r in links.orderBy("pos").collect()][:2] == ["https://x.com/menu", "https://x.com/post/1"]
    top = top_links(filter_links(links), 100)
    got = [r.link for r in top.orderBy("rank").collect()]
    assert got == ["https://x.com/menu", "https://x.com/post/1"]
    seen = spark.createDataFrame([("https://x.com/menu",)], "source_url string")
    assert [r.link for r in unseen(top, seen).collect()] == ["https://x.com/post/1"]


def test_registry_roundtrip(spark, tmp_dir):
    _w(
        f"{tmp_dir}/reg/blogs.json",
        '[{"blog_name": "B1", "base_url": "https://b1", "destinations": [{"country": "Spain", "category_url": "u1"}, {"country": "Laos", "category_url": "u2"}]},'
        ' {"blog_name": "B2", "base_url": "https://b2", "destinations": [{"country": "Laos", "category_url": "u3"}]}]',
    )
    t = explode_registry(read_registry(spark, f"file://{tmp_dir}/reg", multiline=True))
    assert t.count() == 3
    assert sorted(r.blog_name for r in select_tasks(t, country="Laos").collect()) == ["B1", "B2"]
    assert select_tasks(t, blog="B1", country="Laos").count() == 1


def test_labelled_json_resume(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, review string")
    df = ordinal_ids(df, ["doc_id"]).withColumn("distribution", F.create_map(*[x for c in CATEGORIES for x in (F.lit(c.capitalize()), F.lit(5))]))
    assert [r.review_id for r in df.orderBy("doc_id").collect()] == [f"th-r-{i:05d}" for i in range(5)]
    path = shared_path(spark, "lab")
    write_labelled(df.where("doc_id < 2"), path)
    todo = unlabelled(df, read_labelled(spark, path), "review_id")
    assert todo.count() == 3
    write_labelled(todo, path)
    back = read_labelled(spark, path).withColumn("v", label_vector())
    assert back.count() == 5 and back.first().v == [0.5] * 10


def _rows(spark, rows):
    return spark.createDataFrame(rows, "seq long, country string, place string, description string, " + ", ".join(f"{c} double" for c in CATEGORIES))


def _event_like(n):
    """Rows of few places in three countries; scores that no single merge rounds alike."""
    return [(i, "ABZ"[i % 3], f"P{i % 5}" if i % 7 else "Q", f"d{i}" if i % 4 else None, *[float((i * k) % 10) for k in range(1, 11)]) for i in range(1, n)]


@pytest.mark.parametrize("files", [[40], [1, 2, 3, 30, 4], [13, 13, 14], [1] * 40])
def test_any_cut_into_files_gives_the_batch_merge(spark, files):
    base = _rows(spark, [(0, "A", "P1", "base", *[5.0] * 10), (0, "A", "P9", "only", *[3.0] * 10), (0, "B", "P2", "b", *[2.0] * 10)])
    base = base.drop("seq").withColumn("description_count", F.lit(2).cast("long"))
    rows = _event_like(41)
    drop, at = shared_path(spark, "t-drop"), 0
    for k, n in enumerate(files):
        _rows(spark, rows[at : at + n][::-1]).coalesce(1).write.parquet(f"{drop}/f{k:02d}")
        at += n
    cat = shared_path(spark, "t-cat")
    seed_catalog(base, cat)
    stream_merge(file_stream(spark, f"{drop}/*", _rows(spark, rows[:1]).schema, max_files=1), cat, ["seq"], buckets=4)
    got = read_current(spark, cat, as_of="2024-01-01")
    want = merge_catalog(base, _rows(spark, rows), ["seq"], as_of="2024-01-01", new_countries="summary")
    cols = sorted(want.columns)
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    assert {r.merge_status for r in want.collect()} == {"merged", "unchanged", "new", "new_country"}


def test_store_rewrites_only_the_touched_bucket(spark):
    path = shared_path(spark, "t-store")
    first = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, x long")
    store = BucketStore(spark, path, ["k"], first.schema, buckets=8)
    assert store.read().count() == 0
    assert len(store.upsert(first, 1, replaced(["k"]))) > 4
    before = store.pointer()
    touched = store.upsert(spark.createDataFrame([("k7", 700)], first.schema), 2, replaced(["k"]))
    assert len(touched) == 1 and os.listdir(f"{path.removeprefix('file:')}/data/v=2").count(f"bucket={touched[0]}") == 1
    assert {b: v for b, v in store.pointer().items() if v == 2} == {touched[0]: 2}
    assert {b: v for b, v in store.pointer().items() if b != touched[0]} == {b: v for b, v in before.items() if b != touched[0]}
    assert {r.k: r.x for r in store.read().collect()} == {f"k{i}": 700 if i == 7 else i for i in range(40)}
    # run again: the same result, from the version before it
    added = lambda a, b: a.unionByName(b).groupBy("k").agg(F.sum("x").alias("x"))
    more = spark.createDataFrame([("k1", 5), ("new", 1)], first.schema)
    for _ in range(2):
        store.upsert(more, 3, added)
    got = {r.k: r.x for r in store.read().collect()}
    assert got["k1"] == 6 and got["new"] == 1 and len(got) == 41


def test_a_store_keeps_its_pointer_when_an_upsert_dies(spark):
    path = shared_path(spark, "t-store")
    rows = spark.createDataFrame([("a", 1)], "k string, x long")
    store = BucketStore(spark, path, ["k"], rows.schema, buckets=2)
    store.upsert(rows, 1, replaced(["k"]))

    def dies(current, new):
        return replaced(["k"])(current, new.withColumn("x", F.raise_error(F.lit("lost")).cast("long")))

    with pytest.raises(Exception, match="lost"):
        store.upsert(spark.createDataFrame([("a", 2)], rows.schema), 2, dies)
    assert [tuple(r) for r in store.read().collect()] == [("a", 1)]


def test_running_mean_and_seen(spark):
    rows = _rows(spark, [(i, "A", "P" if i % 2 else "Q", "d", *[float(i)] * 10) for i in range(6)])
    drop = shared_path(spark, "t-drop2")
    rows.write.partitionBy("seq").parquet(drop)
    store = running_means(file_stream(spark, drop, rows.drop("seq").schema, max_files=2), shared_path(spark, "t-mean"))
    m = {r.place: r.romance for r in mean_view(store.read()).collect()}
    assert m == {"P": 3.0, "Q": 2.0}
    seen_out = shared_path(spark, "t-seen")
    seen_filter(spark, file_stream(spark, drop, rows.drop("seq").schema, max_files=1), "place", seen_out)
    assert sorted(r.place for r in spark.read.parquet(seen_out).collect()) == ["P", "Q"]


def test_csv_exclusions_by_suffix_and_any_columns(spark, tmp_dir):
    _w(f"{tmp_dir}/a_processed.csv", "place,combined_description\nA,text a\n")
    _w(f"{tmp_dir}/a_enriched.csv", "place,combined_description\nskip,x\n")
    _w(f"{tmp_dir}/my trips/b.csv", "place,combined_description,n\nB,text b,1\n")
    df = read_csv_dir(spark, f"file://{tmp_dir}", exclude_suffixes=("_enriched.csv",))
    got = sorted((r.place, r.combined_description, r.n, r._folder) for r in df.collect())
    assert [x[:3] for x in got] == [("A", "text a", None), ("B", "text b", "1")] and got[1][3] == "my trips"
    only = read_csv_dir(spark, f"file://{tmp_dir}", glob="*_processed.csv")
    assert [r.place for r in only.collect()] == ["A"]


def test_one_review_is_admitted_logged_and_streamed_back(spark):
    catalog = spark.createDataFrame([("Wat Arun", "TH", "Bangkok", "Temple", "https://m")], "place string, country string, region string, place_type string, google_maps_url string")
    record = {"place": "Wat Arun", "description": " lovely ", "romance": 7.0}
    one = review_record(spark, record)
    assert one.count() == 1 and one.columns == NEW_DATA.names and one.first().description == " lovely "
    log = shared_path(spark, "log")
    for text, new in (("lovely", False), (" ", False), ("unknown place", True)):
        r = review_record(spark, {**record, "description": text}).select("place", "country", "description").withColumn("is_new_place", F.lit(new))
        if new:
            r = r.withColumn("place", F.lit("Nowhere"))
        append_reviews(admit_reviews(r, catalog).where("admitted = 1").withColumn("review_date", F.lit("2024-05-01 10:30")), log)
    back = spark.read.parquet(log)
    assert [(r.place, r.country, r.description) for r in back.collect()] == [("Wat Arun", "TH", "lovely")]
    out = shared_path(spark, "log-out")
    q = review_stream(spark, log, back.schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert str(spark.read.parquet(out).first().review_date) == "2024-05-01 10:30:00"


def test_pages_reach_python_in_slices(spark, monkeypatch):
    """the text and the extractor's input are bounded slices."""
    from wayfarer.sources.pages import extract_places, page_text

    monkeypatch.setattr("wayfarer.session.SLICE_ROWS", 4)
    pages = spark.range(0, 30, 1, 1).selectExpr("id AS page_id", "'u' AS url", "if(id = 3, null, concat('<p>a', id, '</p><script>x</script>')) AS html").coalesce(1)
    got = {r.page_id: r.text for r in page_text(pages).collect()}
    assert got == {i: "" if i == 3 else f"a{i}" for i in range(30)}

    def extractor(texts, countries):
        return texts.map(lambda _: '{"places": [{"place": "p%d", "country": "c", "description": "d"}]}' % len(texts))

    texts = pages.selectExpr("page_id", "html AS text", "'c' AS country")
    assert {r.place for r in extract_places(texts, extractor=extractor).collect()} <= {"p1", "p2", "p3", "p4"}
