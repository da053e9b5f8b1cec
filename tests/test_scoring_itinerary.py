"""Scoring paths (C15, C30-C32, E10, J1, J3), description gate (C16), itinerary
exports (C29, C36, E12, E15, F4, F5, G2, H7, H9, B8)."""

import urllib.parse

import pandas as pd
from pyspark.sql import functions as F

from wayfarer.operators import itinerary as I
from wayfarer.operators.scoring import default_scores, raw_scores, rebuild_scores, score_struct, score_text
from wayfarer.operators.summarise import NO_DESCRIPTION, description_gate, summarise
from wayfarer.schemas import CATEGORIES
from wayfarer.session import ARROW_ROWS

SCORE_DDL = ", ".join(f"{c} double" for c in CATEGORIES)


def test_keyword_scores_are_integers_in_range(spark):
    df = spark.createDataFrame([("an an an the",), ("",), (None,)], "description string")
    rows = score_text(df).collect()
    for r in rows:
        for c in CATEGORIES:
            assert 0 <= r[c] <= 10 and r[c] == int(r[c])
    assert rows[0].romance == 10  # 3 'an' in 12 chars -> 25 per 100 -> clamp


def test_length_gate_uses_group_means(spark):
    short, long_ = "short text", "x" * 250
    df = spark.createDataFrame(
        [("A", short, *[2.0] * 10), ("A", "other", *[4.0] * 10), ("A", long_, *[None] * 10)],
        "country string, description string, " + SCORE_DDL,
    )
    got = rebuild_scores(df, force=True).collect()
    by = {r.description: r for r in got}
    assert by[short].romance == 3.0  # mean of existing 2 and 4
    assert by[long_].romance == 0.0  # scorer: no 'an' in xxxx


def test_default_scores_fill_only_incomplete(spark):
    df = spark.createDataFrame([("d", 1.0, *[None] * 9), ("e", *[3.0] * 10)], "description string, " + SCORE_DDL)
    got = [r.asDict() for r in default_scores(df).orderBy("description").collect()]
    assert got[0]["romance"] == 1.0 and got[0]["food"] == 5.0
    assert got[1]["food"] == 3.0


def test_failed_rows_follow_policy(spark):
    def flaky():
        def score(texts: pd.Series) -> pd.DataFrame:
            if texts.str.contains("bad").any():
                raise ValueError("model failed")
            return pd.DataFrame({c: [0.5] * len(texts) for c in CATEGORIES}, index=texts.index)

        return score

    df = spark.createDataFrame([("good",), ("bad",)], "description string")
    r = {x.description: x for x in raw_scores(df, flaky).collect()}
    assert r["good"].romance == 0.5 and r["good"].score_error is None
    assert r["bad"].romance is None and "model failed" in r["bad"].score_error
    assert raw_scores(df, flaky, on_error="drop").count() == 1
    assert raw_scores(df, flaky, on_error="zero").where("description = 'bad'").first().romance == 0.0


def test_struct_scorer_schema(spark):
    df = spark.createDataFrame([("Hello there. Second sentence.", 1.0)], "description string, romance double")
    r = score_struct(df).first()
    assert 1 <= r.romance <= 5 and r.short_summary == "Hello there." and "food" not in r.asDict()


def test_description_gate(spark):
    rows = [
        (1, "A", None),
        (2, "B", "  "),
        (3, "C", "a short one"),
        (4, "D", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
        (5, "E", "x"),
        (6, "E", "y"),
    ]
    df = spark.createDataFrame(rows, "seq long, place string, description string")
    g = {r.place: r for r in description_gate(df, ["place"], "description", ["seq"]).collect()}
    assert g["B"].gate == "none" and g["B"].text == NO_DESCRIPTION
    assert "A" not in g  # only NULL descriptions -> no candidate text at all
    assert g["C"].gate == "verbatim" and g["C"].text == "a short one"
    assert g["D"].gate == "summarise"
    assert g["E"].text == "- x\n- y"
    s = {r.place: r.text for r in summarise(description_gate(df, ["place"], "description", ["seq"])).collect()}
    assert s["E"] == "x. y."


def _it(spark):
    rows = [
        ("R1", 1, 2, "Wat Arun & Co", "Thailand", "River <temple>", "https://m/1", "Temple", 3),
        ("R1", 2, 1, "Café ~*", "Thailand", "d2", None, None, 1),
        ("R1", 3, 2, "Old/Town", "Laos", "d3", "http://m/3", "Temple", 5),
        ("R2", 1, 31, "X", "Laos", "d", "https://m/x", "Park", 2),
    ]
    return spark.createDataFrame(
        rows,
        "route string, seq long, day int, place string, country string, description string, google_maps_url string, place_type string, description_count long",
    )


def test_directions_url_matches_python_quote(spark):
    got = {r.route: r.url for r in I.directions_url(_it(spark)).collect()}
    stops = ["Wat Arun & Co, Thailand", "Café ~*, Thailand", "Old/Town, Laos"]
    assert got["R1"] == I.DIRECTIONS_BASE + "/".join(urllib.parse.quote(s) for s in stops)


def test_kml_escapes_and_orders(spark):
    k = {r.route: r.kml for r in I.kml_documents(_it(spark)).collect()}["R1"]
    assert k.startswith(I.KML_HEADER) and k.endswith(I.KML_FOOTER)
    assert "<name>Wat Arun &amp; Co</name>" in k and "River &lt;temple&gt;" in k
    assert k.index("Wat Arun") < k.index("Café") < k.index("Old/Town")
    assert 'href="#"' in k  # missing link


def test_metrics_sections_and_stop_numbers(spark):
    it = _it(spark)
    m = {r.route: r for r in I.trip_metrics(it).collect()}
    assert (m["R1"].total_days, m["R1"].places, m["R1"].countries, m["R1"].types, m["R1"].avg_sources) == (2, 3, 2, 1, 3.0)
    s = {(r.route, r.seq): r.section for r in I.day_sections(it).collect()}
    assert s[("R1", 2)] == 1 and s[("R1", 1)] == 2 and s[("R1", 3)] == 2
    n = {(r.route, r.seq): r.stop_no for r in I.stop_numbers(it).collect()}
    assert n[("R1", 3)] == 3


def test_input_checks_and_export_clean(spark):
    c = {(r.route, r.seq): r.reason for r in I.check_additions(_it(spark)).collect()}
    assert c[("R1", 1)] == "" and c[("R1", 2)] == "link" and c[("R1", 3)] == "link" and c[("R2", 1)] == "day"
    df = spark.createDataFrame([("a", "x", None), ("b", "3.7", "r"), (None, "2", "r"), ("c", None, None)], "place string, day string, region string")
    got = sorted((r.place, r.day, r.region) for r in I.export_clean(df, ["region"]).collect())
    assert got == [("a", 1, ""), ("b", 3, "r"), ("c", 1, "")]


def test_route_merge_keeps_duplicates_in_order(spark):
    it = _it(spark)
    m = spark.createDataFrame([("R2", "M", 0), ("R1", "M", 1)], "route string, new_route string, part int")
    got = [(r.seq, r.place) for r in I.merge_routes(it, m).orderBy("seq").collect()]
    assert [p for _, p in got] == ["X", "Wat Arun & Co", "Café ~*", "Old/Town"]


def test_add_guard_and_insert_if_absent(spark):
    it = _it(spark)
    adds = spark.createDataFrame([("R1", "Old/Town", 1), ("R1", "New", 1), ("R2", "New", 4)], "route string, place string, day int")
    got = sorted((r.route, r.place, r.seq) for r in I.add_places(it, adds).collect())
    assert got == [("R1", "New", 4), ("R2", "New", 2)]
    ex = spark.createDataFrame([("b", "Spain")], "blog string, country string")
    cand = spark.createDataFrame([("b", "SPAIN"), ("b", "Laos")], "blog string, country string")
    assert [r.country for r in I.insert_if_absent(ex, cand, ["blog"], "country").collect()] == ["Laos"]


def test_station_defaults_by_lists(spark):
    """lists of saved names give what the names themselves give, and the
    pairs of routes and names are never shuffled."""
    rc = spark.createDataFrame([("R1", "X"), ("R1", "Y"), ("R2", "X"), ("R3", "Y"), (None, "X"), ("R4", None)], "route string, country string")
    d = spark.createDataFrame([("X", "s1"), ("X", "s2"), ("X", "s2"), ("Y", "s2"), ("Y", "s3"), ("Y", None)], "country string, station_name string")
    lists = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("b", "s2"), ("c", None)], "list string, station_name string")
    saved = spark.createDataFrame([("R1", "a"), ("R1", "b"), ("R2", "b"), ("R2", None), (None, "a"), ("R9", "a")], "route string, list string")
    names = saved.join(lists, "list").select("route", "station_name")
    want = sorted(map(str, I.add_station_defaults(rc, d, names).select("route", "country", "station_name").collect()))
    out = I.add_station_defaults(rc, d, saved, lists).select("route", "country", "station_name")
    assert sorted(map(str, out.collect())) == want and len(want) == 9


def test_scorers_get_slices_of_a_batch(spark, monkeypatch):
    """pandas copies are of a bounded slice, however long the
    texts; the other columns, nulls too, come back as they were."""
    monkeypatch.setattr("wayfarer.session.SLICE_ROWS", 5)

    def sized():
        def score(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({c: [float(len(texts))] * len(texts) for c in CATEGORIES}, index=texts.index)

        return score

    df = spark.range(0, 101, 1, 1).selectExpr("if(id % 7 = 0, null, id) AS k", "array(id) AS a", "if(id % 9 = 0, null, string(id)) AS description")
    rows = raw_scores(df.coalesce(1), sized).collect()
    assert max(r.romance for r in rows) <= 5 and len(rows) == 101
    assert sorted(str((r.k, r.a, r.description)) for r in rows) == sorted(str(tuple(r)) for r in df.collect())
    got = score_struct(df.coalesce(1)).collect()
    assert sorted(str((r.k, r.a, r.description)) for r in got) == sorted(str(tuple(r)) for r in df.collect())


def test_route_strings_take_one_shuffle(spark):
    """the texts of a route's stops are shuffled once."""
    rows = [("A", 5000, "x"), ("A", 1000, "y"), ("A", 1001, "z"), ("B", 7, "w"), (None, 3, "v")]
    df = spark.createDataFrame(rows, "route string, seq long, v string")
    out = I.ordered_join(df, ["route"], "seq", F.col("v"), "/", "s")
    assert {r.route: r.s for r in out.collect()} == {"A": "y/z/x", "B": "w", None: "v"}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_python_columns_take_bounded_batches(spark):
    """a worker held batches of 10,000 whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", ARROW_ROWS), ("0", ARROW_ROWS), ("100", 100)):
            spark.conf.set(key, given)
            got = score_struct(spark.range(2500).selectExpr("id", "repeat('an. ', cast(id as int)) as description").coalesce(1))
            assert got.count() == 2500 and int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)
