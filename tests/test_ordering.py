"""Positions in groups over range partitions (F5, G2, D11) and what rests on
them (F4, F7, E13)."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF0001
from wayfarer.operators import itinerary as I
from wayfarer.operators import ordering
from wayfarer.operators.ordering import segmented_positions


@pytest.fixture()
def spread(spark):
    """Range partitions of small test tables are not merged into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def _stops(n=3000, seed=1):
    rng = random.Random(seed)
    seqs = rng.sample(range(10 * n), n)
    routes = ["hot" if i % 3 == 0 else None if i % 50 == 1 else f"r{i % 40}" for i in range(n)]
    return [(r, s, rng.choice([None, 1, 2, 5, 9]) if i % 7 == 0 else rng.randint(1, 9), f"p{s % 11}") for i, (r, s) in enumerate(zip(routes, seqs))]


SCHEMA = "route string, seq long, day int, place string"


def test_positions_equal_a_sort_per_route(spread, monkeypatch):
    paths = []
    monkeypatch.setattr(ordering, "shared_path", lambda s, n, f=ordering.shared_path: paths.append(f(s, n)) or paths[-1])
    rows = _stops()
    df = spread.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS at", "2 AS segment", "3 AS `group`", "4 AS first")
    got = segmented_positions(df, ["route"], ["seq"], "pos")
    assert got.columns == [*df.columns, "pos"] and dict(got.dtypes)["pos"] == "bigint"
    want, count = {}, {}
    for r, s, _, _ in sorted(rows, key=lambda x: x[1]):
        count[r] = count.get(r, 0) + 1
        want[r, s] = count[r]
    assert {(x.route, x.seq): x.pos for x in got.collect()} == want
    # a third of all rows is one route: it lies in several partitions, and none
    # of them holds much more than its share
    parts = spread.read.parquet(paths[0]).where("route = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(parts) >= 2 and max(p["count"] for p in parts) < 1000


def test_positions_of_an_empty_table(spark):
    assert segmented_positions(spark.createDataFrame([], SCHEMA), ["route"], ["seq"], "pos").collect() == []


def test_sections_equal_a_walk_along_each_route(spread):
    rows = _stops(900, 2)
    got = {(r.route, r.seq): r.section for r in I.day_sections(spread.createDataFrame(rows, SCHEMA)).collect()}
    want, last = {}, {}
    for r, s, d, _ in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[1])):
        section, day = last.get(r, (0, None))
        section += day is None or d is None or d != day
        last[r] = (section, d)
        want[r, s] = section
    assert got == want


def test_merged_routes_are_numbered_through(spread):
    rows = _stops(600, 3)
    it = spread.createDataFrame(rows, SCHEMA).where("route IS NOT NULL")
    mapping = it.select("route").distinct().selectExpr("route", "'all' AS new_route", "if(route = 'hot', 1, 2) AS part")
    got = I.merge_routes(it, mapping).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, len(got) + 1))
    hot = sorted(s for r, s, _, _ in rows if r == "hot")
    place = {s: p for _, s, _, p in rows}
    assert [r.place for r in got[: len(hot)]] == [place[s] for s in hot]


def test_value_counts_are_ranked(spark):
    rows = [("r", i, 1, p) for i, p in enumerate(["b", "a", "c", "c", None, "d", "d"])]
    got = I.value_counts(spark.createDataFrame(rows, SCHEMA), "place").orderBy("rank").collect()
    assert [(r["value"], r["n"], r["rank"]) for r in got] == [("c", 2, 1), ("d", 2, 2), ("a", 1, 3), ("b", 1, 4)]


def test_kml_files_hold_the_documents(spark, tmp_dir):
    it = spark.createDataFrame(
        [("r1", 2, "B & C", "x<y", "u", "Laos"), ("r1", 1, "A", None, None, "Laos"), ("r 2", 1, "Z", "d", "u", None)],
        "route string, seq long, place string, description string, google_maps_url string, country string",
    )
    kml = I.kml_documents(it)
    I.write_kml(kml, f"{tmp_dir}/kml")
    back = {r["route"]: r["kml"] for r in spark.read.text(f"{tmp_dir}/kml", wholetext=True).withColumnRenamed("value", "kml").collect()}
    want = {r["route"]: r["kml"] + "\n" for r in kml.collect()}
    assert back == want and "B &amp; C" in back["r1"] and back["r1"].index("<name>A<") < back["r1"].index("B &amp;")


def test_rows_are_shuffled_once_for_their_positions(spread):
    """the offsets reach the rows by a broadcast, and no shuffle
    follows the one that the written rows come from."""
    plan = segmented_positions(spread.createDataFrame(_stops(200, 5), SCHEMA), ["route"], ["seq"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name,width", [("stop_numbers", 2), ("route_merge", 5), ("card", 4)])
def test_only_needed_columns_are_numbered(spread, monkeypatch, name, width):
    """the catalogue's wide columns are not shuffled and written."""
    paths = []
    monkeypatch.setattr(ordering, "shared_path", lambda s, n, f=ordering.shared_path: paths.append(f(s, n)) or paths[-1])
    assert E.queries()[name](spread, SF0001).count() > 0
    assert len([c for c in spread.read.parquet(paths[0]).columns if not c.startswith("_")]) <= width


def test_positions_of_a_group_over_many_batches(spread):
    """The run of a group goes on through Arrow batches and partitions."""
    spread.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spread.range(500).selectExpr("if(id < 300, 'a', 'b') AS route", "id AS seq")
        got = segmented_positions(df, ["route"], ["seq"], "pos").collect()
    finally:
        spread.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.route, r.seq): r.pos for r in got} == {("a" if i < 300 else "b", i): (i if i < 300 else i - 300) + 1 for i in range(500)}
