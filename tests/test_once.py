"""Queries that read the place rows many times join them once."""

import datetime

import pytest

import __spark_entry__ as E
from wayfarer.operators import itinerary as I
from wayfarer.operators.merge import merge_catalog
from wayfarer.operators.summary import place_summary
from wayfarer.plans import places, q_itinerary, q_merge


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few rows of each table, with null and repeated keys."""
    root = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2024, 1, 1)
    nations = [(k, f"NATION_{k}", k % 2) for k in range(4)]
    parts = [(k, f"name {k % 15}", f"Brand#{k % 3}", ["LARGE", "SMALL", None][k % 3]) for k in range(20)] + [(None, "none", "b", "t"), (3, "name 3 again", "b", "t")]
    lines = [(o, (7 * o + ln) % 21, (o + ln) % 9, ln, float(o % 50), ["R", "A", "N", None][(o + ln) % 4]) for o in range(60) for ln in range(1, 5)]
    lines += lines[:7] + [(None, 1, 1, 1, 1.0, "R"), (1, None, 1, 1, 1.0, "R"), (5, 5, 5, None, None, "A")]
    made = {
        "nation": (nations, "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "customer": ([(k, f"Customer#{k}", k % 5) for k in range(12)] + [(2, "twice", 1), (None, "none", 1), (7, "lost", None)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(k, f"Supplier#{k}", k % 4) for k in range(9)] + [(4, "twice", 2), (None, "none", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": ([(k, k % 13, day + datetime.timedelta(days=k)) for k in range(60)] + [(4, 4, None), (6, None, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{root}/{name}.parquet")
    return root


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture()
def joins(monkeypatch):
    """How often P is joined: scans of ``part`` are counted where they begin."""
    seen, plain = [], places.table
    monkeypatch.setattr(places, "table", lambda s, d, n: (seen.append(n), plain(s, d, n))[1])
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_joins_the_place_rows_once(spark, tables, joins):
    """nine derivations of P, two joins each, made a plan that filled the driver."""
    out = E.queries()["merge_full"](spark, tables)
    assert joins.count("part") == 1 and "p_partkey" not in plan(out)
    p = places.place_rows(spark, tables)
    h = q_merge.F.length("place") + q_merge.F.length("country")
    in_base = p.l_returnflag.isin("R", "A") & (h % 7 != 0) & (p.country != q_merge.HELD_COUNTRY)
    new = p.where(~q_merge.F.coalesce(in_base, q_merge.F.lit(False)))
    want = merge_catalog(place_summary(p.where(in_base), places.ORDER, as_of=q_merge.AS_OF), new, places.ORDER, as_of=q_merge.MERGE_DAY)
    got = rows_of(out)
    assert got == rows_of(q_merge._fmt(want).select(out.columns)) and len(got) > 20
    assert {r.merge_status for r in out.collect()} >= {"merged", "new_country"}


def test_add_guard_joins_the_place_rows_once(spark, tables, joins):
    """the stops and the catalogue's places were derived again for each use."""
    out = E.queries()["add_guard"](spark, tables)
    assert joins.count("part") == 1 and "lineitem.parquet" not in plan(out)
    it = q_itinerary.itineraries(spark, tables)
    owners = q_itinerary.table(spark, tables, "customer").join(q_itinerary.table(spark, tables, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    owners = owners.selectExpr("'R' || c_custkey AS route", "n_name AS country").join(it.select("route").distinct(), "route", "left_semi").distinct()
    pairs = owners.join(q_itinerary.summary_of_p(spark, tables).select("country", "place"), "country")
    want = I.add_places(it, pairs.withColumn("day", q_itinerary.F.lit(1)))
    # a customer key that comes twice offers a place of one name in two countries: which of the two stays is not stated
    keys = ["route", "place", "seq", "day"]
    assert rows_of(out.select(keys)) == rows_of(want.select(keys)) and out.count() > 3


def test_station_defaults_join_the_place_rows_once(spark, tables, joins):
    """as above; only the result is of the size of routes x stations."""
    out = E.queries()["station_defaults"](spark, tables)
    assert joins.count("part") == 1 and "lineitem.parquet" not in plan(out)
    it = q_itinerary.itineraries(spark, tables)
    st = q_itinerary.stations(spark, tables).where("station_name IS NOT NULL").select("country", "station_name")
    customers = q_itinerary.table(spark, tables, "customer").join(q_itinerary.table(spark, tables, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    saved = customers.selectExpr("'R' || c_custkey AS route", "n_name AS country").join(st, "country").select("route", "station_name")
    want = I.add_station_defaults(it.select("route", "country").distinct(), st, saved)
    assert rows_of(out) == rows_of(want.select(out.columns)) and out.count() > 3
