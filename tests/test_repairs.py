"""Cases that went wrong before: ids over sampled ranges, a scorer cache keyed
by object id, double additions, a missing description, unreadable ledgers."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import itinerary as I
from wayfarer.operators.scoring import raw_scores, score_struct
from wayfarer.operators.summarise import summarise
from wayfarer.operators.training import ordinal_ids, ordinal_positions
from wayfarer.schemas import CATEGORIES
from wayfarer.sources.csv import new_files_only, write_output
from wayfarer.sources.pages import top_links


def test_positions_of_millions_of_wide_rows(spark):
    n = 2_000_000
    df = spark.range(n).selectExpr("(id * 7919) % 2000003 as k", "repeat(md5(cast(id as string)), 4) as payload")
    got = ordinal_positions(df, ["k"]).agg(
        F.count(F.lit(1)), F.countDistinct("position"), F.min("position"), F.max("position"), F.count("payload")
    )
    assert tuple(got.first()) == (n, n, 0, n - 1, n)


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "k int")
    assert {r["k"]: r["review_id"] for r in ordinal_ids(df, ["k"]).collect()} == {1: "th-r-00000", 3: "th-r-00001", 5: "th-r-00002", 9: "th-r-00003"}


def test_each_factory_gives_its_own_scores(spark):
    df = spark.createDataFrame([("a",), ("b",)], "description string")
    names = list(CATEGORIES)
    for k in range(10):

        def factory(v=float(k)):
            return lambda texts: pd.DataFrame({c: [v] * len(texts) for c in names})

        rows = raw_scores(df, factory).collect()
        assert {r["nature"] for r in rows} == {float(k)}


def test_double_additions_get_in_once(spark):
    it = spark.createDataFrame([("r", "a", 1, 1)], "route string, place string, seq int, day int")
    adds = spark.createDataFrame([("r", "b", 1), ("r", "b", 2), ("r", "a", 1), ("r", "c", 1)], "route string, place string, day int")
    got = I.add_places(it, adds, ["day"])
    assert sorted((r["place"], r["seq"]) for r in got.collect()) == [("b", 2), ("c", 3)]
    old = spark.createDataFrame([("x", "Laos")], "b string, country string")
    new = spark.createDataFrame([("x", c) for c in ("DE", "de", "LAOS")], "b string, country string")
    assert [r["country"] for r in I.insert_if_absent(old, new, ["b"], "country").collect()] == ["DE"]


def test_all_default_stations_stay(spark):
    st = spark.createDataFrame([("x", f"s{k}") for k in range(7)], "country string, station_name string")
    assert I.default_stations(st).count() == 7
    assert I.default_stations(st, 3).count() == 3


def test_links_are_capped_only_if_asked(spark):
    links = spark.range(150).selectExpr("1L as page_id", "'u' as url", "cast(id as int) as pos", "concat('l', id) as link")
    assert top_links(links).count() == 150
    assert top_links(links, 100).count() == 100


def test_only_a_missing_ledger_is_empty(spark, tmp_dir):
    rows = spark.createDataFrame([("f1",)], "_file string")
    assert new_files_only(rows, f"{tmp_dir}/none").count() == 1
    os.makedirs(f"{tmp_dir}/bad")
    with open(f"{tmp_dir}/bad/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):  # noqa: B017 - any read error must surface
        new_files_only(rows, f"{tmp_dir}/bad").count()


def test_in_place_write(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.range(5).write.parquet(path)
    assert write_output(spark.read.parquet(path).where("id > 1"), path, overwrite=True) == path
    assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(f"{path}._old") and not os.path.exists(f"{path}._staging")


def test_one_bad_text_fails_alone(spark):
    gated = spark.createDataFrame([(t, "summarise") for t in ("good", "bad", "fine")], "text string, gate string")

    def fn(texts):
        if (texts == "bad").any():
            raise ValueError("no")
        return texts.str.upper()

    assert sorted(r["text"] for r in summarise(gated.coalesce(1), fn).collect()) == ["Error: no", "FINE", "GOOD"]

    class Picky:
        def __call__(self, texts):
            if (texts == "bad").any():
                raise ValueError("no")
            from wayfarer.operators.scoring import StatsScorer

            return StatsScorer()(texts)

    got = score_struct(spark.createDataFrame([("good",), ("bad",)], "description string").coalesce(1), lambda: Picky())
    assert {r["description"]: r["crowded"] for r in got.collect()} == {"good": 1, "bad": None}
