"""Summary (E3-E7, H12, H13) and the incremental merge."""

import datetime as dt

from pyspark.sql import functions as F

from wayfarer.operators.merge import combine_states, merge_catalog, place_state
from wayfarer.operators.scoring import overlay_scores
from wayfarer.operators.summary import first_nonempty_metadata, place_summary
from wayfarer.schemas import CATEGORIES

SCORE_DDL = ", ".join(f"{c} double" for c in CATEGORIES)


def _rows(spark, rows):
    ddl = "seq long, country string, place string, description string, region string, " + SCORE_DDL
    return spark.createDataFrame(rows, ddl)


def test_summary_first_three_distinct_and_count(spark):
    s = [None] * 10
    df = _rows(
        spark,
        [
            (1, "C", "P", " a ", None, *s),
            (2, "C", "P", "a", "R1", *s),
            (3, "C", "P", "b", "R2", *s),
            (4, "C", "P", None, None, *s),
            (5, "C", "P", "c", None, *s),
            (6, "C", "P", "d", None, *s),
        ],
    )
    r = place_summary(df, ["seq"], as_of="2024-01-02").first()
    assert r.description == "a\n\nb\n\nc"
    assert r.description_count == 6
    assert r.region == "R1"
    assert r.last_updated == dt.date(2024, 1, 2)


def test_summary_rounding_and_cost(spark):
    def row(seq, place, v):
        vals = [v] * 10
        return (seq, "C", place, "d", None, *vals)

    df = _rows(spark, [row(1, "half", 2.5), row(2, "odd", 3.5), row(3, "cost", 5.25), row(4, "none", None)])
    got = {r.place: r for r in place_summary(df, ["seq"]).collect()}
    assert got["half"].romance == 2 and got["odd"].romance == 4  # half-even
    assert got["cost"].cost == 10 and got["cost"].romance == 5  # 5.25*2 clipped at 10
    assert got["half"].cost == 5  # 2.5*2 = 5
    assert got["none"].romance == 0 and got["none"].cost == 0


def test_first_nonempty_metadata(spark):
    df = spark.createDataFrame(
        [(1, "C", "P", " ", None), (2, "C", "P", " R ", "u1"), (3, "C", "P", "X", "u2")],
        "seq long, country string, place string, region string, map_link string",
    )
    r = first_nonempty_metadata(df, ["seq"]).first()
    assert r.region == "R" and r.google_maps_url == "u1"


def _base(spark, rows):
    ddl = "place string, country string, description string, " + SCORE_DDL + ", description_count long"
    return spark.createDataFrame(rows, ddl)


def _new(spark, rows):
    ddl = "seq long, place string, country string, description string, " + SCORE_DDL
    return spark.createDataFrame(rows, ddl)


def test_weighted_merge_worked_example(spark):
    base = _base(spark, [("Old", "T", "one\n\ntwo", *[6.0] * 10, 3)])
    new = _new(spark, [(1, "Old", "T", "three", *[8.0] * 10)])
    r = merge_catalog(base, new, ["seq"], as_of="2024-05-05").first()
    assert r.merge_status == "merged"
    assert r.romance == 6.5 and r.description_count == 4
    assert r.description == "one\n\ntwo\n\nthree"


def test_merge_keeps_first_five_descriptions(spark):
    base = _base(spark, [("P", "T", "a\n\nb\n\nc\n\nd", *[1.0] * 10, 2)])
    new = _new(spark, [(i, "P", "T", f"n{i}", *[1.0] * 10) for i in range(3)])
    r = merge_catalog(base, new, ["seq"]).first()
    assert r.description == "a\n\nb\n\nc\n\nd\n\nn0"
    assert r.description_count == 5


def test_merge_sets_metadata_for_new_places_and_keeps_unchanged(spark):
    base = _base(spark, [("Old Place", "Thailand", "old", *[5.0] * 10, 2)])
    new = _new(spark, [(1, "New Place", "Thailand", "first", *[7.0] * 10), (2, "New Place", "Thailand", "second", *[9.0] * 10)])
    got = {r.place: r for r in merge_catalog(base, new, ["seq"], as_of="2024-02-02").collect()}
    assert got["Old Place"].merge_status == "unchanged" and got["Old Place"].description_count == 2
    n = got["New Place"]
    assert n.merge_status == "new" and n.description_count == 1 and n.description == "first"
    assert n.last_updated == dt.date(2024, 2, 2) and n.romance == 7.0


def test_new_country_keeps_all_rows(spark):
    base = _base(spark, [("P", "A", "x", *[5.0] * 10, 1)])
    new = _new(spark, [(1, "Q", "B", "q1", *[1.0] * 10), (2, "Q", "B", "q2", *[1.0] * 10)])
    rows = merge_catalog(base, new, ["seq"]).where(F.col("country") == "B").collect()
    assert len(rows) == 2 and {r.merge_status for r in rows} == {"new_country"}


def test_null_old_count_counts_as_one(spark):
    base = _base(spark, [("P", "A", "x", *[4.0] * 10, None)])
    new = _new(spark, [(1, "P", "A", "y", *[6.0] * 10)])
    r = merge_catalog(base, new, ["seq"]).first()
    assert r.romance == 5.0 and r.description_count == 2


def test_base_duplicates_keep_first(spark):
    ddl = "o long, place string, country string, description string, " + SCORE_DDL + ", description_count long"
    base = spark.createDataFrame([(2, "P", "A", "second", *[9.0] * 10, 1), (1, "P", "A", "first", *[1.0] * 10, 1)], ddl)
    new = _new(spark, [(1, "Z", "A", "z", *[1.0] * 10)])
    r = merge_catalog(base, new, ["seq"], base_order=["o"]).where("place = 'P'").first()
    assert r.description == "first"


def test_classify_skips_when_all_rows_have_ratings(spark):
    def _never_called():
        def boom(texts):
            raise AssertionError("scorer must not run for complete rows")

        return boom

    df = spark.createDataFrame([("Thailand", "Wat Arun", "Good description", *[6.0] * 10)], "country string, place string, description string, " + SCORE_DDL)
    r = overlay_scores(df, _never_called).first()
    assert r.romance == 6.0 and r.food == 6.0


def test_fuzzy_merge_equals_sequential_model(spark):
    """Names of the catalogue lead in its order; a new name joins the earliest
    leader it matches and merges into its place, exact names first."""
    base = _base(spark, [(p, "T", f"old {p}", *[4.0] * 10, 1) for p in ("Grand River Temple", "Grand Rivers Temple", "Night Market")])
    rows = [
        (1, "Grand River Temples", "T"), (2, "Grand Rivers Temple", "T"), (3, "Night Markets", "T"), (4, "Night Market", "T"),
        (5, "Blue Lagoon Beach", "T"), (6, "Blue Lagoon Beech", "T"), (7, "Nigth Market", "U"), (8, "Night Market", "U"),
    ]
    new = _new(spark, [(i, p, c, f"d{i}", *[8.0] * 10) for i, p, c in rows])
    got = {(r.country, r.place): r for r in merge_catalog(base, new, ["seq"], fuzzy=True).collect()}
    assert {k: (r.merge_status, r.description_count) for k, r in got.items() if k[0] == "T"} == {
        ("T", "Grand River Temple"): ("merged", 2), ("T", "Grand Rivers Temple"): ("merged", 2),
        ("T", "Night Market"): ("merged", 3), ("T", "Blue Lagoon Beach"): ("new", 1),
    }
    assert got["T", "Night Market"].description == "old Night Market\n\nd3\n\nd4"
    assert {k for k in got if k[0] == "U"} == {("U", "Nigth Market"), ("U", "Night Market")}  # no base: rows stay
    plain = merge_catalog(base, new, ["seq"]).where("country = 'T'").collect()
    assert {r.place for r in plain if r.merge_status == "new"} == {"Grand River Temples", "Night Markets", "Blue Lagoon Beach", "Blue Lagoon Beech"}


def test_new_country_summarised(spark):
    base = _base(spark, [("P", "A", "x", *[5.0] * 10, 1)])
    new = _new(spark, [(1, "Q", "B", "q1", *[1.0] * 10), (2, "Q", "B", "q2", *[2.0] * 10), (3, "R", "B", None, *[None] * 10)])
    rows = merge_catalog(base, new, ["seq"], as_of="2024-01-01", new_countries="summary").where(F.col("country") == "B").collect()
    got = {r.place: (r.romance, r.description, r.description_count, r.merge_status) for r in rows}
    assert got == {"Q": (1.5, "q1\n\nq2", 2, "new_country"), "R": (None, "", 1, "new_country")}


def test_states_of_parts_make_the_state_of_all(spark):
    rows = [(i, f"P{i % 3}", "A", f"d{i}" if i % 4 else None, *[float(i * k % 7) if i % 5 else None for k in range(10)]) for i in range(40)]
    whole = place_state(_new(spark, rows), ["seq"])
    for cut in (1, 17, 39):
        parts = combine_states(place_state(_new(spark, rows[cut:]), ["seq"]), place_state(_new(spark, rows[:cut]), ["seq"]))
        assert sorted(map(repr, parts.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
