"""Placeholder rules, null-like cleaning, contracts."""

import pytest
from pyspark.sql import functions as F

from wayfarer.functions.text import (
    capitalize,
    clean_text,
    clean_text_agent,
    is_placeholder,
    is_placeholder_agent,
    strip,
    word_count,
)
from wayfarer.operators.quality import ContractError, normalize_new_data, quality_report


def _one(spark, col_fn, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(col_fn("x").alias("r")).first()["r"]


def test_placeholder_phrases_are_blocked(spark):
    assert _one(spark, is_placeholder, "Not mentioned in this text.")
    assert _one(spark, is_placeholder_agent, "No specific details were provided.")


def test_real_descriptions_are_kept(spark):
    text = "A riverside temple with detailed murals and excellent sunset views."
    assert not _one(spark, is_placeholder, text)
    assert not _one(spark, is_placeholder_agent, text)


@pytest.mark.parametrize(
    "value, plain, agent",
    [
        ("", True, True),
        ("   ", True, True),
        ("Great view, but NO DIRECT INFORMATION on prices", True, True),
        ("not enough\ninformation here", False, True),  # only the agent variant collapses whitespace
        ("n/a", False, True),
        ("A fine beach", False, False),
    ],
)
def test_placeholder_variants(spark, value, plain, agent):
    assert _one(spark, is_placeholder, value) is plain
    assert _one(spark, is_placeholder_agent, value) is agent


@pytest.mark.parametrize(
    "value, c3, c4",
    [
        (None, "", ""),
        ("  NaN ", "", ""),
        ("None", "", ""),
        ("NULL", "", ""),
        ("n/a", "n/a", ""),
        ("  a  b\n c \t", "a  b\n c", "a b c"),
    ],
)
def test_null_like_cleaners(spark, value, c3, c4):
    assert _one(spark, clean_text, value) == c3
    assert _one(spark, clean_text_agent, value) == c4


def test_strip_is_unicode_aware(spark):
    assert _one(spark, strip, "  x y　\n") == "x y"


def test_capitalize_and_word_count(spark):
    assert _one(spark, capitalize, "hELLO world") == "Hello world"
    assert _one(spark, word_count, "  one two\tthree\n") == 3
    assert _one(spark, word_count, "   ") == 0


def test_normalize_legacy_text_and_drop_placeholder(spark):
    df = spark.createDataFrame(
        [("Thailand", "Valid", "Great temple by the river."), ("Thailand", "Noise", "Not mentioned in this text.")],
        "country string, place string, text string",
    )
    out = normalize_new_data(df).collect()
    assert len(out) == 1
    assert out[0]["place"] == "Valid"
    assert "description" in out[0].asDict()


def test_normalize_requires_columns(spark):
    df = spark.createDataFrame([("x", "y")], "place string, description string")
    with pytest.raises(ContractError):
        normalize_new_data(df)


def test_blog_source_fill(spark):
    df = spark.createDataFrame(
        [
            ("C", "P1", "d", " ", "site", "false"),
            ("C", "P2", "d", None, None, "true"),
            ("C", "P3", "d", "blog", "site", "true"),
            ("C", "P4", "d", "", None, "False"),
        ],
        "country string, place string, description string, blog_source string, source string, is_manual_entry string",
    )
    got = {r.place: r.blog_source for r in normalize_new_data(df).collect()}
    assert got == {"P1": "site", "P2": "user_review", "P3": "blog", "P4": None}


def test_quality_report_rollup(spark):
    df = spark.createDataFrame(
        [("A", "p", "ok"), ("A", "p", " "), ("B", "p", None), ("B", "p", "x no description available y")],
        "country string, place string, description string",
    )
    rows = {r.country: r for r in quality_report(df).collect()}
    assert rows["A"].rows == 2 and rows["A"].blank_descriptions == 1
    assert rows["B"].blank_descriptions == 1 and rows["B"].placeholder_descriptions == 1
    assert rows[None].rows == 4 and rows[None].status == 0
