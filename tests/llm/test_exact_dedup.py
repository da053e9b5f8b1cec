"""Operator 9 against a plain dictionary."""

import hashlib
from collections import defaultdict

import pytest
from helpers import edge_rows, frame, rows_of
from pyspark.sql import functions as F

from wayfarer.llm.exact_dedup import exact_dedup, keep_exact


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = edge_rows() + [(i, f"copy {i % 7}") for i in range(100, 160)]


@pytest.mark.parametrize("max_files", [None, 1])
def test_groups_and_kept_rows(spark, max_files):
    """One micro-batch, and one a file: state carries over between batches."""
    df = frame(spark, ROWS).repartition(4)
    got = exact_dedup(df, max_files=max_files)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "digest") == brute(ROWS)


def test_a_weak_digest_is_settled_by_full_bytes(spark):
    weak = lambda text: (F.crc32(text.cast("binary")) % 3).cast("string")
    got = exact_dedup(frame(spark, ROWS), digest=weak)
    want = sorted((r[:4] for r in brute(ROWS)), key=repr)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == want


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_stage_keeps_one_row_of_each_group_with_all_columns(spark):
    df = frame(spark, ROWS)
    kept = keep_exact(df)
    assert kept.columns == df.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in ROWS})
    assert {r["doc_id"] for r in kept.where("text = 'copy 3'").collect()} == {max(i for i in range(100, 160) if i % 7 == 3)}


def test_stage_with_columns_named_like_its_own(spark):
    df = frame(spark, ROWS).selectExpr("*", "1 as in_group", "2 as _in_group", "3 as keep_digest")
    kept = keep_exact(df)
    assert kept.columns == df.columns and kept.count() == len({t or "" for _, t in ROWS})
