"""The pipeline: stage contracts, and every token's way through."""

import corpus_pipeline
from conftest import SF0001

import __spark_entry__ as E
from wayfarer.llm.common import staged


def test_stages_in_order_keep_columns(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    columns, counts = docs.columns, [docs.count()]
    for n, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF0001), f"test-{n}")
        if n != "packing":
            assert out.columns == columns
            assert out.dtypes == docs.dtypes
            counts.append(out.count())
            assert out.select("doc_id").distinct().count() == counts[-1]
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1]
    assert counts[4] == counts[3]
    assert out.select("doc_id").distinct().count() == counts[-1]


def test_run_is_registered(spark):
    assert E.queries()["pipeline"](spark, SF0001).count() > 0


def test_eleven_queries():
    names = set(E.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()} == set(range(1, 11))
