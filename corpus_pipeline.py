"""Corpus pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet to the shared folder and read back as the next stage's
input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm.common import read_table, staged
from wayfarer.llm.exact_dedup import keep_exact
from wayfarer.llm.jaccard import one_of_each
from wayfarer.llm.langid import keep_identified
from wayfarer.llm.packing import pack_documents
from wayfarer.llm.secret_scan import mask_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents in no learned language go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the row with the largest id stays."""
    return keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays (five-word
    shingles, Jaccard similarity of 0.8 or more)."""
    return one_of_each(docs, shingle=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: live-looking credentials are masked; every document stays."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every token of every document gets its place in a sequence."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), length=SEQUENCE)


TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048

STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language models, streams and local search have no SQL form; the stages are
#: tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
