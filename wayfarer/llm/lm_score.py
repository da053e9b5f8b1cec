"""Cross-entropy difference scoring with matched n-gram models.

Two bigram models, a target model (texts labelled good) and a background model
(all texts), share one vocabulary: words are hashed into ``WORD_BITS`` bits and
bigrams into ``PAIR_BITS`` bits.  Both have the same order, smoothing and
slots, so their losses differ by the texts they have seen only.  A text's
score is the mean over its tokens of target loss minus background loss, in
bits: negative where the text is more like the target.  Models are cross-fitted: the texts are dealt into
``FOLDS`` folds by their ids, and a text is scored by models that have seen the
other folds only, so none is judged by a model that holds its own counts.

The hashed vocabulary is a stated choice: it bounds the model (``2**WORD_BITS +
2**PAIR_BITS`` counters a fold) whatever the corpus, at the price that words or pairs
that share a slot share its count.  Counts cover every token of every text.
Each task adds up its own counters and sends them in packed pages, which are
summed in two levels in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import among, bounded_batches, crc_mod, mix, text_slices, word_hashes

WORD_BITS = 18
PAIR_BITS = 21
FOLDS = 2
PAGE = 1 << 16
#: Pseudo-counts: of the uniform distribution in the word model, and of the
#: word model in the pair model.
ALPHA = 0.1
MU = 2.0


def token_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word slot, pair slot or -1 for a text's first word, row) per token."""
    h, row = word_hashes(raw, offsets)
    word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            both = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        inside = row[1:] == row[:-1]
        pair[1:][inside] = (both[inside] >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    return word, pair, row


def fold(id_col: str) -> Column:
    return crc_mod(id_col, FOLDS).cast("int").alias("fold")


def counted(docs: DataFrame) -> np.ndarray:
    """[fold, slot]: counters of all words, then of all pairs, over the texts
    of ``docs`` (fold, text) that are not in the fold."""
    width = (1 << WORD_BITS) + (1 << PAIR_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(FOLDS * width, np.int32)
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            for at, raw, offs in text_slices(batch.column(1)):
                word, pair, row = token_slots(raw, offs)
                start = folds[at + row] * width
                held = pair >= 0
                slots = np.concatenate([start + word, start[held] + pair[held] + (1 << WORD_BITS)])
                slots, n = np.unique(slots, return_counts=True)
                c[slots] += n.astype(np.int32)
        for k, page in enumerate(c.reshape(-1, PAGE)):
            if page.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([page.astype(np.int64).tobytes()], pa.binary())], ["page", "counts"]
                )

    def add(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PAGE, np.int64)
        for x in t["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"page": [key[0]], "counts": [total.tobytes()]})

    pages = docs.select("fold", "text").mapInArrow(run, "page int, counts binary")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    some = salted.groupBy("page", "salt").applyInPandas(add, "page int, counts binary")
    total = some.groupBy("page").applyInPandas(add, "page int, counts binary")
    out = np.zeros((FOLDS * width // PAGE, PAGE), np.float32)
    for r in total.toLocalIterator():
        out[r["page"]] = np.frombuffer(r["counts"], np.int64)
    out = out.reshape(FOLDS, width)
    return out.sum(axis=0) - out


def losses(counts: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Bits that a model with these counters takes for each token."""
    words = counts[: 1 << WORD_BITS]
    n = words.sum(dtype=np.float64)
    p = (words[word] + ALPHA) / (n + ALPHA * (1 << WORD_BITS))
    first = pair < 0
    before = np.concatenate([[0], word[:-1]]) if len(word) else word
    c = counts[(1 << WORD_BITS) + np.maximum(pair, 0)].astype(np.float64)
    # a shared slot may hold more pairs than the context has words
    seen = np.maximum(words[before], c)
    q = (c + MU * p) / (seen + MU)
    return -np.log2(np.where(first, p, q))


def mean_loss(models: np.ndarray, word: np.ndarray, pair: np.ndarray, row: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Mean bits per token of each text, by its fold's model; 0 without tokens."""
    total = np.zeros(len(folds))
    for f in range(FOLDS):
        mine = folds[row] == f  # whole texts, so a token's context stays before it
        total += np.bincount(row[mine], weights=losses(models[f], word[mine], pair[mine]), minlength=len(folds))
    return total / np.maximum(np.bincount(row, minlength=len(folds)), 1)


def score(docs: DataFrame, target: np.ndarray, background: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_bits, background_bits, score) per row; bits are
    means per token.

    Defined cases: a null text, or one without words, has no token, and its
    means and score are 0; repeated rows come out alike; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    models = spark.sparkContext.broadcast((target, background))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            for at, raw, offs in text_slices(batch.column(1)):
                k = len(offs) - 1
                word, pair, row = token_slots(raw, offs)
                n = np.bincount(row, minlength=k)
                t, b = (mean_loss(m, word, pair, row, folds[at : at + k]) for m in models.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), pa.array(n.astype(np.int64)), pa.array(t), pa.array(b), pa.array(t - b)],
                    ["id", "n_tokens", "target_bits", "background_bits", "score"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold(id_col)).mapInArrow(
        run, f"id {id_type}, n_tokens long, target_bits double, background_bits double, score double"
    )
    return out.withColumnRenamed("id", id_col)


def cross_entropy_difference(
    docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score every row of ``docs`` against the texts whose ids are in ``good``
    (one column, ``id_col``).  Null ids are no target texts."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = good.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    chosen = among(texts, ids, ["id"]).join(ids, "id", "left_semi")
    return score(docs, counted(chosen.select(fold("id"), "text")), counted(texts.select(fold("id"), "text")), id_col, text_col)
