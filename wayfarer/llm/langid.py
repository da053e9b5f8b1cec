"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order ``ORDER``: the counts of bytes
after each context of 0..ORDER bytes.  The code length of a byte is that of
the longest known context, escaping to shorter ones by method C (escape
probability = distinct / (total + distinct), no exclusion) and at last to 1/256.
The statistics are frozen after training, so the code length of a byte depends
on the last ORDER + 1 bytes only; scoring is a table look-up, exact for seen
and unseen contexts alike.  A text goes to the language that codes it in the
fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded_batches, crc_mod, fresh, text_slices

ORDER = 3
#: Training fits on at most about this many labelled rows of each language
#: (all, if fewer): a fixed share of its ids chosen by hash.  Every node that
#: they count is kept.
MAX_TRAINING_ROWS = 60_000
UNKNOWN = "und"
_SLOT_BITS = 22


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it as one number; a text
    starts after ORDER zero bytes."""
    at = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = raw.astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.zeros(len(raw), np.uint32)
        before[k:] = raw[: len(raw) - k]
        before[at < k] = 0
        key |= before << np.uint32(8 * k)
    return key


@dataclass
class Trees:
    """Frozen context trees of all languages."""

    langs: list[str]
    keys: np.ndarray  # distinct (context, byte) numbers of any language, sorted
    counts: np.ndarray  # [language, key]
    levels: list = field(default_factory=list)
    bits: np.ndarray | None = None  # code length of each key, [key, language]
    slots: np.ndarray | None = None

    def freeze(self) -> Trees:
        for k in range(ORDER + 1):  # contexts of k bytes
            ext = self.keys & np.uint32((1 << (8 * (k + 1))) - 1)
            sym, inv = np.unique(ext, return_inverse=True)
            n = np.stack([np.bincount(inv, weights=c, minlength=len(sym)) for c in self.counts])
            ctx, cinv = np.unique(sym >> np.uint32(8), return_inverse=True)
            total = np.stack([np.bincount(cinv, weights=c, minlength=len(ctx)) for c in n])
            kinds = np.stack([np.bincount(cinv, weights=c > 0, minlength=len(ctx)) for c in n])
            self.levels.append((sym, n, ctx, total, kinds))
        self.bits = self.code_length(self.keys).astype(np.float32)
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        return self

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)

    def code_length(self, keys: np.ndarray) -> np.ndarray:
        """Bits for each key in each language, [key, language], by the trees."""
        p = np.full((len(self.langs), len(keys)), 1 / 256)
        for k, (sym, n, ctx, total, kinds) in enumerate(self.levels):
            ext = keys & np.uint32((1 << (8 * (k + 1))) - 1)
            s = np.minimum(np.searchsorted(sym, ext), len(sym) - 1)
            c = np.minimum(np.searchsorted(ctx, ext >> np.uint32(8)), len(ctx) - 1)
            known = ctx[c] == ext >> np.uint32(8)
            seen = np.where(sym[s] == ext, n[:, s], 0)
            all_, kind = np.where(known, total[:, c], 0), np.where(known, kinds[:, c], 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                here = np.where(seen > 0, seen / (all_ + kind), kind / (all_ + kind) * p)
            p = np.where(all_ > 0, here, p)
        return -np.log2(p).T

    def text_bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length of each text in each language, [text, language]."""
        texts = len(offsets) - 1
        out = np.zeros((texts, len(self.langs)))
        if not len(raw):
            return out
        key = grams(raw, offsets)
        at = self.slots[self._slot(key)]
        miss = np.flatnonzero(self.keys[at] != key)
        length = self.bits[at]
        if len(miss):
            u, inv = np.unique(key[miss], return_inverse=True)
            length[miss] = self.code_length(u).astype(np.float32)[inv]
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] = np.add.reduceat(length, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over ``docs`` (lang, text): each task counts its own
    distinct grams before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def fold(lang):
            keys = np.concatenate([k for k, _ in held[lang]])
            u, inv = np.unique(keys, return_inverse=True)
            held[lang] = [(u, np.bincount(inv, weights=np.concatenate([n for _, n in held[lang]])))]

        for batch in batches:
            lang_of = np.array(batch.column(0).to_pylist(), dtype=object)
            for at, raw, offs in text_slices(batch.column(1)):
                key = grams(raw, offs)
                mine = np.repeat(lang_of[at : at + len(offs) - 1], np.diff(offs))
                for lang in set(lang_of[at : at + len(offs) - 1]):
                    held.setdefault(lang, []).append(np.unique(key[mine == lang], return_counts=True))
                    if len(held[lang]) >= 32:
                        fold(lang)
        for lang in held:
            fold(lang)
            u, n = held[lang][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )

    part = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Trees | None:
    """Context trees of every language value in the labelled rows, or None if
    there are none.  Rows with a null text or language are not labelled."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    large = {k: int(1_000_000 * MAX_TRAINING_ROWS / n) for k, n in sizes.items() if n > MAX_TRAINING_ROWS}
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(10)), F.lit(1_000_000))
    limit = F.lit(1_000_000)
    for k, most in large.items():
        limit = F.when(F.col("lang") == k, most).otherwise(limit)
    counts = gram_counts(rows.where(share < limit)).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    if not langs:
        return None
    gram = counts["gram"].to_numpy().astype(np.uint32)
    which = np.array([langs.index(x) for x in counts["lang"].to_pylist()])
    keys, inv = np.unique(gram, return_inverse=True)
    table = np.zeros((len(langs), len(keys)))
    table[which, inv] = counts["n"].to_numpy()
    return Trees(langs, keys, table).freeze()


def identify(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) per row of ``docs``.

    lang_pred is a learned value, or ``und`` (score 0) for a null text, a text
    without a letter, or when nothing was learned.  score is the posterior
    of the prediction under equal priors; ties go to the first language by
    name.  bits_per_byte is the text's code length in that language.  Repeated
    rows are judged alike, an empty table gives no rows, other columns are
    ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letter = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for at, raw, offs in text_slices(batch.column(1)):
                k = len(offs) - 1
                lang, score, per_byte = [UNKNOWN] * k, np.zeros(k), [None] * k
                if model is not None:
                    bits = model.text_bits(raw, offs)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(k), best]
                    p = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
                    size = np.diff(offs)
                    for i in np.flatnonzero(letter[at : at + k]):
                        lang[i], score[i], per_byte[i] = model.langs[best[i]], p[i], least[i] / size[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte, pa.float64())],
                    ["id", "lang_pred", "score", "bits_per_byte"],
                )

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, lang_pred string, score double, bits_per_byte double"
    )
    return found.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return crc_mod(id_col, folds) == 0


#: Limit of a language with fewer held-out texts than MIN_HELD_OUT.  Random bytes
#: take 8 bits a byte.
MAX_BITS_PER_BYTE = 7.0
MIN_HELD_OUT = 5
#: A language's limit is this much over the mean of its held-out texts' bits per
#: byte, in standard deviations, and no less than its costliest one.
REJECT_DEVIATIONS = 6.0


def reject_limits(docs: DataFrame, trees: Trees, lang_col: str = "lang", text_col: str = "text") -> np.ndarray:
    """Bits per byte above which a text is not in each language of ``trees``,
    from the code lengths of the texts of that language in ``docs``, which the
    trees have not seen."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at_lang = {x: k for k, x in enumerate(model.langs)}
        for batch in batches:
            which = np.array([at_lang.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            letter = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for at, raw, offs in text_slices(batch.column(1)):
                k = len(offs) - 1
                mine = np.flatnonzero(letter[at : at + k] & (which[at : at + k] >= 0))
                own = which[at : at + k][mine]
                per_byte = model.text_bits(raw, offs)[mine, own] / np.diff(offs)[mine]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(per_byte)], ["k", "x"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = rows.where("lang is not null and text is not null").mapInArrow(run, "k long, x double").groupBy("k")
    found = found.agg(F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    out = np.full(len(trees.langs), MAX_BITS_PER_BYTE)
    for r in found.where(F.col("n") >= MIN_HELD_OUT).collect():
        out[r["k"]] = max(r["most"], r["mean"] + REJECT_DEVIATIONS * r["sd"])
    return out


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or whose text costs
    more bits a byte than the limit of the language that codes it best.  The
    decision is made per text, so rows that share an id are judged apart."""
    trees = train(docs.where(~held_out(id_col)), lang_col, text_col, id_col)
    limits = None if trees is None else reject_limits(docs.where(held_out(id_col)), trees, lang_col, text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    ok = fresh(docs, "identified")

    @F.pandas_udf("boolean")
    def accepted(text):  # type: ignore[no-untyped-def]
        import pandas as pd

        col = pa.array(text, pa.string())
        letter = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False).copy()
        for at, raw, offs in text_slices(col):
            k = len(offs) - 1
            if shared.value is None:
                letter[at : at + k] = False
                continue
            bits = shared.value.text_bits(raw, offs)
            letter[at : at + k] &= bits.min(axis=1) <= limits[bits.argmin(axis=1)] * np.maximum(np.diff(offs), 1)
        return pd.Series(letter)

    return docs.withColumn(ok, accepted(F.col(text_col))).where(ok).drop(ok)
