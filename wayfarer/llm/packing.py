"""Best-fit packing of tokenised documents into sequences, with swap-based
local search.

Documents become token ids plus an end id; only those longer than a sequence
are cut.  Pieces are dealt at random into pools of about ``POOL`` pieces, each
packed by one task: best fit in decreasing order, then local search between
underfull bins.  The search moves a document, exchanges one for one or two for
one, whenever that raises the sum of squared fills, and so drains the emptiest
bins until they are empty or no exchange helps.  The bins that stay emptiest
in each pool are pooled again across pools.  Pools are bounded, so the work per
task does not grow with the corpus, and thousands of pieces leave a pool less
than about one bin of waste.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded_batches, staged

POOL = 8192
#: Of each pool, this many of the emptiest bins are packed again with those of
#: ``REPOOL`` other pools.
OPEN_BINS = 128
REPOOL = 32
CACHED_WORDS = 400_000  # of each of two generations


class WordIds:
    """Token ids (little-endian 32-bit) of whole texts.

    The tokenizer's pieces never span white space, so a text's ids are those of
    its white-space separated parts one after another; parts are looked up in
    a bounded cache and only new ones go to the tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # the generation before
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {c: self._encode([c])[0] for c in (b".", b",", b";", b":", b"!", b"?")}

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """The same for words of letters only, in one text: each ends with the
        only word-end token of its own."""
        (found,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
        if len(cuts) != len(words):  # a letter whose lower case is more than letters
            return self._encode(words)
        data = ids.tobytes()
        return [data[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def _encode_others(self, parts: list[bytes]) -> list[bytes]:
        """The same for any parts, in one text: a token's place in it tells the
        part it comes from."""
        texts = [p.decode() for p in parts]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ends = np.cumsum([len(t) + 1 for t in texts])
        places = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        cuts = np.searchsorted(places, ends).tolist()
        data = np.array(found.ids, "<u4").tobytes()
        return [data[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        data = text.encode()
        if text.isascii():  # the tokenizer lowers it anyway
            data = data.lower()
        parts = data.split()  # ASCII white space only: safe cuts for any text
        found = list(map(self.cache.get, parts))  # one look-up a part
        if None in found:
            if len(self.cache) > CACHED_WORDS:
                self.cache, self.old = {}, self.cache
                found = [None] * len(parts)
            self._learn({p for p, ids in zip(parts, found, strict=True) if ids is None})
            found = map(self.cache.__getitem__, parts)
        return b"".join(found)

    def _learn(self, missing: set[bytes]) -> None:
        cache, old = self.cache, self.old
        ends, words, others = [], [], []
        stems = set()  # new parts, each listed once
        for p in missing:
            if p in old:
                cache[p] = old[p]
                continue
            if p[-1:] in self.marks and p[-2:-1].isalnum():
                # one mark after an ASCII letter or digit is a piece of its own
                ends.append(p)
                p = p[:-1]
                if p in cache or p in missing:
                    continue
                if p in old:
                    cache[p] = old[p]
                    continue
                if p in stems:
                    continue
                stems.add(p)
            (words if p.decode().isalpha() else others).append(p)
        for some, encode in ((words, self._encode_words), (others, self._encode_others)):
            for at in range(0, len(some), 1000):
                few = some[at : at + 1000]
                cache.update(zip(few, encode(few), strict=True))
        for p in ends:
            cache[p] = cache[p[:-1]] + self.marks[p[-1:]]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One tokenizer in a Python worker, whose cache outlives a task."""
    return WordIds(path)


def tokenised_pieces(
    docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, deal[, ids]): the pieces of every
    whole text; ``deal`` is an even random number for dealing pools."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, count = word_ids(tokenizer), 0
        for batch in batches:
            rows, piece, start, size, crc, deal, ids = [], [], [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                data = ids_of(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    rows.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    count += 1
                    deal.append(zlib.crc32(b"%d %d" % (count, crc[-1])))
                    ids.append(part if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(deal, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["id", "piece", "start", "length", "ids_crc32", "deal", "ids"],
            )

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, deal long, ids binary"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")


# ------------------------------------------------------------------- packing

def best_fit(sizes: np.ndarray, cap: int) -> np.ndarray:
    """Bin of each piece: best fit, largest first."""
    bin_of = np.empty(len(sizes), np.int64)
    gaps: list[tuple[int, int]] = []  # (gap, bin), sorted
    bins = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(gaps, (s, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = cap, bins
            bins += 1
        bin_of[i] = b
        if gap > s:
            insort(gaps, (gap - s, b))
    return bin_of


def local_search(sizes: np.ndarray, bin_of: np.ndarray, cap: int, passes: int = 4) -> np.ndarray:
    """Drain the emptiest bins by moves and by one-for-one and two-for-one
    exchanges with fuller bins, each of which raises the sum of squared fills
    (so the search ends).  It stops where no packing could have fewer bins, or
    after a full pass without a change."""
    bin_of = bin_of.copy()
    fill = np.bincount(bin_of, weights=sizes).astype(np.int64)
    items: list[set[int]] = [set() for _ in fill]
    for i, b in enumerate(bin_of):
        items[b].add(i)

    def put(i: int, b: int) -> None:
        items[bin_of[i]].remove(i)
        fill[bin_of[i]] -= sizes[i]
        items[b].add(i)
        fill[b] += sizes[i]
        bin_of[i] = b

    def improve(y: int) -> bool:
        """One best exchange that takes tokens out of bin y."""
        mine = sorted(items[y], key=lambda i: -sizes[i])
        gap = cap - fill
        fuller = (fill >= fill[y]) & (gap > 0)
        fuller[y] = False
        # move: the fullest bin that the piece fits
        for i in mine:
            fits = np.flatnonzero(fuller & (gap >= sizes[i]))
            if len(fits):
                put(i, int(fits[gap[fits].argmin()]))
                return True
        best = (0, ())
        theirs = np.flatnonzero(fuller[bin_of])
        if not len(theirs):
            return False
        their_size, their_gap = sizes[theirs], gap[bin_of[theirs]]
        groups = [(i,) for i in mine]
        groups += [(i, j) for n, i in enumerate(mine) for j in mine[n + 1 :]]
        tried = set()
        for g in groups:
            total = int(sum(sizes[i] for i in g))
            if total in tried:
                continue
            tried.add(total)
            gain = total - their_size
            ok = (gain > 0) & (gain <= their_gap)
            if ok.any():
                k = int(np.where(ok, gain, 0).argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), (g, int(theirs[k])))
        if not best[0]:
            return False
        g, other = best[1]
        x = int(bin_of[other])
        put(other, y)
        for i in g:
            put(i, x)
        return True

    least = -(-int(sizes.sum()) // cap)  # no packing has fewer bins
    for _ in range(passes):
        changed = False
        for y in np.argsort(fill, kind="stable"):
            if (fill > 0).sum() <= least:
                return bin_of
            # a bin can empty only if the gaps of the others hold its fill
            gaps = int((cap - fill[(fill > 0)]).sum()) - int(cap - fill[y])
            if 0 < fill[y] <= gaps:
                while items[y] and improve(int(y)):
                    changed = True
        if not changed:
            break
    return bin_of


def packer(cap: int):
    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", "id", "piece", "deal"], ascending=[False, True, True, True], ignore_index=True)
        sizes = t["length"].to_numpy(np.int64)
        bins = np.unique(local_search(sizes, best_fit(sizes, cap), cap), return_inverse=True)[1]
        order = np.lexsort((np.arange(len(t)), bins))
        t, bins = t.iloc[order].reset_index(drop=True), bins[order]
        before = t["length"].cumsum() - t["length"]
        first = before.groupby(bins).transform("first")
        fill = t["length"].groupby(bins).transform("sum")
        lowest = np.argsort(np.bincount(bins, weights=t["length"]), kind="stable")[:OPEN_BINS]
        t["sequence_id"] = int(key[0]) * (1 << 24) + bins
        t["offset"] = before - first
        t["fill"] = fill
        t["open"] = np.isin(bins, lowest) & (fill < cap).to_numpy()
        return t

    return run


def pack(pieces: DataFrame, length: int, pool: int = POOL) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0 in a sequence)."""
    n = pieces.count()
    pools = max(1, -(-n // pool))
    id_type = pieces.schema["id"].dataType.simpleString()
    schema = (
        f"id {id_type}, piece int, start long, length long, ids_crc32 long, deal long, pool long, "
        "sequence_id long, offset long, fill long, open boolean"
    )
    dealt = pieces.select("id", "piece", "start", "length", "ids_crc32", "deal").withColumn("pool", F.col("deal") % pools)
    packed = dealt.groupBy("pool").applyInPandas(packer(length), schema)
    if pools == 1:
        return packed
    packed = staged(packed, "packing-pools")
    again = packed.where("open").withColumn("pool", F.lit(pools) + F.floor(F.col("pool") / REPOOL))
    return packed.where("not open").unionByName(
        again.select(dealt.columns).groupBy("pool").applyInPandas(packer(length), schema)
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 0,
    pool: int = POOL,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null text is empty, and an empty text is one piece that
    holds the end id only; null ids stay null; rows that repeat an id are
    packed one by one; an empty table gives no rows; other columns are ignored.
    """
    pieces = staged(tokenised_pieces(docs, tokenizer, id_col, text_col, length, end_id), "packing-pieces")
    out = pack(pieces, length, pool)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
