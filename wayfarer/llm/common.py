"""Helpers shared by the training-data operators.

Intermediate tables are written below the session's shared
``spark.checkpoint.dir`` (never a machine-local folder) and read back, which
cuts lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.session import bounded_batches, shared_path, table

__all__ = ["among", "bounded_batches", "components", "crc_mod", "fresh", "maybe_among", "read_table", "shared_path", "staged", "text_of", "word_hashes"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BITMAP_BITS = 1 << 23


def maybe_among(rows: DataFrame, keys: DataFrame, cols: list[str], flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: false where ``cols`` are surely not
    among ``keys``.  No row moves: the keys set bits of a bitmap of
    ``BITMAP_BITS`` bits (1 MB, at most 256 rows of 4 KB, whatever the input),
    which is broadcast.  A crowded bitmap flags more rows; none is missed."""
    slot, page, bits = fresh(rows, "slot"), fresh(rows, "page"), fresh(rows, "bits")

    def at(df: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS))
        return df.withColumn(slot, hashed).withColumn(page, F.shiftright(F.col(slot), 15).cast("int"))

    bitmap = at(keys).groupBy(page).agg(F.bitmap_construct_agg(F.col(slot) % 32768).alias(bits))
    byte = f"cast(conv(hex(substring({bits}, cast(({slot} % 32768) / 8 as int) + 1, 1)), 16, 10) as int)"
    is_set = F.expr(f"({byte} & shiftleft(1, cast({slot} % 8 as int))) != 0")
    joined = at(rows).join(F.broadcast(bitmap), page, "left")
    return joined.withColumn(flag, F.coalesce(is_set, F.lit(False))).select(*rows.columns, flag)


def among(rows: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose ``cols`` may be among ``keys``: all that are, few others."""
    flag = fresh(rows, "may")
    return maybe_among(rows, keys, cols, flag).where(flag).drop(flag)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


# ---------------------------------------------------------------- components

def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links``: (node, root), root = the smallest node.

    Alternating large-star / small-star rounds.  Every round replaces links by
    links to a neighbourhood's minimum, so the number of links never grows and
    components of any diameter end after O(log^2 n) rounds.  Each round is
    written to the shared folder; nothing but two counts reaches the driver.
    A star's minimum is a partial aggregate, and its members join it by an
    equi-join, so a node with a third of all links is never gathered.
    """
    e = staged(
        links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(),
        "links",
    )

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:  # larger neighbours move to the minimum
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # the smaller neighbours and the node itself move to the minimum
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    mark = None
    for _ in range(max_rounds):
        e = staged(star(star(e, True), False), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


# ---------------------------------------------------------------- word hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE_BYTES = 1 << 18  # numpy holds some tens of bytes for each of these


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), so that close sums end far apart."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


class _Powers:
    p = np.ones(1, dtype=np.uint64)
    inv = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.p) < n:
            cls.p, cls.inv = _powers(_P, n), _powers(_P_INV, n)
        return cls.p, cls.inv


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of runs of whole texts of about
    ``limit`` bytes, so a batch is never expanded at once; null is empty."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of every word ``[^\\x20\\x09-\\x0D]+`` of the texts in
    ``raw``, A-Z lower-cased.  A word never spans two texts."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = _LOWER[raw]
    word = ~_SPACE[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] |= word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _Powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        value = np.where(word, _TABLE[b] * power[: len(b)], np.uint64(0))
        h = np.add.reduceat(value, starts) * inverse[starts]
    row = np.searchsorted(offsets, starts, side="right") - 1
    return mix(h), row
