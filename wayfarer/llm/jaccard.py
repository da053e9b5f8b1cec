"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct word shingles as 64-bit hashes.  Two documents
link when 100 * |A n B| >= percent * |A u B|.

1. *Sets.*  Equal sets collapse to one representative (smallest id): copies
   never make pairs.
2. *Tiles.*  Sets that reach the threshold share a shingle among the first
   ``|A| - ceil(t |A|) + 1`` of each, in any global order of shingles.  The
   order puts shingles that few documents hold first, by a fixed-size count
   sketch of the whole corpus, so that passages which many documents share
   make no tile.  A tile is (shingle, size band); a set enters its own band's
   tile and the next one's, since linked sizes differ by the factor t at most.
3. *First pass.*  Each member of a tile meets the tile's smallest member only,
   its most frequent one first, and others only if no link has joined them yet.
   Hashed signatures of sets bound the overlap from above by bit counts: first
   256 parity bits (each member flips one, so the bits in which two sets differ
   are at most the members that only one has), then 4,096 such bits.
   Pairs that may link go to the exact intersection of sorted arrays.  Links
   are joined into components.
4. *Rest.*  Tiles whose members still lie in several components are cut into
   blocks of at most ``BLOCK`` members; each pair of blocks compares all
   bitmaps of different components at once, and survivors are intersected
   exactly.  Sets already connected need no comparison: it could not change a
   component.  A group of near copies thus costs one pass, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import among, bounded_batches, components, fresh, maybe_among, mix, staged, text_slices, word_hashes

SKETCH_BITS = 18  # 2**18 counters of 8 bytes: 2 MB, whatever the input
PAGES = 64
BITMAP_WORDS = 64  # 4096-bit signatures
PARITY = ["q0", "q1", "q2", "q3"]  # 64 bits each
BLOCK = 512


# ------------------------------------------------------------------ shingles

def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets per text).  A text
    of fewer than ``n`` words has its whole sequence as one shingle; a text
    without words has the empty set."""
    texts = len(offsets) - 1
    h, row = word_hashes(raw, offsets)
    counts = np.bincount(row, minlength=texts) if len(row) else np.zeros(texts, np.int64)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            g = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
            whole = row[: len(g)] == row[n - 1 :]
            g, grow = g[whole], row[: len(whole)][whole]
        else:
            g, grow = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            s = np.empty(len(short), np.uint64)
            for i, r in enumerate(short):
                v = np.uint64(counts[r])
                for x in h[ends[r] - counts[r] : ends[r]]:
                    v = mix(np.array([v * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
                s[i] = v
            g, grow = np.concatenate([g, s]), np.concatenate([grow, short])
    order = np.lexsort((g, grow))
    g, grow = g[order], grow[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (grow[1:] != grow[:-1])
    g, grow = g[new], grow[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(grow, minlength=texts))]).astype(np.int64)


def _digest_pair(g: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of differently mixed members: the identity of a set."""
    with np.errstate(over="ignore"):
        padded = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
        a, b = padded(mix(g)), padded(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return (a[offs[1:]] - a[offs[:-1]]).astype(np.int64), (b[offs[1:]] - b[offs[:-1]]).astype(np.int64)


def survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass over all texts: a row (id, size, d1, d2) for each document, and
    for each task its shingle counters in packed pages (page, counts)."""
    words = ", ".join(f"{q} long" for q in PARITY)
    schema = f"id long, size long, d1 long, d2 long, {words}, page int, counts binary"
    names = ["id", "size", "d1", "d2", *PARITY, "page", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for at, raw, offs in text_slices(batch.column(1)):
                g, so = shingle_sets(raw, offs, n)
                counters += np.bincount(slot(g), minlength=len(counters))
                d1, d2 = _digest_pair(g, so)
                signs = parity(g, so)
                k = len(d1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, k),
                        pa.array(np.diff(so)),
                        pa.array(d1),
                        pa.array(d2),
                        *[pa.array(signs[:, i]) for i in range(len(PARITY))],
                        pa.nulls(k, pa.int32()),
                        pa.nulls(k, pa.binary()),
                    ],
                    names,
                )
        if counters.any():
            none = pa.nulls(PAGES, pa.int64())
            pages = pa.array([p.tobytes() for p in counters.reshape(PAGES, -1)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[none] * (4 + len(PARITY)), pa.array(np.arange(PAGES, dtype=np.int32)), pages], names
            )

    return docs.mapInArrow(run, schema)


def slot(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def add_pages(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
    total = sum((np.frombuffer(x, np.int64) for x in t["counts"]), np.zeros(1, np.int64))
    return pd.DataFrame({"page": [key[0]], "counts": [total.tobytes()]})


def shingle_counts(surveyed: DataFrame) -> np.ndarray:
    """All tasks' counters added up, in two levels so that no group holds the
    pages of many tasks; 2 MB reach the driver however large the corpus."""
    pages = surveyed.where("page is not null").select("page", "counts")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    some = salted.groupBy("page", "salt").applyInPandas(add_pages, "page int, counts binary")
    total = some.groupBy("page").applyInPandas(add_pages, "page int, counts binary").collect()
    out = np.zeros((PAGES, (1 << SKETCH_BITS) // PAGES), np.int64)
    for r in total:
        out[r["page"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


# --------------------------------------------------------------------- tiles

def least_share(size: np.ndarray, percent: int) -> np.ndarray:
    """Members of a set of this size that any linked partner shares, at least."""
    return -(-size * percent // 100)


def band(size: np.ndarray, percent: int) -> np.ndarray:
    """Geometric size bands: linked sizes lie in the same or adjacent bands."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(100 / percent) + 1e-9).astype(np.int32)


def parity(g: np.ndarray, so: np.ndarray, words: int = len(PARITY), seed: int = 0x3C6EF372FE94F82B) -> np.ndarray:
    """Parity signatures (sets x 64-bit words): each member flips one bit, so
    that of a large set is not full.  Memory follows the members."""
    k = len(so) - 1
    out = np.zeros(k * words, np.uint64)
    if len(g):
        at = mix(g ^ np.uint64(seed)) % np.uint64(64 * words)
        word = np.repeat(np.arange(k), np.diff(so)) * words + (at // np.uint64(64)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, bit = word[order], (np.uint64(1) << (at % np.uint64(64)))[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_xor.reduceat(bit, first)
    return out.view(np.int64).reshape(k, words)


def parity_allows(a: str, b: str, percent: int):
    """Whether two rows with sizes and parity signatures may link: members of
    one set only are at least the differing bits, and of two sizes the smaller
    bounds the overlap.  A necessary condition, so no link is lost."""
    differ = " + ".join(f"bit_count({a}.{q} ^ {b}.{q})" for q in PARITY)
    sizes = f"({a}.size + {b}.size)"
    most = f"least({a}.size, {b}.size, ({sizes} - ({differ})) div 2)"
    return F.expr(f"100 * {most} >= {percent} * ({sizes} - {most})")


def tile_rows(docs: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """(key, band, id, size): the prefix shingles of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, offs in text_slices(batch.column(1)):
                g, so = shingle_sets(raw, offs, n)
                size = np.diff(so)
                row = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((g, counts.value[slot(g)], row))
                place = np.arange(len(g)) - np.repeat(so[:-1], size)
                take = place < np.repeat(size - least_share(size, percent) + 1, size)
                g, row = g[order][take], row[take]
                ids = batch.column(0).slice(at, len(size)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.view(np.int64)),
                        pa.array(band(size, percent)[row]),
                        pa.array(ids[row].astype(np.int64)),
                        pa.array(size[row].astype(np.int32)),
                    ],
                    ["key", "band", "id", "size"],
                )

    return docs.mapInArrow(run, "key long, band int, id long, size int")


def set_columns(docs: DataFrame, n: int, arrays: bool) -> DataFrame:
    """(id, size, bits, members): signature bitmaps and, if asked for, the
    sorted arrays of shingle hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, offs in text_slices(batch.column(1)):
                g, so = shingle_sets(raw, offs, n)
                packed = [x.tobytes() for x in parity(g, so, BITMAP_WORDS, 0)]
                members = [g[a:b].tobytes() if arrays else None for a, b in zip(so[:-1], so[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(packed)), pa.array(np.diff(so).astype(np.int32)), pa.array(packed, pa.binary()), pa.array(members, pa.binary())],
                    ["id", "size", "bits", "members"],
                )

    return docs.mapInArrow(run, "id long, size int, bits binary, members binary")


# ------------------------------------------------------------------- compare

def linked(overlap, size_a, size_b, percent: int):
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)


def may_link(bits_a: np.ndarray, bits_b: np.ndarray, size_a, size_b, percent: int) -> np.ndarray:
    """Bit counts bound the overlap from above: each differing bit was flipped by
    a member of one set only."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    most = np.minimum((size_a + size_b - differ) // 2, np.minimum(size_a, size_b))
    return linked(most, size_a, size_b, percent)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def bound_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sa, sb = (t.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            ok = may_link(_matrix(t.column(3)), _matrix(t.column(5)), sa, sb, percent)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok)), t.column(1).filter(pa.array(ok))], ["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), F.col("bits").alias(f"g{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "ga", "sb", "gb")
    return both.mapInArrow(run, "a long, b long")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by the intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                ok.append(bool(linked(overlap(x, y), len(x), len(y), percent)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"m{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb")
    return both.mapInArrow(run, "a long, b long")


def block_links(percent: int):
    """Compare the members of two blocks of one tile: all bitmaps of different
    components at once, then exact intersections, skipping what a link found
    before has connected.  Gives the links that connect components."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["block", "id"], ignore_index=True)
        bits = np.frombuffer(b"".join(t["bits"]), np.uint64).reshape(-1, BITMAP_WORDS)
        size, comp = t["size"].to_numpy(np.int64), t["comp"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in t["members"]]
        first = t["block"].to_numpy() == t["i"].to_numpy()
        same_block = bool((t["i"] == t["j"]).all())
        root = {c: c for c in set(comp.tolist())}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x in np.flatnonzero(first):
            others = np.arange(x + 1, len(t)) if same_block else np.flatnonzero(~first)
            others = others[comp[others] != comp[x]]
            if not len(others):
                continue
            ok = may_link(bits[x], bits[others], size[x], size[others], percent)
            for y in others[ok]:
                p, q = find(comp[x].item()), find(comp[y].item())
                if p != q and linked(overlap(sets[x], sets[y]), size[x], size[y], percent):
                    root[p] = q
                    out.append((t["id"][x], t["id"][y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


# ------------------------------------------------------------------ operator

def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90
) -> DataFrame:
    """(id, n_shingles, component_id, n_class, class_id) per row of ``docs``.

    component_id is the smallest id reachable by links, its own included;
    class_id is the smallest id of the documents with the same set.  Defined
    cases: null or blank texts have no shingle and link with nothing; a row
    with a null id takes part in no link and has a null component; rows that
    repeat an id are judged by their own texts; an empty table gives no rows;
    other columns are ignored.  ``percent`` is the threshold in hundredths.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = src.where("id is not null")
    surveyed = staged(survey(src, shingle), "jaccard-survey")
    sets = surveyed.where("page is null").select("id", "size", "d1", "d2")
    signs = surveyed.where("page is null and id is not null and size > 0").select("id", "size", *PARITY)
    counts = spark.sparkContext.broadcast(shingle_counts(surveyed))
    reps = staged(
        sets.where("size > 0 and id is not null")
        .groupBy("size", "d1", "d2")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_class")),
        "jaccard-classes",
    )
    rep_ids = reps.select(F.col("rep").alias("id"))

    rows = staged(tile_rows(named, shingle, percent, counts), "jaccard-tiles")
    # most shingles stand in one set only: their rows stop here, unshuffled
    shared = staged(
        rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"),
        "jaccard-shared",
    )
    member = staged(
        among(rows, shared, ["key"]).join(shared, "key", "left_semi").join(rep_ids, "id", "left_semi"), "jaccard-members"
    )
    hubs = (
        member.groupBy("key", "band").agg(F.min("id").alias("hub"))
        .groupBy("key").agg(F.collect_list(F.struct("band", "hub")).alias("hubs"))
    )
    # own band's hub and the next smaller band's: linked sizes lie no further apart
    star = (
        member.join(hubs, "key")
        .select("id", F.explode(F.expr("filter(hubs, x -> x.band = band or x.band = band - 1)")).alias("h"))
        .select(F.least("h.hub", "id").alias("a"), F.greatest("h.hub", "id").alias("b"))
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("tiles"))
    )
    star = staged(star, "jaccard-star")
    # the hub that a member meets in most tiles is its likeliest partner; hubs
    # of the same component need no second comparison
    likely = star.groupBy("b").agg(F.max_by("a", F.struct("tiles", -F.col("a"))).alias("a")).select("a", "b")
    links = _verified(likely, named, signs, shingle, percent, "likely")
    comp = staged(components(links), "jaccard-likely-components")
    left, right = (comp.select(F.col("node").alias(x), F.col("root").alias(f"c{x}")) for x in ("a", "b"))
    apart = star.join(left, "a", "left").join(right, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    other = _verified(apart.join(likely, ["a", "b"], "left_anti"), named, signs, shingle, percent, "star")
    comp = staged(components(links.unionByName(other)), "jaccard-star-components")

    # tiles that still hold several components
    held = member.join(comp, F.col("id") == F.col("node"), "left").select(
        "key", "id", "size", F.coalesce("root", "id").alias("comp")
    )
    split = (
        held.groupBy("key")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n"))
        .where("c0 < c1")
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    rest = staged(held.join(split, "key"), "jaccard-rest")
    small = rest.where("blocks = 1").drop("size").join(signs, "id")
    x, y = small.alias("x"), small.alias("y")
    near = F.col("x.size") * 100 >= F.col("y.size") * percent
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    pairs = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & order & near)
        .where(parity_allows("x", "y", percent))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    more = _verified(pairs, named, signs, shingle, percent, "rest").unionByName(
        _large_tiles(rest.where("blocks > 1"), named, shingle, percent)
    )
    more = staged(more, "jaccard-more-links")
    if not more.isEmpty():
        tree = comp.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        comp = components(tree.unionByName(more))
    named_sets = sets.join(reps, ["size", "d1", "d2"], "left").join(
        comp.select(F.col("node").alias("rep"), "root"), "rep", "left"
    )
    own = F.col("id")
    return named_sets.select(
        own.alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(own.isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"),
        F.when(own.isNotNull(), F.coalesce("n_class", F.lit(1).cast("long"))).alias("n_class"),
        F.when(own.isNotNull(), F.coalesce("rep", "id")).alias("class_id"),
    )


def _verified(pairs: DataFrame, docs: DataFrame, signs: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """Links among candidate pairs: parity words first, then bitmaps, then exact
    intersections.  Only texts of documents in a surviving pair are shingled again."""
    side = lambda x, to: signs.select(F.col("id").alias(x), F.struct("size", *PARITY).alias(to))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    pairs = staged(both.where(parity_allows("x", "y", percent)).select("a", "b").distinct(), f"jaccard-{name}-pairs")
    ids = lambda p: p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = set_columns(among(docs, ids(pairs), ["id"]), shingle, False)
    alive = staged(bound_pairs(pairs, bits, percent), f"jaccard-{name}-bound")
    arrays = set_columns(among(docs, ids(alive), ["id"]), shingle, True).select("id", "members")
    return staged(exact_links(alive, arrays, percent).distinct(), f"jaccard-{name}-links")


def _large_tiles(rest: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links within tiles of more than ``BLOCK`` members: each member goes to
    the block pairs it belongs to, so no group has more than about two blocks."""
    if rest.isEmpty():
        return rest.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = set_columns(among(docs, rest.select("id").distinct(), ["id"]), shingle, True)
    cut = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "comp"
    )
    full = dealt.join(sets.dropDuplicates(["id"]), "id")
    return full.groupBy("key", "i", "j").applyInPandas(block_links(percent), "a long, b long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    id.  Rows with a null id stay (they have no component)."""
    kid, may = fresh(docs, "component_id"), fresh(docs, "may")
    comp = jaccard_components(docs, id_col, text_col, shingle, percent)
    gone = comp.where(f"{id_col} <> component_id").select(F.col(id_col).alias(kid)).distinct()
    gone = staged(gone, "jaccard-gone")
    # only rows that may go are shuffled with their texts
    flagged = maybe_among(docs.withColumn(kid, F.col(id_col).cast("long")), gone, [kid], may)
    stay = flagged.where(may).join(gone, kid, "left_anti")
    return flagged.where(~F.col(may)).select(docs.columns).unionByName(stay.select(docs.columns))
