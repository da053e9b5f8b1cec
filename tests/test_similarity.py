"""Exact similarity (H3, H4), fuzzy name resolution (E1, D5) and description
de-duplication (E2, D6) against a plain sequential model."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfarer.functions import lcs
from wayfarer.functions.lcs import Texts, lcs_reaches
from wayfarer.functions.similarity import lcs_expr, lcs_len, token_sort_key
from wayfarer.operators import resolve
from wayfarer.operators.resolve import dedupe_descriptions, resolve_against, resolve_names, similar_name_pairs


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


@given(st.text(alphabet="abcé ", max_size=40), st.text(alphabet="abcé ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_lcs_matches_dp(a, b):
    assert lcs_len(a, b) == lcs_dp(a, b)


@given(st.lists(st.text(alphabet="ab c", max_size=90), min_size=2, max_size=6), st.integers(-3, 95))
@settings(max_examples=200, deadline=None)
def test_batched_lcs_test_is_exact(texts, need):
    i, j = np.triu_indices(len(texts), 1)
    got = lcs_reaches(Texts(texts), i, j, np.full(len(i), need))
    assert got.tolist() == [lcs_dp(texts[a], texts[b]) >= need for a, b in zip(i, j)]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        p = rng.randrange(len(s) + 1)
        if rng.random() < 0.4 and s:
            s.pop(min(p, len(s) - 1))
        else:
            s.insert(p, rng.choice("abcdeé全"))
    return "".join(s)


def test_batched_lcs_at_and_around_the_threshold():
    """Long texts over many words of bits, several lengths and small batches;
    each pair is asked for its own LCS, one less and one more."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde") for _ in range(n)) for n in (0, 3, 63, 64, 65, 130, 400, 900)]
    texts = [edited(rng, rng.choice(base), rng.randint(0, 150)) for _ in range(40)]
    i, j = np.triu_indices(len(texts), 1)
    exact = np.array([lcs_len(texts[a], texts[b]) for a, b in zip(i, j)])
    for change in (-7, -1, 0, 1, 2):
        assert (lcs_reaches(Texts(texts), i, j, exact + change) == (change <= 0)).all()
    total = np.array([len(texts[a]) + len(texts[b]) for a, b in zip(i, j)])
    need = (171 * total + 399) // 400
    assert (lcs_reaches(Texts(texts), i, j, need) == ((exact >= need) | (need <= 0))).all()


@pytest.mark.parametrize("alone", [False, True])
def test_pairs_alone_and_together_agree(monkeypatch, alone):
    monkeypatch.setattr(lcs, "_alone_is_cheaper", lambda *_: alone)
    monkeypatch.setattr(lcs, "ALONE_ROWS", 40)
    test_batched_lcs_at_and_around_the_threshold()


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(lcs, "CELLS", 64)
    monkeypatch.setattr(lcs, "MASK_CELLS", 200)
    test_batched_lcs_at_and_around_the_threshold()


def test_lcs_expression_matches_dp(spark):
    rng = random.Random(7)
    pairs = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = list(zip(pairs[::2], pairs[1::2]))
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.l for r in df.select(lcs_expr("a", "b").alias("l")).collect()]
    assert got == [lcs_dp(a, b) for a, b in rows]


def py_key(s):
    s = "".join(ch for ch in s.lower() if not (128 <= ord(ch) <= 255))
    s = "".join(ch if ch.isalnum() else " " for ch in s)
    return " ".join(sorted(s.split()))


def test_token_sort_key(spark):
    df = spark.createDataFrame([("Wat  Arun-Temple!",), ("Café Noir",), ("!!!",)], "n string")
    got = [r.k for r in df.select(token_sort_key(F.col("n")).alias("k")).collect()]
    assert got == ["arun temple wat", "caf noir", ""]


def sequential_leaders(rows, match):
    """The source's rule: join the earliest matching leader, else lead."""
    leaders, out = {}, {}
    for seq, group, name in sorted(rows):
        ls = leaders.setdefault(group, [])
        hit = next((x for x in ls if match(name, x)), None)
        if hit is None:
            ls.append(name)
            hit = name
        out[seq] = hit
    return out


def name_match(a, b):
    a, b = py_key(a), py_key(b)
    return bool(a) and bool(b) and 400 * lcs_len(a, b) > 181 * (len(a) + len(b))


def _names(seed, n):
    rng = random.Random(seed)
    stems = ["river temple", "old market", "sunset beach", "night bazaar", "grand palace", "x"]
    out = []
    for i in range(n):
        s = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):  # a few edits -> chains of near matches
            op, p = rng.random(), rng.randrange(len(s) + 1)
            if op < 0.4 and s:
                s.pop(min(p, len(s) - 1))
            elif op < 0.8:
                s.insert(p, rng.choice("aeiou"))
            else:
                s.insert(p, " ")
        if rng.random() < 0.1:
            s = list(" ".join(reversed("".join(s).split())))  # word order only
        out.append((i, rng.choice(["A", "B"]), "".join(s) or "!"))
    return out


def test_resolve_names_equals_sequential_model(spark):
    rows = _names(1, 300)
    df = spark.createDataFrame(rows, "seq long, country string, place string")
    got = {r.seq: r.resolved for r in resolve_names(df, ["country"], "place", ["seq"]).collect()}
    assert got == sequential_leaders(rows, name_match)


@pytest.mark.parametrize("finish_edges", [0, 60, 10**6])
def test_leaders_by_rounds_and_by_one_last_task(spark, finish_edges):
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(150), 2))) for _ in range(400)} | {(i, i + 1) for i in range(30)})
    vertices = spark.range(160).selectExpr("id AS vid")
    got = resolve.leader_rounds(vertices, spark.createDataFrame(edges, "src long, dst long"), finish_edges=finish_edges).collect()
    want = {}
    for v in range(160):
        want[v] = min((a for a, b in edges if b == v and want[a] == a), default=v)
    assert {r.vid: r.leader for r in got} == want


def test_similar_name_pairs_are_exactly_the_matches(spark):
    rows = _names(2, 120)
    df = spark.createDataFrame(rows, "seq long, country string, place string")
    got = {(r.country, r.name_a, r.name_b) for r in similar_name_pairs(df, ["country"], "place", ["seq"]).collect()}
    first = {}
    for seq, g, name in sorted(rows):
        first.setdefault((g, py_key(name) or "\0" + name), (seq, name))
    verts = sorted((s, g, n) for (g, _), (s, n) in first.items())
    want = {
        (g1, n1, n2)
        for i, (s1, g1, n1) in enumerate(verts)
        for (s2, g2, n2) in verts[i + 1:]
        if g1 == g2 and name_match(n1, n2)
    }
    assert got == want


def pairs_of(rows):
    first = {}
    for seq, g, name in sorted(rows):
        first.setdefault((g, py_key(name) or "\0" + name), (seq, name))
    verts = sorted((s, g, n) for (g, _), (s, n) in first.items())
    return {
        (g1, n1, n2) for i, (_, g1, n1) in enumerate(verts) for (_, g2, n2) in verts[i + 1 :] if g1 == g2 and name_match(n1, n2)
    }


@pytest.mark.parametrize("hot_pairs", [1, 12])
def test_hot_signatures_are_split_without_losing_a_pair(spark, monkeypatch, hot_pairs):
    """Most names share their rarest bigrams: every signature counts as hot, is
    split by a second one and cut into tiles of three."""
    rng = random.Random(9)
    stem = "grand central market hall of the old river town"
    rows = [(i, "A", edited(rng, stem, rng.randint(0, 4))) for i in range(40)] + [(100 + i, g, n) for i, g, n in _names(4, 20)]
    df = spark.createDataFrame(rows, "seq long, country string, place string")
    plain = resolve.matching_edges
    monkeypatch.setattr(resolve, "matching_edges", lambda v, *a, **k: plain(v, *a, tile=3, hot_pairs=hot_pairs, **k))
    got = {(r.country, r.name_a, r.name_b) for r in similar_name_pairs(df, ["country"], "place", ["seq"]).collect()}
    assert got == pairs_of(rows)


def test_a_hot_signature_spreads_over_tiles(spark):
    """A third of all names share one signature: no tile holds more than two
    chunks of it, and the tiles go to many partitions."""
    names = [(i, "g", 11, 11, 11, "s" if i % 3 == 0 else f"s{i}") for i in range(1200)]
    rows = spark.createDataFrame(names, "_id long, _g string, _l int, _lo int, _hi int, sig string")
    light, hot = resolve._hot(resolve._sided(rows, None), 1000)
    assert hot.count() == 400 and light.count() == 800
    tiles = resolve._hot_tiles(hot, 50)
    sizes = [r["count"] for r in tiles.groupBy("_i", "_j").count().collect()]
    assert len(sizes) == 36 and max(sizes) <= 2 * 75
    assert sum(1 for n in tiles.repartition(16, *resolve.BLOCK, "_i", "_j").rdd.glom().map(len).collect() if n) > 8


@pytest.mark.parametrize("hot_pairs", [1 << 16, 1])
def test_fixed_leaders_equal_sequential_model(spark, monkeypatch, hot_pairs):
    """Names of the base lead, in its order; a name that stands there as it is
    keeps its spelling, later names join the earliest leader they match."""
    if hot_pairs == 1:
        plain = resolve.matching_edges
        monkeypatch.setattr(resolve, "matching_edges", lambda v, *a, **k: plain(v, *a, **{**k, "tile": 3, "hot_pairs": 1}))
    base, new = _names(11, 30), _names(12, 70)
    new += [(1000 + i, g, n) for i, g, n in base[:10]] + [(2000, "C", "only here"), (2001, "C", "only herr"), (2002, None, "x y z"), (2003, "A", None)]
    schema = "seq long, country string, place string"
    got = resolve_against(spark.createDataFrame(new, schema), spark.createDataFrame(base, schema), ["country"], "place", ["seq"], ["seq"])
    leaders = {}
    for _, g, n in sorted(base):
        leaders.setdefault(g, []).append(n)
    exact = {(g, n) for _, g, n in base}
    want = {}
    for seq, g, n in sorted(new, key=lambda r: r[0]):
        if (g, n) in exact or n is None:
            want[seq] = n
            continue
        hit = next((x for x in leaders.setdefault(g, []) if name_match(n, x) or n == x), None)
        if hit is None:
            leaders[g].append(n)
        want[seq] = hit or n
    assert {r.seq: r.resolved for r in got.collect()} == want


def desc_match(a, b):
    a, b = a.lower(), b.lower()
    n = len(a) + len(b)
    return n > 0 and 400 * lcs_len(a, b) >= 171 * n


@pytest.mark.parametrize("tile", [256, 3])
def test_dedupe_descriptions_equals_sequential_model(spark, tile):
    rng = random.Random(3)
    base = ["The temple is quiet at dawn and the murals are fine.", "Cheap food stalls line the river at night.", "Short."]
    rows = []
    for i in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            p = rng.randrange(len(s))
            s[p] = rng.choice("xyz ")
        rows.append((i, rng.choice(["A", "B"]), "P", "".join(s)))
    df = spark.createDataFrame(rows, "seq long, country string, place string, description string")
    got = {r.seq: r.kept for r in dedupe_descriptions(df, ["country", "place"], "description", ["seq"], tile=tile).collect()}
    kept, want = {}, {}
    for seq, c, p, d in rows:
        ks = kept.setdefault((c, p), [])
        dup = any(desc_match(d, x) for x in ks)
        if not dup:
            ks.append(d)
        want[seq] = not dup
    assert got == want


def test_a_block_over_many_tiles_and_lengths(spark):
    """One group of 700 texts of all lengths, a third of them of one length,
    null groups, null and equal texts, and columns with the names used inside."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 40, 41, 42, 60, 200]))) for _ in range(40)]
    rows = [(i, None, edited(rng, rng.choice(base), rng.randint(0, 6)), 1) for i in range(430)]
    rows += [(500 + i, None, edited(rng, "z" * 40, 0)[: 40 - i % 2] + "qrst"[i % 4], 1) for i in range(230)]
    rows += [(900 + i, None, t, 1) for i, t in enumerate([None, "", "", "ABC abc", "abc ABC", None])]
    df = spark.createDataFrame(rows, "seq long, country string, description string, extra int").selectExpr(
        "*", "extra AS _id2", "extra AS key", "extra AS vid", "extra AS id", "extra AS leader"
    )
    out = dedupe_descriptions(df, ["country"], "description", ["seq"], tile=16)
    assert out.columns == [*df.columns, "kept"]
    got = {r.seq: r.kept for r in out.collect()}
    kept, seen, want = [], set(), {}
    for seq, _, d, _ in rows:
        if d is None or d.lower() in seen:
            want[seq] = False
            continue
        seen.add(d.lower())
        want[seq] = not any(desc_match(d, x) for x in kept)
        if want[seq]:
            kept.append(d)
    assert got == want


def test_groups_finish_in_tasks_of_their_own(spark, monkeypatch):
    """Edges of one group are few, of all groups many: no round is needed."""
    rng = random.Random(12)
    groups = {g: range(100 * g, 100 * g + 30) for g in range(12)}
    edges = [(a, b) for ids in groups.values() for a in ids for b in ids if a < b and rng.random() < 0.1]
    assert len(edges) > 300
    cuts, cut = [], resolve._cut
    monkeypatch.setattr(resolve, "_cut", lambda df: cuts.append(1) or cut(df))
    vertices = spark.createDataFrame([(i, f"g{g}") for g, ids in groups.items() for i in ids], "vid long, _g string")
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r["vid"]: r["leader"] for r in resolve.leader_rounds(vertices, frame, finish_edges=300).collect()}
    assert len(cuts) == 3
    want = {}
    for ids in groups.values():
        for b in ids:
            want[b] = min((a for a, c in edges if c == b and want[a] == a), default=b)
    assert got == want
    again = {r["vid"]: r["leader"] for r in resolve.leader_rounds(vertices, frame, finish_edges=2).collect()}
    assert again == want


def test_no_tokens_where_subsequences_do(spark):
    """Names whose lengths need no tokens make none, and shared subsequences
    are matches without another LCS."""
    rows = [(i, "g", f"name number {i:05d}") for i in range(0, 900, 7)]
    v = spark.createDataFrame(rows, "_id long, _g string, key string")
    plain, tokens = resolve._signed(v, resolve.NAME_SLACK, resolve.NAME_STRICT)
    assert tokens.count() == 0 and "Generate" not in tokens._jdf.queryExecution().executedPlan().toString()
    got = {(r["src"], r["dst"]) for r in resolve.matching_edges(v, resolve.NAME_SLACK, resolve.NAME_STRICT).collect()}
    assert got == {(a, b) for a, _, x in rows for b, _, y in rows if a < b and 400 * _lcs(x, y) > 181 * (len(x) + len(y))}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]
