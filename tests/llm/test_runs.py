"""Operator 11 against the definition: every period, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import LONG, edge_rows, frame

from wayfarer.llm.common import word_hashes
from wayfarer.llm.queries import QUERIES
from wayfarer.llm.runs import SuffixTree, all_runs, find_runs, lyndon_ends, repeating_stretches

SF0001 = "/root/testdata/sf0.001"


def brute(seq, min_length=1, min_periods=2):
    """Stretches of each period, those of a smaller period left out."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in seq], np.int64)
    out, seen = [], {}
    for q in range(1, len(x) // min_periods + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], x[q:] == x[:-q], [0]])))
        for s, e in zip(same[::2].tolist(), same[1::2].tolist()):
            length = e - s + q
            if length >= min_periods * q and not any(q % p == 0 for p in seen.get((s, length), [])):
                seen.setdefault((s, length), []).append(q)
                if length >= min_length:
                    out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall("[^ \t-\r]+", text or "")


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_all_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        seq = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert all_runs(seq) == brute(seq)


def test_runs_of_fibonacci_words():
    a, b = [1], [1, 2]
    for _ in range(10):
        a, b = b, b + a
    assert all_runs(b) == brute(b)


def test_extensions_and_lyndon_words():
    rng = random.Random(3)
    for _ in range(100):
        seq = [rng.randint(1, 3) for _ in range(rng.randint(2, 30))]
        tree, n = SuffixTree(seq), len(seq)
        suffixes = sorted(range(n + 1), key=lambda i: seq[i:])
        assert [int(r) for r in np.argsort(tree.rank)] == suffixes
        i, j = zip(*[(i, j) for i in range(n) for j in range(n + 1) if i != j])

        def common(a, b):
            k = 0
            while max(a, b) + k < n and seq[a + k] == seq[b + k]:
                k += 1
            return k

        assert tree.extension(np.array(i), np.array(j)).tolist() == [common(a, b) for a, b in zip(i, j)]
        for i, end in enumerate(lyndon_ends(tree.rank).tolist()):
            best = max(e for e in range(i + 1, n + 1) if all(seq[i:e] < seq[k:e] for k in range(i + 1, e)))
            assert end == best


def planted(rng):
    """Text with periodic stretches, broken ones and repeated passages."""
    out = []
    for _ in range(rng.randint(1, 5)):
        root = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 30))]
        turn = root * rng.randint(1, 9)
        turn = turn[: rng.randint(1, len(turn))]
        if rng.random() < 0.3:
            turn[rng.randrange(len(turn))] = "X"
        out += turn + [rng.choice("pqrst") for _ in range(rng.randint(0, 6))]
    if rng.random() < 0.3:
        out += out
    return out


@pytest.mark.parametrize("limits", [(24, 3), (10, 2), (1, 2), (16, 4)])
def test_stretches_hold_every_run(limits):
    rng = random.Random(5)
    for _ in range(150):
        texts = [" ".join(planted(rng)).encode() for _ in range(3)]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        hashes, rows = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
        starts, ends = repeating_stretches(hashes, rows, *limits)
        first = np.searchsorted(rows, np.arange(3))
        held = [(int(rows[s]), s - first[rows[s]], e - first[rows[s]]) for s, e in zip(starts, ends)]
        for row, text in enumerate(texts):
            for s, n, q in brute(text.split(), *limits):
                assert any(r == row and a <= s and s + n <= b for r, a, b in held)


def test_operator_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(planted(rng))) for i in range(200)] + edge_rows()
    got = {}
    for r in find_runs(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for i, text in rows:
        runs = [(0, 36_000, 3)] if text == LONG else brute(words_of(text), 24, 3)
        want.setdefault(i, []).append((runs, collapse(words_of(text), runs)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_case_counts(spark):
    """Words that differ in case only are different words."""
    text = " ".join(["a", "b"] * 10 + ["A", "b"] + ["a", "b"] * 10)
    assert [r["runs"] for r in find_runs(frame(spark, [(1, text)])).collect()] == [[]]


def test_empty_table(spark):
    assert find_runs(frame(spark, [])).collect() == []


def test_query_equals_brute_force_on_the_whole_table(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want, some = {}, 0
    for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect():
        words, h = words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words, 24, 3)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        some += top is not None
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want[r["doc_id"]] = (len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(words, runs)))
    got = QUERIES["op11_periodic_runs"](spark, SF0001)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes[:6]} == {"bigint"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and some >= 5


def test_best_run_of_ties(spark):
    from wayfarer.llm.queries import runs_digest

    runs = [(5, 30, 10), (40, 27, 9), (80, 33, 11), (120, 9, 4)]
    df = spark.createDataFrame([(1, runs, "x"), (2, [], "")], "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    got = runs_digest(df).orderBy("doc_id").collect()
    assert tuple(got[0])[:6] == (1, 4, 5, 30, 10, 3000) and tuple(got[1])[:6] == (2, 0, None, None, None, None)
