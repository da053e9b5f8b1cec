"""Operator 7 against dictionaries keyed by the same slots."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import edge_rows, frame, prose

from wayfarer.llm.common import mix, word_hashes
from wayfarer.llm.lm_score import ALPHA, MU, PAIR_BITS, WORD_BITS, cross_entropy_difference


def slots(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    h, _ = word_hashes(raw, np.array([0, len(raw)]))
    words = [int(x) >> (64 - WORD_BITS) for x in h]
    pairs = [
        int(mix(np.array([(int(a) * 0x9E3779B97F4A7C15 + int(b)) % 2**64], np.uint64))[0]) >> (64 - PAIR_BITS)
        for a, b in zip(h[:-1], h[1:], strict=True)
    ]
    return words, pairs


def brute(rows, good):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 2

    def model(texts):
        w, p = Counter(), Counter()
        for t in texts:
            a, b = slots(t)
            w.update(a)
            p.update(b)
        n = sum(w.values())

        def bits(words, pairs):
            total = 0.0
            for k, x in enumerate(words):
                prob = (w[x] + ALPHA) / (n + ALPHA * 2**WORD_BITS)
                if k:
                    c = p[pairs[k - 1]]
                    prob = (c + MU * prob) / (max(w[words[k - 1]], c) + MU)
                total -= math.log2(prob)
            return total / max(1, len(words))

        return bits

    target = [model([t for i, t in rows if i in good and fold(i) != f]) for f in (0, 1)]
    back = [model([t for i, t in rows if fold(i) != f]) for f in (0, 1)]
    out = []
    for i, t in rows:
        words, pairs = slots(t)
        a, b = target[fold(i)](words, pairs), back[fold(i)](words, pairs)
        out.append((i, len(words), a, b, a - b))
    return sorted(out, key=repr)


def test_scores(spark):
    rows = [(100 + k, prose(k, 20 + k, "ab" if k % 2 else "cde")) for k in range(40)] + edge_rows()
    good = [100 + k for k in range(0, 40, 2)]
    labels = spark.createDataFrame([(i,) for i in [*good, None, 99999]], "doc_id long")
    got = cross_entropy_difference(frame(spark, rows), labels).collect()
    cols = ["doc_id", "n_tokens", "target_bits", "background_bits", "score"]
    got = sorted((tuple(r[c] for c in cols) for r in got), key=lambda r: (repr(r[0]), r[1]))
    want = sorted(brute(rows, set(good)), key=lambda r: (repr(r[0]), r[1]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == pytest.approx(w[2:], rel=1e-5, abs=1e-6)
    by_kind = {k: np.mean([g[4] for g in got if g[0] and g[0] >= 100 and g[0] % 2 == k]) for k in (0, 1)}
    assert by_kind[0] < by_kind[1]  # texts like the target lose less under it
    assert all(g[1:] == (0, 0.0, 0.0, 0.0) for g in got if g[0] in (1, 2, 3))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert cross_entropy_difference(frame(spark, []), none).collect() == []
    assert len(cross_entropy_difference(frame(spark, edge_rows()), none).collect()) == len(edge_rows())


def test_word_hashes_follow_words_only():
    texts = ["Ab cd", "ab\x0bCD ", "", "cd", "É é", "é x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, row = word_hashes(raw, offs)
    assert row.tolist() == [0, 0, 1, 1, 3, 4, 4, 5, 5]
    assert h[0] == h[2] and h[1] == h[3] == h[4] and h[6] == h[7] and h[5] != h[6]
