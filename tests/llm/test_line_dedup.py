"""Operator 5 against a direct reading of its rule."""

import random

from helpers import edge_rows, frame, prose

from wayfarer.llm.line_dedup import dedup_lines, windows, winnow


def brute(rows, min_words):
    """(id, text, n_lines, n_deleted): windows in (id, position) order."""
    first, spans = {}, []
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    gone = {}
    for known, i, text in order:
        lines = text.split("\n")
        out = set()
        for a, b in windows([len(x.encode().split()) for x in lines], min_words):
            run = "\n".join(lines[a : b + 1])
            if first.setdefault(run, (known, i, a)) != (known, i, a):
                out.update(range(a, b + 1))
        gone[(known, i, text)] = out
    for i, t in rows:
        out = gone[(i is not None, i or 0, t or "")]
        lines = (t or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if k not in out)
        spans.append((i, left if out else t, len(lines), len(out)))
    return sorted(spans, key=repr)


def corpus():
    rng = random.Random(6)
    passage = [prose(1000 + k, 9) for k in range(7)]
    rows = []
    for d in range(40):
        lines = [prose(d * 50 + k, rng.randint(1, 14)) for k in range(rng.randint(1, 12))]
        if d % 3 == 0:
            a = rng.randint(0, 3)
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[a : a + rng.randint(2, 4)]
        if d % 7 == 0:
            lines += lines[: len(lines) // 2]  # repeats itself
        rows.append((d, "\n".join(lines)))
    rows += [(100 + k, rows[3][1]) for k in range(5)]
    return rows + edge_rows() + rows[:2]


def answer(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in df.collect()), key=repr)


def test_deleted_lines(spark):
    rows = corpus()
    df = frame(spark, rows)
    got = dedup_lines(df, min_words=20)
    assert set(got.columns) == {*df.columns, "n_lines", "n_deleted"}
    assert answer(got) == brute(rows, 20)


def test_texts_without_repeats_stay(spark):
    rows = [(k, "\n".join(prose(k * 100 + j, 30) for j in range(4))) for k in range(10)]
    assert all(r["n_deleted"] == 0 for r in dedup_lines(frame(spark, rows)).collect())
    assert dedup_lines(frame(spark, [])).collect() == []


def test_every_window_selects_its_last_smallest_line():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.randint(0, 6) for _ in range(rng.randint(0, 30))]
        hashes = [rng.randint(0, 9) for _ in words]
        spans = windows(words, 8)
        for i, j in spans:
            assert sum(words[i : j + 1]) >= 8 and sum(words[i:j]) < 8
        best = [max(k for k in range(i, j + 1) if hashes[k] == min(hashes[i : j + 1])) for i, j in spans]
        assert winnow(hashes, spans) == best
