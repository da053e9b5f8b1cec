"""Small inputs and brute-force versions for the training-data operators."""

from __future__ import annotations

import random

LONG = "lorem ipsum dolor " * 12_000

#: Column names that the operators use inside, to clash with.
EXTRA = ["id", "key", "size", "page", "slot", "digest", "row", "spans", "fp", "node", "comp", "may", "cut", "keep_id"]


def frame(spark, rows):
    """documents with every clashing extra column; rows are (doc_id, text) or
    (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(full, schema)
    for i, c in enumerate(EXTRA):
        df = df.selectExpr("*", f"{i} as {c}")
    return df


def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, null ids."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two three four five six"),
        (7, "one two three four five six"), (8, LONG), (8, LONG), (9, LONG), (None, "a text without an id"),
        (None, None), (10, "é̀ 全角　テスト \U0001f600 x\x00y"), (11, "One TWO three"), (12, "one two three"),
    ]


def prose(seed: int, words: int, alphabet: str = "abcdefgh") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(words))


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
