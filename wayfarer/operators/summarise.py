"""Description gate and pluggable summariser.

The gate is JVM-side; only groups that really need a summary reach the
Python summariser (``mapInPandas`` over one row per group, whose text list is
bounded by ``num_descriptions``)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.aggs import first_distinct
from wayfarer.functions.text import bullet_list, word_count

NO_DESCRIPTION = "No description available."  # fixed value: empty-group text


def description_gate(
    df: DataFrame, keys: list[str], text_col: str, order_cols: list[str], num_descriptions: int = 3, short_words: int = 15
) -> DataFrame:
    """Per group, the first ``num_descriptions`` distinct stripped texts; of
    those the non-blank ones are valid.  none -> fixed text; exactly one with
    fewer than ``short_words`` words -> itself; otherwise the bullet-list prompt
    (H18) for the summariser.  Columns: keys, n_valid, gate, text."""
    g = first_distinct(df, keys, text_col, order_cols, num_descriptions, sep=None, out="_d")
    valid = F.filter(F.col("_d"), lambda x: x != "")
    g = g.withColumn("_valid", valid)
    n = F.size("_valid")
    one_short = (n == 1) & (word_count(F.element_at("_valid", 1)) < short_words)
    gate = F.when(n == 0, F.lit("none")).when(one_short, F.lit("verbatim")).otherwise(F.lit("summarise"))
    text = (
        F.when(n == 0, F.lit(NO_DESCRIPTION))
        .when(one_short, F.element_at("_valid", 1))
        .otherwise(bullet_list(F.col("_valid")))
    )
    return g.select(*keys, n.alias("n_valid"), gate.alias("gate"), text.alias("text"))


def lead_sentences(prompts: pd.Series) -> pd.Series:
    """Default extractive summariser: the first sentence of every bullet."""
    out = []
    for p in prompts.fillna(""):
        parts = [b[2:] if b.startswith("- ") else b for b in p.split("\n- ")]
        out.append(" ".join(x.strip().split(". ")[0].rstrip(".") + "." for x in parts if x.strip()))
    return pd.Series(out, index=prompts.index)


def summarise(gated: DataFrame, fn: Callable[[pd.Series], pd.Series] = lead_sentences) -> DataFrame:
    """Replace ``text`` of 'summarise' rows by ``fn(prompt)``; a failing call
    yields 'Error: …' as in the source."""
    todo = gated.where(F.col("gate") == "summarise")
    rest = gated.where(F.col("gate") != "summarise")

    def one(text):
        try:
            return fn(pd.Series([text])).iloc[0]
        except Exception as e:  # noqa: BLE001
            return f"Error: {e}"

    def run(it):
        for pdf in it:
            try:
                texts = fn(pdf["text"]).to_numpy()
            except Exception:  # noqa: BLE001 - per-row retry isolates bad texts
                texts = [one(t) for t in pdf["text"]]
            yield pdf.assign(text=texts)

    return rest.unionByName(todo.mapInPandas(run, todo.schema))
