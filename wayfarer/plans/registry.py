"""Registry of catalogue queries: name -> (Spark callable, DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from wayfarer.plans import (  # noqa: F401
        q_io,
        q_itinerary,
        q_merge,
        q_misc,
        q_pages,
        q_quality,
        q_resolve,
        q_scoring,
        q_serve,
        q_stream,
        q_summary,
        q_training,
    )
