"""``windows`` leaves out no window that the query's SQL has."""

import random

import duckdb

from wayfarer.llm.line_dedup import windows


def test_every_start_has_the_window_that_the_sql_gives_it():
    """The SQL's ``w``: of each line the least j with 50 words from it to j."""
    rng = random.Random(3)
    texts = [[rng.choice([0, 0, 1, 7, 20, 49, 50, 51, 90]) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE l (rid INT, i INT, n INT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", [(r, i, n) for r, words in enumerate(texts) for i, n in enumerate(words)])
    want = con.execute("""
        WITH c AS (SELECT *, sum(n) OVER (PARTITION BY rid ORDER BY i) AS upto FROM l)
        SELECT a.rid, a.i, min(b.i) AS j FROM c a JOIN c b ON a.rid = b.rid AND b.i >= a.i AND b.upto - a.upto + a.n >= 50
        GROUP BY ALL ORDER BY ALL""").fetchall()
    assert [(r, i, j) for r, words in enumerate(texts) for i, j in windows(words, 50)] == want and len(want) > 100
