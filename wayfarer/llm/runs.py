"""Periodic runs of words by longest common extensions in suffix trees.

A run is a maximal stretch of words with smallest period q that holds at least
``min_periods`` periods and ``min_length`` words.

1. *Stretches.*  In such a run, every gram of ``k`` words (``k`` follows from
   the two limits, see ``gram_size``) has an equal gram within a ``min_periods``-th
   of the stretch, before or after it.  Stretches of words without that
   property hold no run and get no tree.  Grams are compared by hash and
   letters regardless of case, which can only keep more.
2. *Trees.*  The stretches of a document, parted by words of their own, and
   their reversal each get a suffix tree by Ukkonen's construction.  A tour
   over a tree visits the leaves in order; the least depth passed between two
   leaves is that of their lowest common ancestor, and a sparse table over the
   tour gives it for any pair in constant time: the longest common extension.
3. *Candidates.*  Every run has, for one of the two orders of words, a longest
   Lyndon word that starts in it and is as long as its period.  The longest
   Lyndon word at i ends at the next suffix that is smaller than suffix i.
   Each gives one candidate period, extended to the right in the first tree
   and to the left in the second.

All documents are independent; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded_batches, mix, text_slices, word_hashes

MIN_LENGTH = 24
MIN_PERIODS = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
FLUSH_BYTES = 8 << 20


# ------------------------------------------------------------------ stretches

def gram_size(min_length: int, min_periods: int) -> int:
    """The longest gram whose repetitions cover every run: a run of length L
    and period q has equal grams q apart from its start to its end if
    L >= 2q + k - 1, which the two limits imply for this k."""
    return min_length * (min_periods - 2) // min_periods + 1


def covered(words: np.ndarray, group: np.ndarray, k: int, min_length: int, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches of at least ``min_length`` words of one
    group in which every gram repeats within a ``min_periods``-th of the
    group's words."""
    none = np.zeros(0, np.int64)
    n = len(words) - k + 1
    if n < min_length - k + 1:
        return none, none
    with np.errstate(over="ignore"):
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams = grams * ODD + words[j : j + n]
        grams = mix(grams ^ mix(group[:n].astype(np.uint64) + ODD))
    whole = group[:n] == group[k - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(grams[at], kind="stable")]
    if len(order) < 2:
        return none, none
    same = grams[order[1:]] == grams[order[:-1]]
    gap = np.where(same, order[1:] - order[:-1], len(words))
    nearest = np.full(len(order), len(words), np.int64)
    nearest[1:] = gap
    nearest[:-1] = np.minimum(nearest[:-1], gap)
    size = np.unique(group, return_inverse=True, return_counts=True)
    limit = size[2][size[1]] // min_periods
    good = np.zeros(n + 1, np.int8)
    good[order] = nearest <= limit[order]
    # stretches end where a gram fails or the next one starts in another group
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good])))
    starts, ends = edge[::2], edge[1::2]
    inner = np.flatnonzero((group[1:n] != group[: n - 1]) & (good[1:n] == 1) & (good[: n - 1] == 1)) + 1
    starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    ends = ends + k - 1
    long = ends - starts >= min_length
    return starts[long], ends[long]


def repeating_stretches(
    words: np.ndarray, rows: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches that can hold a run, narrowed until
    each one repeats within itself."""
    k = gram_size(min_length, min_periods)
    starts, ends = covered(words, rows, k, min_length, min_periods)
    total = -1
    while len(starts) and total != (ends - starts).sum():
        total = (ends - starts).sum()
        size = ends - starts
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(starts)), size)
        place = np.arange(total) - np.repeat(first, size) + np.repeat(starts, size)
        a, b = covered(words[place], group, k, min_length, min_periods)
        starts, ends = place[a], place[b - 1] + 1 if len(b) else b
    return starts, ends


# ----------------------------------------------------------------------- trees

class SuffixTree:
    """Ukkonen's suffix tree of ``seq`` (ints of 1 and up; 0 ends it)."""

    def __init__(self, seq: list[int]):
        self.n = len(seq)
        self.seq = [*seq, 0]
        self._build()
        self._tour()

    def _build(self) -> None:
        seq, open_end = self.seq, len(self.seq)
        start, end, link, child = [0], [0], [0], [{}]
        node = edge = length = left = 0
        for at, word in enumerate(seq):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = at
                below = child[node].get(seq[edge])
                if below is None:
                    start.append(at)
                    end.append(open_end)
                    link.append(0)
                    child.append(None)
                    child[node][seq[edge]] = len(start) - 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = min(end[below], at + 1) - start[below]
                    if length >= size:  # walk down
                        edge += size
                        length -= size
                        node = below
                        continue
                    middle = start[below] + length
                    if seq[middle] == word:
                        length += 1
                        if last and node:
                            link[last] = node
                        break
                    fork, leaf = len(start), len(start) + 1
                    start += [start[below], at]
                    end += [middle, open_end]
                    link += [0, 0]
                    child += [{seq[middle]: below, word: leaf}, None]
                    child[node][seq[edge]] = fork
                    start[below] = middle
                    if last:
                        link[last] = fork
                    last = fork
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - left + 1
        self.start, self.end, self.child = start, end, child

    def _leaves(self, falling: bool) -> tuple[list[int], list[int]]:
        """(suffixes in order, least depth passed on the way to each); words
        rise or fall, but the end always comes first."""
        start, end, child, total = self.start, self.end, self.child, len(self.seq)
        order, low, least = [], [], 0
        stack = [(0, 0, 0)]
        while stack:
            node, above, depth = stack.pop()
            if above < least:
                least = above
            below = child[node]
            if below is None:
                order.append(total - depth)
                low.append(least)
                least = total
                continue
            if falling:
                keys = sorted(below)
                if keys[0] == 0:
                    keys.append(keys.pop(0))
            else:
                keys = sorted(below, reverse=True)
            for key in keys:
                to = below[key]
                stack.append((to, depth, depth + end[to] - start[to]))
        return order, low

    def _tour(self) -> None:
        order, low = self._leaves(False)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[order] = np.arange(self.n + 1)
        self.levels = [np.array(low, np.int32)]
        half = 1
        while 2 * half <= len(low):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))
            half *= 2

    def falling_rank(self) -> np.ndarray:
        rank = np.empty(self.n + 1, np.int64)
        rank[self._leaves(True)[0]] = np.arange(self.n + 1)
        return rank

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j (i != j)."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        power = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for p in np.unique(power):
            on = power == p
            level = self.levels[p]
            out[on] = np.minimum(level[a[on]], level[b[on] - (1 << int(p)) + 1])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word at each place: the next suffix of
    smaller rank."""
    order, n = rank.tolist(), len(rank) - 1
    out, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        mine = order[i]
        while order[stack[-1]] > mine:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def all_runs(seq: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``seq`` with two periods or
    more, by start, then period."""
    n = len(seq)
    if n < 2:
        return []
    ahead, back = SuffixTree(seq), SuffixTree(seq[::-1])
    i = np.concatenate([np.arange(n)] * 2)
    j = np.concatenate([lyndon_ends(ahead.rank), lyndon_ends(ahead.falling_rank())])
    right = ahead.extension(i, j)
    left = back.extension(n - i, n - j)
    start, end, period = i - left, j + right, j - i
    run = end - start >= 2 * period
    found = np.unique(np.stack([start, period, end - start], axis=1)[run], axis=0)
    return [(s, length, q) for s, q, length in found.tolist()]


def document_runs(words: list[bytes], stretches: list[tuple[int, int]], min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Runs of a document (word numbers), searched in its ``stretches``."""
    number: dict[bytes, int] = {}
    seq: list[int] = []
    place: list[int] = []
    for k, (a, b) in enumerate(stretches):
        seq += [number.setdefault(w, len(number) + 1) for w in words[a:b]]
        place += range(a, b)
        seq.append(len(number) + 1)  # a word of its own parts the stretches
        number[b" %d" % k] = len(number) + 1
        place.append(-1)
    return [(place[s], n, q) for s, n, q in all_runs(seq) if n >= min_length and n >= min_periods * q]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without what repeats a run's first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """Per row: id, runs (array of start, length, period as longs, by start,
    then period; word numbers from 0) and collapsed (the text's words without
    the repetitions, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, compared exactly.  Defined cases: a null
    or empty text has no words, no run and an empty collapsed text; null ids
    stay null; repeated rows come out alike; an empty table gives no rows;
    other columns are ignored.  ``min_periods`` is 2 or more.
    """
    if min_periods < 2:
        raise ValueError("a run holds at least two periods")
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in text_slices(batch.column(1), FLUSH_BYTES):
                hashes, rows = word_hashes(raw, offsets)
                a, b = repeating_stretches(hashes, rows, min_length, min_periods)
                row_start = np.searchsorted(rows, np.arange(len(offsets)))
                of_row: dict[int, list[tuple[int, int]]] = {}
                for s, e in zip(a.tolist(), b.tolist()):
                    row = int(rows[s])
                    of_row.setdefault(row, []).append((s - int(row_start[row]), e - int(row_start[row])))
                runs, texts = [], []
                data = raw.tobytes()
                for row in range(len(offsets) - 1):
                    words = data[offsets[row] : offsets[row + 1]].split()
                    found = document_runs(words, of_row[row], min_length, min_periods) if row in of_row else []
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["id", "runs", "collapsed"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        search, f"id {id_type}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return out.withColumnRenamed("id", id_col)
