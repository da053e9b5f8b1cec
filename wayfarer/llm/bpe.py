"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encoding of a piece is the reduction of its halves' encodings by ``join``.
Joining re-encodes a window over the boundary, a few tokens from each side,
and doubles it until the window's outermost tokens come out unchanged.  Then
everything outside is proven stable: a token sequence is the merge result of
its bytes exactly if each neighbouring pair is the merge result of its own
bytes (no merge could be the first to cross a boundary), and the window keeps
both outer pairs as they were in the halves.  Decoding concatenates up the
same tree.

Texts are cut into pieces by the tokenizer's pattern and pieces are encoded
apart.  Caches of parts, halves and windows are bounded, and tasks share
nothing, so any task can run again anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded_batches

# The code points with the Unicode property White_Space, which
# \s stands for in the tokenizer's pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

CACHED_PARTS = 350_000  # of each of two generations
CACHED_WINDOWS = 400_000
HALF_BYTES = 8
PLAIN_BYTES = 48
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge result of a window's bytes: lowest rank first, then leftmost."""
        ranks = self.ranks
        if len(data) <= PLAIN_BYTES:
            get = ranks.get
            parts = [data[i : i + 1] for i in range(len(data))]
            pair = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
            while pair:
                r = min(pair)
                if r == NEVER:
                    break
                i = pair.index(r)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pair[i]
                if i < len(pair):
                    pair[i] = get(parts[i] + parts[i + 1], NEVER)
                if i:
                    pair[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            return tuple([ranks[p] for p in parts])
        # the same with a heap over a linked list, for wide windows
        n = len(data)
        end = list(range(1, n + 1))  # end of the part that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = ranks.get(data[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and alive[j] and end[j] == e):
                continue
            alive[j] = False
            end[i] = e
            if e < n:
                prev[e] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid operation on merge results."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            key = left[-a:] + right[:b]
            w = self.windows.get(key)
            if w is None:
                w = self.merged(b"".join([self.tokens[i] for i in key]))
                if len(key) <= 8:
                    if len(self.windows) >= CACHED_WINDOWS:
                        self.windows.clear()
                    self.windows[key] = w
            steady_left = a == len(left) or w[0] == left[-a]
            steady_right = b == len(right) or w[-1] == right[b - 1]
            if steady_left and steady_right:
                return left[:-a] + w + right[b:]
            if not steady_left:
                a = min(2 * a, len(left))
            if not steady_right:
                b = min(2 * b, len(right))

    def reduce(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        if n == 1:
            return (self.ranks[piece],)
        if n <= HALF_BYTES:
            found = self.halves.get(piece)
            if found is not None:
                return found
        out = self.join(self.reduce(piece[: n // 2]), self.reduce(piece[n // 2 :]))
        if n <= HALF_BYTES:
            if len(self.halves) >= CACHED_WINDOWS:
                self.halves.clear()
            self.halves[piece] = out
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self.reduce(piece) if piece else ()

    def decode(self, ids: tuple[int, ...]) -> bytes:
        if len(ids) <= 8:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCodec:
    """Ids of whole texts, as decimal text, and their decoded bytes."""

    def __init__(self, bpe: Bpe, pattern: str):
        import regex

        self.bpe = bpe
        self.pieces = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")).findall
        self.run_of_white = re.compile(f" [{WHITE}]|[{WHITE}] ").search
        self.parts = _Generations(self._encode_part, CACHED_PARTS)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.bpe.encode_piece(piece.encode())]

    def _encode_part(self, part: str) -> tuple[str, bytes]:
        pieces = self.pieces(part)
        if len(pieces) > 1:  # its pieces are parts of their own
            found = [self.parts[p] for p in pieces]
            return "".join([f[0] for f in found]), b"".join([f[1] for f in found])
        ids = self.bpe.encode_piece(part.encode())
        return "".join([f"{i}," for i in ids]), self.bpe.decode(ids)

    def __call__(self, text: str) -> tuple[str, bytes]:
        """(ids, each followed by a comma; decoded bytes).  A single space
        between two other characters always starts a match, so the text is cut
        there and equal parts are encoded once."""
        if self.run_of_white(text):
            parts = self._cut(text)
        else:
            parts = text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else [text]
        found = [self.parts[p] for p in parts]
        return "".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def _cut(self, text: str) -> list[str]:
        """The same cuts where white space also comes in runs."""
        return re.split(f"(?<=[^{WHITE}])(?= [^{WHITE}])", text)


class _Generations(dict):
    """A cache of two generations: what was used lately survives a clearing."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=1)
def codec_of(ranks_path: str, pattern: str) -> TextCodec:
    """One codec in a Python worker, whose caches outlive a task."""
    return TextCodec(Bpe(load_ranks(ranks_path)), pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (the bytes that the ids decode to).

    Defined cases: a null text is empty and has no token; null ids stay null;
    repeated rows come out alike; an empty table gives no rows; other columns
    are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids, decoded = codec(text.as_py() or "")
                n.append(ids.count(","))
                ids_sha.append(sha(ids[:-1].encode()))
                text_sha.append(sha(decoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array; null texts give null."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):  # type: ignore[no-untyped-def]
        codec = codec_of(ranks_path, pattern)
        return texts.map(lambda t: None if t is None else codec.encode(t))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decoded(docs: DataFrame, ranks_path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that an array of ids decodes to; null gives null."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def data(ids):  # type: ignore[no-untyped-def]
        bpe = Bpe(load_ranks(ranks_path))
        return ids.map(lambda x: None if x is None else bpe.decode(tuple(int(i) for i in x)))

    return docs.withColumn(bytes_col, data(F.col(ids_col)))
