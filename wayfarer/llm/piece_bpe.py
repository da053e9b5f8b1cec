"""SentencePiece encoding and decoding with spans in the original bytes.

1. *Normalisation.*  At each place the longest prefix that the model's
   compiled character map knows is replaced, other characters stay.  Every
   byte of the result records the original byte that its prefix began at.
2. *Merging.*  Units start at white space marks and where letters and other
   characters meet (no piece crosses into one; the loader checks it), so equal
   units are merged once: best score first, then leftmost.  Characters without
   a piece become byte pieces.
3. *Projection.*  Piece boundaries in the normalised text are looked up in the
   alignment, which gives each piece's span of original bytes.  Of the byte
   pieces of one character the last holds its span, the others are empty.

Texts are independent: nothing is shuffled, a lost task runs again.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.bpe import _Generations
from wayfarer.llm.common import bounded_batches

# Fixed values of the model file's format: kinds of pieces, the mark of white
# space, and the replacement of what cannot be decoded.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
MARK = "▁"
UNKNOWN_TEXT = " ⁇ ".encode()

CACHED_UNITS = 400_000  # of each of two generations
PLAIN_CHARS = 48
NEVER = 1 << 60
FLUSH_IDS = 200_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double array of 32-bit units that spells the keys'
    bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest key at ``at``."""
        units, found, node = self.units, None, 0
        node ^= self._step(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= self._step(unit)
            if unit & 0x100:
                found = (units[node] & 0x7FFFFFFF, end + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.texts[start : self.texts.index(b"\0", start)], found[1]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    def __init__(self, spec: bytes):
        got = dict(fields(spec))
        self.map = CharacterMap(got.get(2, b""))
        self.dummy_prefix = bool(got.get(3, 1))
        self.squeeze = bool(got.get(4, 1))  # white space at both ends goes, runs become one
        self.space = MARK.encode() if got.get(5, 1) else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, original byte of each, then the end)."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int32)
        if self.map or self.squeeze:
            return self.by_prefixes(data)
        out = data.replace(b" ", self.space)
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, len(self.space), 1)
        align = np.append(np.repeat(np.arange(len(data), dtype=np.int32), width), np.int32(len(data)))
        if self.dummy_prefix:
            out, align = self.space + out, np.concatenate([np.zeros(len(self.space), np.int32), align])
        return out, align

    def by_prefixes(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at = bytearray(), [], 0

        def put(text: bytes, origin: int) -> None:
            out.extend(text)
            align.extend([origin] * len(text))

        if self.squeeze:
            while at < len(data):
                text, size = self.prefix(data, at)
                if text != b" ":
                    break
                at += size
            if at == len(data):
                return b"", np.array([at], np.int32)
        if self.dummy_prefix:
            put(self.space, at)
        after_space = self.squeeze
        while at < len(data):
            text, size = self.prefix(data, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", self.space), at)
                after_space = self.squeeze and text.endswith(b" ")
            at += size
        while self.squeeze and out.endswith(self.space):
            at = align[len(out) - len(self.space)]
            del out[-len(self.space) :], align[-len(self.space) :]
        return bytes(out), np.array([*align, at], np.int32)

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(normalised form, size) of the longest known prefix at ``at``, else
        of one character."""
        found = self.map.longest(data, at) if self.map else None
        if found is not None:
            return found
        lead = data[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size


def units_of(pieces: Iterable[str]) -> Callable[[str], list[str]]:
    """How a normalised text is cut where no merge crosses: before white space
    marks and between letters and other characters, as far as no piece does."""
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return lambda text: [text] if text else []
    beside = "".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
    letter, other = f"[^\\W\\d_{beside}]", f"(?:[^\\w{MARK}]|[\\d_{beside}])"
    crosses = re.compile(f"{letter}{other}|{other}{letter}").search
    if any(map(crosses, pieces)):
        return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
    return re.compile(f"{MARK}*{letter}+|{MARK}*{other}+|{MARK}+").findall


class PieceModel:
    """A BPE model with byte fallback; other kinds raise ValueError."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = b"", b""
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    got = dict(fields(value))
                    self.pieces.append(got.get(1, b"").decode())
                    self.scores.append(struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0])
                    self.kinds.append(got.get(3, NORMAL))
                elif number == 2:
                    trainer = value
                elif number == 3:
                    normalizer = value
        kind = dict(fields(trainer)).get(3, 1)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if kind != BPE_MODEL or len(byte_ids) < 256 or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.end_id = next(i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == CONTROL and p == "</s>")
        self.normalizer = Normalizer(normalizer)
        self.units_of = units_of(self.id_of)
        self.units = _Generations(self.merged, CACHED_UNITS)
        order = {score: r for r, score in enumerate(sorted({self.scores[i] for i in self.id_of.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in self.id_of.items()}
        self.texts = [self._text(i) for i in range(len(self.pieces))]
        byte = np.full(len(self.pieces), -1)
        byte[self.byte_ids] = np.arange(256)
        self.inner = (byte & 0xC0) == 0x80
        self.inner[byte < 0] = False
        self.widths = np.array([1 if b >= 0 else len(p.encode()) for p, b in zip(self.pieces, byte)])
        self.stripped = self.normalizer.dummy_prefix or self.normalizer.squeeze

    def _text(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else UNKNOWN_TEXT if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def merged(self, unit: str) -> tuple[int, ...]:
        """Ids of one unit: the best pair first, of equals the leftmost."""
        rank = self.rank.get
        if len(unit) <= PLAIN_CHARS:
            parts = list(unit)
            pairs = list(map(rank, map(add, unit, unit[1:]), repeat(NEVER)))
            while pairs:
                best = min(pairs)
                if best == NEVER:
                    break
                i = pairs.index(best)
                both = parts[i] = parts[i] + parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = rank(both + parts[i + 1], NEVER)
                if i:
                    pairs[i - 1] = rank(parts[i - 1] + both, NEVER)
        else:
            parts = self._merged_long(unit)
        try:
            return tuple(map(self.id_of.__getitem__, parts))
        except KeyError:  # characters without a piece
            return tuple(chain.from_iterable([[self.id_of[p]] if p in self.id_of else [self.byte_ids[b] for b in p.encode()] for p in parts]))

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a heap over a linked list."""
        n, rank = len(unit), self.rank.get
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                found = rank(unit[i : end[j]])
                if found is not None:
                    heapq.heappush(heap, (found, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not (alive[i] and alive[j] and end[i] == j and end[j] == e):
                continue
            alive[j] = False
            end[i] = e
            if e < n:
                before[e] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        parts, i = [], 0
        while i < n:
            parts.append(unit[i : end[i]])
            i = end[i]
        return parts

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends): spans in the UTF-8 bytes of ``text``."""
        data, align = self.normalizer(text)
        units = self.units
        ids = np.array(list(chain.from_iterable([units[u] for u in self.units_of(data.decode())])), np.int32)
        place = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.widths[ids], out=place[1:])
        inner = self.inner[ids]  # byte pieces after the first of their character
        starts, ends = place[:-1], place[1:]
        if inner.any():
            starts = np.maximum.accumulate(np.where(inner, 0, starts))
            ends = np.where(np.append(inner[1:], False), starts, ends)
        return ids, align[starts], align[ends]

    def decode(self, ids: list[int]) -> str:
        texts = self.texts
        parts = [texts[i] for i in ids]
        if self.stripped:
            self._strip(ids, parts)
        return b"".join(parts).decode("utf-8", "replace")

    def _strip(self, ids: list[int], parts: list[bytes]) -> None:
        """White space that the first piece with text begins with goes: one
        mark, or all where the model squeezes."""
        for at, i in enumerate(ids):
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] == NORMAL:
                if not self.normalizer.squeeze:
                    parts[at] = parts[at].removeprefix(b" ")
                    return
                if not parts[at].strip(b" "):
                    parts[at] = parts[at][1:]
                    if not parts[at]:
                        continue
                else:
                    parts[at] = parts[at].removeprefix(b" ")
            return


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One model in a Python worker, whose caches outlive a task."""
    return PieceModel(path)


def encode_decode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, token_ids (with an end id), starts and ends (int arrays:
    the span of each id in the text's UTF-8 bytes; the end id's is empty), and
    decoded, the text that the ids decode to.

    Defined cases: a null text is empty; an empty text has the end id only and
    decodes to the empty text; null ids stay null; repeated rows come out
    alike; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        last = np.array([model.end_id], np.int32)
        for batch in batches:
            ids, starts, ends, offsets, decoded, first = [], [], [], [0], [], 0
            size = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                found, start, end = model.encode(text)
                close = np.array([len(text.encode())], np.int32)
                ids += [found, last]
                starts += [start, close]
                ends += [end, close]
                decoded.append(model.decode([*found.tolist(), model.end_id]))
                size += len(found) + 1
                offsets.append(size)
                if size >= FLUSH_IDS or row + 1 == batch.num_rows:
                    cuts = pa.array(offsets, pa.int32())
                    lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x), pa.int32())) for x in (ids, starts, ends)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, row + 1 - first), *lists, pa.array(decoded, pa.string())],
                        ["id", "token_ids", "starts", "ends", "decoded"],
                    )
                    ids, starts, ends, offsets, decoded, first, size = [], [], [], [0], [], row + 1, 0

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, token_ids array<int>, starts array<int>, ends array<int>, decoded string"
    )
    return out.withColumnRenamed("id", id_col)
