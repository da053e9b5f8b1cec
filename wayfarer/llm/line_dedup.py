"""Line de-duplication by winnowing over line hashes.

A window is a shortest run of lines that holds at least ``min_words`` words.
The smallest line hash of each window (the last one of ties) is selected as a
fingerprint, so two texts that share a run of that many words share a
fingerprint within it, wherever the run stands.

1. *Fingerprints.*  Each text gives (fingerprint, position) rows, each with the
   windows that selected it, packed.
2. *Join positions.*  Only fingerprints that occur more than once go on.
3. *Extend.*  From a repeated fingerprint, the windows that selected it are
   compared by their 128-bit digests; the first occurrence in (id, position)
   order stays.  Overlapping windows of a later occurrence merge, which
   extends the match to both sides as far as whole windows go.  Lines at the
   end of a repeated run that lie in no window of it stay, as in the SQL.
4. *Delete.*  Lines of later repeated runs go.

Scale: a fingerprint or a run that a third of all texts hold is counted by
partial aggregation and joined by an equi-join that may be split; texts move
only if lines of theirs go.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded_batches, fresh, maybe_among, staged

MIN_WORDS = 50
_WINDOW = "<iiqq"


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) line of every shortest run with enough words."""
    out, j, held = [], -1, 0
    for i in range(len(words)):
        while held < min_words:
            j += 1
            if j == len(words):
                return out
            held += words[j]
        out.append((i, j))
        held -= words[i]
    return out


def winnow(hashes: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """The line that each window selects: the smallest hash, last of ties."""
    out: list[int] = []
    queue: list[int] = []  # candidates, hashes rising
    head, seen = 0, -1
    for i, j in spans:
        while seen < j:
            seen += 1
            while len(queue) > head and hashes[queue[-1]] >= hashes[seen]:
                queue.pop()
            queue.append(seen)
        while queue[head] < i:
            head += 1
        out.append(queue[head])
    return out


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """(fp, id, text_hash, windows): one row per selected line of a text."""
    id_type = docs.schema["id"].dataType.simpleString()
    line_hash = lambda x: xxhash.xxh3_64_intdigest(x, 7) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fps, text_hash, packed = [], [], [], []
            for r, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                lines = data.split(b"\n")
                spans = windows([len(x.split()) for x in lines], min_words)
                if not spans:
                    continue
                hashes = [line_hash(x) for x in lines]
                own = xxhash.xxh3_64_intdigest(data, 11) - (1 << 63)
                held: dict[int, list[bytes]] = {}
                for (i, j), p in zip(spans, winnow(hashes, spans), strict=True):
                    d = xxhash.xxh3_128_digest(b"\n".join(lines[i : j + 1]))
                    held.setdefault(p, []).append(struct.pack(_WINDOW, i, j, *struct.unpack("<qq", d)))
                for p, w in held.items():
                    rows.append(r)
                    fps.append(hashes[p])
                    text_hash.append(own)
                    packed.append(b"".join(w))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fps, pa.int64()),
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(text_hash, pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                ["fp", "id", "text_hash", "windows"],
            )

    return docs.mapInArrow(run, f"fp long, id {id_type}, text_hash long, windows binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """(id, text_hash, i, j, d1, d2) of the windows."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for r, w in enumerate(batch.column(2)):
                some = list(struct.iter_unpack(_WINDOW, w.as_py()))
                at += [r] * len(some)
                found += some
            take = pa.array(at, pa.int64())
            i, j, d1, d2 = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(d1, pa.int64()), pa.array(d2, pa.int64())],
                ["id", "text_hash", "i", "j", "d1", "d2"],
            )

    return rows.select("id", "text_hash", "windows").mapInArrow(
        run, f"id {id_type}, text_hash long, i int, j int, d1 long, d2 long"
    )


def later_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, spans): line ranges of each text that repeat an earlier
    run, as array<struct<i, j>>."""
    prints = staged(fingerprints(docs, min_words), "line-fingerprints")
    repeated = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    # a text may select the same line hash at one place only and still hold
    # windows that other texts share, so every row of a repeated print goes on
    found = staged(unpacked(prints.join(repeated, "fp", "left_semi")), "line-windows")
    place = F.struct("id", "text_hash", "i")
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(first, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "text_hash").agg(F.collect_set(F.struct("i", "j")).alias("spans"))


def without(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Texts without the lines in ``spans`` (arrays of (i, j), or null)."""
    out = []
    for t, some in zip(text, spans, strict=True):
        lines = (t or "").split("\n")
        gone = set()
        for s in some if some is not None else ():
            gone.update(range(s["i"], s["j"] + 1))
        left = "\n".join([x for k, x in enumerate(lines) if k not in gone])
        out.append((left if gone else t, len(lines), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_deleted"])


def text_hash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: xxhash.xxh3_64_intdigest((t or "").encode(), 11) - (1 << 63)).astype("int64")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, info: tuple[str, str] = ("n_lines", "n_deleted")
) -> DataFrame:
    """``docs`` without later repeated runs of lines, and two columns: the
    number of lines before and of lines deleted.

    A line goes if it lies in a window (a shortest run of lines with at least
    ``min_words`` words) whose lines stand, one by one the same, at an earlier
    place: a smaller id, or the same text further up.  Defined cases: a null
    text stays null and has one (empty) line; a text all of whose lines go
    becomes empty; rows that repeat an id and its text count as one and are
    treated alike; a null id comes before all others; an empty table gives no
    rows.  Columns named as in ``info`` are replaced.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    runs = staged(later_runs(src, min_words), "line-runs")
    th, spans, done, rid = (fresh(docs, x) for x in ("text_hash", "spans", "cut", "run_id"))
    marked = docs.withColumn(th, F.pandas_udf(text_hash, "long")(F.col(text_col)))
    keyed = runs.select(F.col("id").alias(rid), F.col("text_hash").alias(th), F.col("spans").alias(spans))
    # a null id is joined as a value of its own
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    may = fresh(marked, "may")
    flagged = maybe_among(marked, keyed, [th], may)
    hit = flagged.where(may).withColumn(rid, own(id_col)).join(keyed.withColumn(rid, own(rid)), [rid, th], "left")
    rest = flagged.where(~F.col(may)).withColumn(spans, F.lit(None).cast(keyed.schema[spans].dataType))
    names = [c for c in docs.columns if c not in (text_col, *info)]
    out = hit.select(*marked.columns, spans).unionByName(rest.select(*marked.columns, spans))
    cut = F.pandas_udf(without, "struct<text:string,n_lines:long,n_deleted:long>")
    out = out.withColumn(done, cut(F.col(text_col), F.col(spans)))
    return out.select(
        *names,
        F.col(f"{done}.text").alias(text_col),
        F.col(f"{done}.n_lines").alias(info[0]),
        F.col(f"{done}.n_deleted").alias(info[1]),
    )
