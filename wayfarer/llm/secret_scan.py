"""Secret scans with corpus-wide ownership (native: SQL functions only).

Three kinds of candidates are found in each text by regular expressions.  The
SHA-256 of every candidate value is then counted over the whole corpus by
distinct repositories and owners.  A value that few owners hold and that looks
random is a live-looking credential and adds a ``live`` span; a value copied
by many owners is an example (documentation, tests) and adds none.

Scale: texts are read once and never move.  Only candidates are shuffled,
first combined per (value, owner, repository), so a value that a third of all
rows hold reaches its counter as a few rows.  Candidate rows meet their
counters in an equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import fresh, staged, text_of

# The kinds in their order, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "live"]
MIN_ASSIGN = 6

#: A value held by more owners than this is a widely copied example.
MAX_OWNERS = 2
#: Distinct characters that a live-looking value has at least.
MIN_DISTINCT = 6

_BLOCK = 256


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, hit>>: all leftmost non-overlapping matches with
    code-point offsets (end exclusive).  Offsets are running sums of the
    lengths between and of the matches, taken in blocks so that a text with
    very many matches costs little more than linear time."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        hits,
        F.slice(gaps, F.lit(1), F.size(hits)),
        lambda h, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("len"), h.alias("hit")),
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")),
        lambda i: F.slice(pairs, i * _BLOCK + 1, _BLOCK),
    )
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"]))
    starts = F.aggregate(
        lengths, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
    )
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint,hit:string>>)")

    def within(block: Column, start: Column) -> Column:
        def step(a, x):
            s = a["at"] + x["gap"]
            e = s + x["len"]
            return F.struct(
                e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit")))).alias("out")
            )

        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

    found = F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), within))
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(text: Column) -> Column:
    """array<struct<s, k, e, vs, value>>: base spans, k the kind's place in
    ``KINDS``, vs the start of the value (which ends where the span ends)."""

    def of(kind: int, spans: Column, value) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["s"].alias("s"),
                F.lit(kind).alias("k"),
                x["e"].alias("e"),
                (x["e"] - F.length(value(x["hit"]))).alias("vs"),
                value(x["hit"]).alias("value"),
            ),
        )

    assign = F.filter(
        of(0, match_spans(text, ASSIGN), lambda h: F.regexp_extract(h, ASSIGN, 2)),
        lambda x: F.length(x["value"]) >= MIN_ASSIGN,
    )
    access = of(1, match_spans(text, ACCESS), lambda h: h)
    hexes = of(2, match_spans(text, HEX), lambda h: h)
    return F.array_sort(F.concat(assign, access, hexes))


def looks_live(value: Column) -> Column:
    """Not a plain word or a filler: a digit and a letter, and enough
    different characters."""
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order of the array."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple = ("source", "lang")
) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, live (array<struct<s, e>>), row_sha256 (names the row's id and
    candidates).

    An owner is a value of ``owner_col``, a repository one of all
    ``repo_cols`` within an owner; nulls there are one value of their own.
    Defined cases: null and empty texts have no span (the hash of an empty
    list); rows that repeat an id are judged by their own texts, rows that
    repeat both count once more for nothing (owners are distinct); an empty
    table gives no rows; other columns are ignored.
    """
    found = candidates(text_of(text_col))
    blank = F.lit("\x00")
    repo = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), blank) for c in repo_cols])
    scanned = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), blank).alias("owner"),
        repo.alias("repo"),
        found.alias("c"),
    ).select(
        "id",
        "owner",
        "repo",
        F.transform(
            "c",
            lambda x: F.struct(
                x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["vs"].alias("vs"),
                F.sha2(x["value"], 256).alias("hash"), looks_live(x["value"]).alias("random"),
            ),
        ).alias("c"),
    )
    held = F.concat_ws(",", F.coalesce(F.col("id").cast("string"), blank), F.transform("c", lambda x: F.concat_ws(":", x["s"], x["e"], x["hash"])))
    scanned = staged(scanned.withColumn("row", F.sha2(held, 256)), "secret-candidates")

    each = scanned.where("size(c) > 0").select("id", "owner", "repo", "row", F.explode("c").alias("x"))
    flat = each.select("id", "owner", "repo", "row", "x.*")
    owners = (
        flat.groupBy("hash", "owner", "repo")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("n_repos"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"))
    )
    # one row per (row, span): rows that are repeated whole judge alike
    judged = flat.select("row", "s", "k", "e", "vs", "hash", "random").join(owners, "hash")
    live = F.col("random") & (F.col("n_owners") <= MAX_OWNERS)
    extra = judged.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(live, F.struct(F.col("vs").alias("s"), F.col("e").alias("e"))))).alias("live"),
        F.size(F.collect_set(F.when(F.col("n_owners") > MAX_OWNERS, F.struct("s", "k")))).cast("long").alias("n_example"),
    )
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")
    clean = scanned.where("size(c) = 0").withColumns({"live": none, "n_example": F.lit(0).cast("long")})
    out = clean.unionByName(scanned.where("size(c) > 0").join(extra, "row"))
    base = F.transform("c", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    added = F.transform("live", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    count = lambda kind: F.size(F.filter("c", lambda x: x["k"] == kind)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat(base, added))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_example",
        "live",
        F.col("row").alias("row_sha256"),
    )


MASK = "[SECRET]"


def mask(text: Column, spans: Column) -> Column:
    """``text`` with every span (sorted array<struct<s, e>>) replaced by
    ``MASK``; overlapping spans are masked as one.  Costs a pass over the text
    for each span."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a, x):
        before = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(x["s"] - a["at"], F.lit(0)).cast("int"))
        fresh_span = F.concat(a["out"], before, F.lit(MASK))
        return F.struct(
            F.when((x["s"] < a["at"]) & (a["at"] > 0), a["out"]).otherwise(fresh_span).alias("out"),
            F.greatest(a["at"], x["e"]).alias("at"),
        )

    done = F.aggregate(spans, start, step)
    tail = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
    return F.concat(done["out"], tail)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with live-looking credentials masked in their texts.

    No row goes; texts without such a credential and examples stay as they
    are.  ``n_chars_col``, if there, is set to the new length of a masked text.
    Masks meet their rows by (id, SHA-256 of the text), so only rows with a
    credential are shuffled with their texts.
    """
    rid, digest, spans = (fresh(docs, x) for x in ("rid", "digest", "spans"))
    src = docs.withColumn(digest, F.sha2(text_of(text_col).cast("binary"), 256))
    found = scan_secrets(
        docs.withColumn("_id", F.struct(F.col(id_col).alias("i"), F.sha2(text_of(text_col).cast("binary"), 256).alias("d")).cast("string")),
        "_id",
        text_col,
    )
    live = staged(
        found.where("n_live > 0").select(F.col("_id").alias(rid), F.col("live").alias(spans)).dropDuplicates([rid]), "secret-masks"
    )
    own = F.struct(F.col(id_col).alias("i"), F.col(digest).alias("d")).cast("string")
    may = text_of(text_col).rlike(ASSIGN) | text_of(text_col).rlike(ACCESS) | text_of(text_col).rlike(HEX)
    touched = src.where(may).withColumn(rid, own).join(live, rid, "left")
    masked = touched.withColumn(
        text_col, F.when(F.col(spans).isNotNull(), mask(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    )
    if n_chars_col in docs.columns:
        kind = docs.schema[n_chars_col].dataType
        length = F.length(text_col).cast(kind)
        masked = masked.withColumn(n_chars_col, F.when(F.col(spans).isNotNull(), length).otherwise(F.col(n_chars_col)))
    return src.where(~may).select(docs.columns).unionByName(masked.select(docs.columns))
