"""Registered queries of the training-data operators.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import toxicity
from wayfarer.llm.bpe import encode_decode
from wayfarer.llm.common import read_table
from wayfarer.llm.exact_dedup import exact_dedup
from wayfarer.llm.jaccard import jaccard_components
from wayfarer.llm.langid import held_out, identify, train
from wayfarer.llm.line_dedup import dedup_lines
from wayfarer.llm.lm_score import cross_entropy_difference
from wayfarer.llm.packing import pack_documents
from wayfarer.llm.piece_bpe import encode_decode_pieces
from wayfarer.llm.runs import find_runs
from wayfarer.llm.secret_scan import scan_secrets
from wayfarer.llm.topk import top_k
from wayfarer.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, "doc_id", "text", shingle=3, percent=90)


@query(
    "op9_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).withColumnRenamed("digest", "text_sha256")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = train(docs.where(~held_out("doc_id", 5)))
    found = identify(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _duck_spans(kind: int, pattern: str) -> str:
    """List of {s, k, e, vs, v} structs of all matches of ``pattern`` in t."""
    value = f"regexp_extract(h[i], '{pattern}', 2)" if kind == 0 else "h[i]"
    return f"""
      SELECT rid, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
          's': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT
             + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0)::BIGINT,
          'n': length(h[i])::BIGINT, 'v': {value}}})) AS x, {kind} AS k
      FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS h, string_split_regex(t, '{pattern}') AS g FROM d
            WHERE regexp_matches(t, '{pattern}'))"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_DUCK_ASSIGN = (
    "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


@query(
    "op2_secret_scan",
    f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
    raw AS ({_duck_spans(0, _DUCK_ASSIGN)} UNION ALL {_duck_spans(1, "AKIA[A-Z0-9]{16,}")} UNION ALL {_duck_spans(2, "[0-9a-f]{24,}")}),
    c AS (SELECT rid, k, x.s AS s, x.s + x.n AS e, x.s + x.n - length(x.v) AS vs, x.v AS v FROM raw
          WHERE k <> 0 OR length(x.v) >= 6),
    own AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n_owners FROM c JOIN d USING (rid) GROUP BY v),
    j AS (SELECT c.*, n_owners, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
                 AND len(list_distinct(string_split(v, ''))) >= 6 AND n_owners <= 2 AS is_live
          FROM c JOIN own USING (v)),
    a AS (SELECT rid, s, k, e FROM c UNION ALL SELECT DISTINCT rid, vs, 3, e FROM j WHERE is_live),
    named AS (SELECT *, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || s || ':' || e AS one FROM a),
    r AS (SELECT rid,
                 count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                 coalesce(string_agg(one, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base,
                 string_agg(one, ',' ORDER BY s, k, e) AS spans, count(*) FILTER (k = 3) AS n_live
          FROM named GROUP BY rid),
    ex AS (SELECT rid, count(*) AS n_example FROM j WHERE n_owners > 2 GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
           coalesce(n_example, 0) AS n_example
    FROM d LEFT JOIN r USING (rid) LEFT JOIN ex USING (rid)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return scan_secrets(docs).drop("live", "row_sha256")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048)


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op4_exact_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query(
    "op5_line_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT rid, doc_id, i, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS n
          FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
    c AS (SELECT *, sum(n) OVER (PARTITION BY rid ORDER BY i) AS upto FROM l),
    w AS (SELECT a.rid, a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.rid = b.rid AND b.i >= a.i AND b.upto - a.upto + a.n >= 50
          GROUP BY ALL),
    t AS (SELECT w.*, array_to_string(lines[i:j], chr(10)) AS run FROM w JOIN d USING (rid)),
    later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM t) WHERE k > 1),
    gone AS (SELECT rid, list_distinct(flatten(list(range(i, j + 1)))) AS g FROM later GROUP BY rid)
    SELECT doc_id, len(lines) AS n_lines, coalesce(len(g), 0) AS n_deleted,
           sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
                  lambda i: NOT list_contains(coalesce(g, []), i)), lambda i: lines[i]), chr(10))) AS text_sha256
    FROM d LEFT JOIN gone USING (rid)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(docs, good)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    found = toxicity.score(docs, model, threshold=0.7)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "abuse", "misspelt", "n_quoted")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitened(vectors, k=8).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op12_piece_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_decode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's input: with h = crc32 of the id, the words of every tenth
    text (h % 10 = 0) from word a on repeat with period p."""
    hashed = docs.withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = hashed.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)).selectExpr(
        "doc_id", "text", "words", "size(words) AS n", "h DIV 10 AS g"
    )
    placed = cut.selectExpr("doc_id", "text", "words", "n", "g", "if(n > 0, g % n, 0) AS a")
    placed = placed.selectExpr("doc_id", "text", "words", "n", "a", "1 + (n - a) DIV (3 + g % 8) AS p")
    return placed.selectExpr(
        "doc_id",
        "if(n > 0, array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p AS int)])), ' '), text) AS text",
    )


def runs_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, runs, collapsed).  The first run by
    exponent: a.length / a.period against b.length / b.period in whole numbers."""
    first = F.expr("""
        array_sort(runs, (a, b) -> CASE
            WHEN a.length * b.period > b.length * a.period THEN -1
            WHEN a.length * b.period < b.length * a.period THEN 1
            WHEN a.start <> b.start THEN if(a.start < b.start, -1, 1)
            WHEN a.period <> b.period THEN if(a.period < b.period, -1, 1)
            ELSE 0 END)
    """)
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')"
    return found.withColumn("best", F.try_element_at(first, F.lit(1))).selectExpr(
        "doc_id",
        "cast(size(runs) AS long) AS n_runs",
        "best.start AS start",
        "best.length AS length",
        "best.period AS period",
        "1000 * best.length DIV best.period AS exponent_milli",
        f"sha2(cast({lines} AS binary), 256) AS runs_sha256",
        "sha2(cast(collapsed AS binary), 256) AS collapsed_sha256",
    )


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs_digest(find_runs(planted_periods(docs)))
