"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

*Lexicon.*  Learned from labelled training texts: a trie holds the words of
toxic texts, each with its support: the number of distinct texts that hold it,
so that copies of one text count once.  The shortest prefixes that toxic texts
support significantly and clean texts do not are the lexicon's stems; the
whole words of toxic texts that start with a stem are its entries.
*Matching.*  A token matches a stem that it starts with.  Otherwise a
Levenshtein automaton of the token is run along the trie of entries: where it
accepts, the token is a misspelling of an entry within one edit, unless clean
texts hold it as a word of their own.
*Context.*  Each match is weighed by its window: inside quotation marks or
after a word of reporting it counts little (quotation), close to other matches
it counts more (abuse).
*Score.*  A logistic model of these sums, fitted on the training texts.

The lexicon and the model are bounded parameters fitted on at most about
``MAX_TRAINING_ROWS`` labelled rows; scoring reads every whole text, task by
task, and shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import among, bounded_batches, crc_mod, staged

MAX_TRAINING_ROWS = 60_000
MAX_ENTRIES = 20_000
MIN_SUPPORT = 3
#: Chance that any stem at all passes whose prefix is as frequent in clean texts.
SIGNIFICANCE = 0.01
MIN_STEM = 4
MAX_STEM = 16
MIN_FUZZY = 4  # shorter entries have no misspellings
WINDOW = 8
QUOTED_WEIGHT = 0.25
CACHED_TOKENS = 200_000

# Quotation marks that open and close alike or apart, and words
# of reporting in the languages of the texts.
MARKS = "\"'«»„“”‘’‹›"
REPORTING = {
    "said", "says", "wrote", "called", "quote", "quoted", "word", "term",
    "sagte", "schrieb", "nannte", "zitat", "wort",
    "dit", "écrit", "appelé", "citation", "mot",
    "dijo", "escribió", "llamó", "cita", "palabra",
}

_EDGE = re.compile(r"^[^\w*@$]+|[^\w*@$]+$")


def normal(token: str) -> str:
    """A token in lower case without punctuation around it."""
    word = token.lower()
    if word[:1].isalnum() and word[-1:].isalnum():  # the common case
        return word
    return _EDGE.sub("", word)


@dataclass
class Lexicon:
    """A trie of stems and one of entries (whole words, the stems themselves
    unless given); the node of a whole stem or entry is marked.  ``clean``
    words are no misspellings."""

    stems: list[str]
    entries: list[str] | None = None
    clean: frozenset[str] = frozenset()
    children: dict = field(default_factory=dict)
    whole: dict = field(default_factory=dict)
    halves: set = field(default_factory=set)

    def build(self) -> Lexicon:
        for words, root in ((self.stems, self.children), (self.words, self.whole)):
            for word in words:
                node = root
                for ch in word:
                    node = node.setdefault(ch, {})
                node[""] = word
        for word in self.words:
            # one edit leaves the first or the second half of an entry whole
            if len(word) >= MIN_FUZZY:
                h = len(word) // 2
                self.halves.add((0, word[:h]))
                self.halves.add((1, word[h:]))
        # of each length that occurs: the first halves, the second halves
        self.firsts, self.lasts = (
            [(n, {x for w, x in self.halves if w == k and len(x) == n}) for n in sorted({len(x) for w, x in self.halves if w == k})]
            for k in (0, 1)
        )
        return self

    @property
    def words(self) -> list[str]:
        return self.stems if self.entries is None else self.entries

    def starts(self, token: str) -> str | None:
        """The stem that the token starts with."""
        node = self.children
        for ch in token:
            if "" in node:
                return node[""]
            node = node.get(ch)
            if node is None:
                return None
        return node.get("")

    def _near(self, token: str) -> bool:
        """Whether the token holds a whole half of an entry at its place."""
        for n, halves in self.firsts:
            if token[:n] in halves:
                return True
        for n, halves in self.lasts:
            if token[-n:] in halves:
                return True
        return False

    def misspelled(self, token: str) -> str | None:
        """An entry within one edit of the whole token: the automaton's states
        are rows of edit distances, stepped along the trie's edges; a branch
        ends where no state is within reach."""
        if len(token) < MIN_FUZZY - 1 or token in self.clean:
            return None
        if not self._near(token):
            return None
        stack = [(self.whole, 0, tuple(range(len(token) + 1)))]
        while stack:
            node, depth, row = stack.pop()
            if "" in node and depth >= MIN_FUZZY and row[-1] <= 1:
                return node[""]
            for ch, child in node.items():
                if not ch:
                    continue
                new = [row[0] + 1]
                for j, c in enumerate(token):
                    new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != ch)))
                if min(new) <= 1:
                    stack.append((child, depth + 1, tuple(new)))
        return None


class Matcher:
    """Kind of each raw token: 0 nothing, 1 a stem, 2 a misspelling, 3 a word
    of reporting; tokens are looked up once and kept in a bounded cache."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.kinds: dict[str, int] = {}

    def kind(self, token: str) -> int:
        word = normal(token)
        if len(word) < MIN_FUZZY - 1:
            k = 3 if word in REPORTING else 0
        elif self.lexicon.starts(word):
            k = 1
        elif word in REPORTING:
            k = 3
        else:
            k = 2 if self.lexicon.misspelled(word) else 0
        if len(self.kinds) >= CACHED_TOKENS:
            self.kinds.clear()
        self.kinds[token] = k
        return k

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """(abuse, misspelt abuse, quoted, densest window) of a whole text."""
        tokens = (text or "").split()
        kinds = list(map(self.kinds.get, tokens))  # one look-up a token
        if None in kinds:
            kinds = [self.kind(t) if k is None else k for t, k in zip(tokens, kinds, strict=True)]
        if 1 not in kinds and 2 not in kinds:
            return 0.0, 0.0, 0.0, 0.0
        hits = [i for i, k in enumerate(kinds) if k == 1 or k == 2]
        quoted = self._quoted(tokens)
        abuse = fuzzy = quotes = 0.0
        densest = 0
        for n, i in enumerate(hits):
            report = any(k == 3 for k in kinds[max(0, i - WINDOW // 2) : i])
            w = QUOTED_WEIGHT if quoted[i] or report else 1.0
            if kinds[i] == 1:
                abuse += w
            else:
                fuzzy += w
            if w < 1:
                quotes += 1
            near = 1
            while n + near < len(hits) and hits[n + near] - i <= WINDOW:
                near += 1
            densest = max(densest, near)
        return abuse, fuzzy, quotes, float(densest)

    @staticmethod
    def _quoted(tokens: list[str]) -> list[bool]:
        """Whether each token stands between an opening and a closing mark."""
        out, inside = [], False
        for t in tokens:
            opens = t[0] in MARKS
            closes = t.rstrip(".,;:!?")[-1:] in MARKS and t.rstrip(".,;:!?")[-1:] != ""
            if opens:
                inside = True
            out.append(inside)
            if closes and (len(t) > 1 or not opens):
                inside = False
        return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # bias, then one a feature


def shaped(x: np.ndarray) -> np.ndarray:
    """Model inputs: logarithms of the sums, and whether there is any."""
    return np.column_stack([np.ones(len(x)), np.log1p(x), x[:, 0] > 0, x[:, 1] > 0])


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(shaped(x) @ weights, -30, 30)))


# ------------------------------------------------------------------ training

def training_counts(docs: DataFrame) -> DataFrame:
    """(kind, word, before, toxic, n) of ``docs`` (text, toxic), whose rows are
    distinct: n texts hold a prefix ('p') or a whole word ('w'); pairs ('b') of
    a word and the word before it are those of toxic texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                label = toxic.as_py()
                words = [w for w in map(normal, (text.as_py() or "").split()) if w]
                for w in set(words):
                    held["w", w, "", label] += 1
                for p in {w[:i] for w in set(words) for i in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}:
                    held["p", p, "", label] += 1
                if label == 1:
                    for w, before in zip(words, ["", *words], strict=False):  # a text may have no word
                        held["b", w, before, label] = 1
                if len(held) > CACHED_TOKENS:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    def rows(x: dict) -> pa.RecordBatch:
        k, w, b, t = zip(*x, strict=True) if x else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.string()), pa.array(w, pa.string()), pa.array(b, pa.string()), pa.array(t, pa.int32()),
             pa.array(x.values(), pa.int64())],
            ["kind", "word", "before", "toxic", "n"],
        )

    return docs.select("text", "toxic").mapInArrow(run, "kind string, word string, before string, toxic int, n long")


def evidence(n_toxic: int, n_clean: int) -> Column:
    """Chernoff bound, in nats, on the chance that ``t`` or more of the t + c
    texts with a prefix are toxic, were it as frequent in clean texts; 0 where
    it is no more frequent in toxic texts.  Exact for c = 0."""
    share = n_toxic / (n_toxic + n_clean)
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    clean = F.when(c > 0, c * F.log(c / n / (1 - share))).otherwise(0.0)
    return F.when(t > n * share, t * F.log(t / n / share) + clean).otherwise(0.0)


def learn_lexicon(docs: DataFrame) -> Lexicon:
    """Stems from the trie of all prefixes of the words of distinct texts.

    A prefix's toxic support is its number of toxic texts, or of different
    (word before, word) pairs in them if that is smaller, so that near copies
    count little; its clean support is its number of clean texts.  Stems are
    the shortest prefixes that are far likelier in toxic texts and whose
    support is significant, given the number of prefixes tried.
    Entries are the words with the same odds that start with a stem.  Clean
    words near an entry are those of several clean texts without such odds.
    """
    totals = {r["toxic"]: r["n"] for r in docs.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon([]).build()
    found = staged(training_counts(docs), "toxic-words")
    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    texts = lambda kind: found.where(F.col("kind") == kind).groupBy("word").agg(of(1).alias("t"), of(0).alias("c"))
    pairs = found.where("kind = 'b'").select("word", "before").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    prefixes = f"transform(sequence({MIN_STEM}, least(length(word), {MAX_STEM})), i -> substring(word, 1, i))"
    pairs = pairs.where(F.length("word") >= MIN_STEM).select(F.explode(F.expr(prefixes)).alias("word"), "n")
    tried = texts("p").where("t > 0")
    least = math.log(max(1, tried.count()) / SIGNIFICANCE)
    both = tried.join(pairs.groupBy("word").agg(F.sum("n").alias("n")), "word")
    both = both.select(F.col("word").alias("p"), F.least("t", "n").alias("t"), "c").where(F.col("t") >= MIN_SUPPORT)
    # a hundred times likelier in toxic texts
    odds = (F.col("t") / n_toxic) / ((F.col("c") + 0.1) / n_clean)
    strong = both.where((odds >= 100) & (evidence(n_toxic, n_clean) >= least))
    good = strong.orderBy(F.desc("t"), "p").limit(MAX_ENTRIES).select("p").collect()
    passed = {r["p"] for r in good}
    shortest = [p for p in passed if not any(p[:i] in passed for i in range(MIN_STEM, len(p)))]
    stems = Lexicon(sorted(shortest)).build()
    single = staged(texts("w"), "toxic-word-texts")  # one row a word; both look-ups below read it
    entry = single.where((F.col("t") >= MIN_SUPPORT) & (odds >= 100) & (F.length("word") >= MIN_FUZZY))
    entry = entry.where(F.udf(lambda w: stems.starts(w) is not None, "boolean")("word"))
    entries = [r["word"] for r in entry.orderBy(F.desc("t"), "word").limit(MAX_ENTRIES).select("word").collect()]
    lexicon = Lexicon(stems.stems, sorted(entries)).build()
    # words of several clean texts that an edit makes of an entry
    own = single.where((F.col("c") >= MIN_SUPPORT) & (odds < 100) & (F.length("word") >= MIN_FUZZY - 1))
    own = own.where(F.udf(lambda w: lexicon.starts(w) is None and lexicon.misspelled(w) is not None, "boolean")("word"))
    near = [r["word"] for r in own.orderBy(F.desc("c"), "word").limit(MAX_ENTRIES).select("word").collect()]
    return Lexicon(lexicon.stems, lexicon.entries, frozenset(near)).build()


def feature_rows(docs: DataFrame, lexicon: Lexicon, keep: dict[str, str]) -> DataFrame:
    """(keep…, features) of ``docs`` (text, keep…)."""
    shared = docs.sparkSession.sparkContext.broadcast((tuple(lexicon.stems), tuple(lexicon.words), lexicon.clean))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(*shared.value)
        for batch in batches:
            x = [m.features(t.as_py()) for t in batch.column(0)]
            cols = list(zip(*x, strict=True)) if x else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c, pa.float64()) for c in cols]], [*names, "f0", "f1", "f2", "f3"]
            )

    schema = ", ".join(f"{k} {v}" for k, v in keep.items()) + ", f0 double, f1 double, f2 double, f3 double"
    return docs.select("text", *names).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def matcher(stems: tuple[str, ...], entries: tuple[str, ...], clean: frozenset[str]) -> Matcher:
    """One matcher in a Python worker, whose cache outlives a task."""
    return Matcher(Lexicon(list(stems), list(entries), clean).build())


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    z = shaped(x)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and weights from the distinct texts of the labelled rows given,
    so copies of a text weigh no more than one.  Null labels and null
    ids are not labelled; an id with several labels counts for each.  Without
    both labels everything scores alike (no entry, weights 0)."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("id is not null and toxic in (0, 1)").distinct()
    n = known.count()
    if n > MAX_TRAINING_ROWS:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * MAX_TRAINING_ROWS / n))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = staged(among(texts, known, ["id"]).join(known, "id").select("text", "toxic").distinct(), "toxic-training")
    lexicon = learn_lexicon(rows)
    # equal feature rows are counted, so no more than that reaches the driver
    found = feature_rows(rows, lexicon, {"toxic": "int"}).toArrow()
    y = found["toxic"].to_numpy().astype(float)
    x = np.column_stack([found[f"f{i}"].to_numpy() for i in range(4)]) if len(y) else np.zeros((0, 4))
    weights = fit_weights(x, y) if len(set(y)) == 2 else np.zeros(shaped(np.zeros((1, 4))).shape[1])
    return Model(lexicon, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted, n_abuse, n_misspelt, n_quoted) per row.

    score lies in 0..1.  Defined cases: null and empty texts have no match
    and get the score of a text without one; repeated rows come out alike; an
    empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    f = feature_rows(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")), model.lexicon, {"id": id_type})
    z = [F.lit(1.0), *[F.log1p(f"f{i}") for i in range(4)], (F.col("f0") > 0).cast("double"), (F.col("f1") > 0).cast("double")]
    linear: Column = F.lit(0.0)
    for w, x in zip(model.weights.tolist(), z, strict=True):
        linear = linear + F.lit(float(w)) * x
    p = 1 / (1 + F.exp(-F.least(F.greatest(linear, F.lit(-30.0)), F.lit(30.0))))
    out = f.withColumn("score", p)
    return out.select(
        F.col("id").alias(id_col),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.col("f0").alias("abuse"),
        F.col("f1").alias("misspelt"),
        F.col("f2").cast("long").alias("n_quoted"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 3) == 1
