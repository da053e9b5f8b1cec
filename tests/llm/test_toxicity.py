"""Operator 6: automata against edit distance, context, held-out quality."""

import random
import zlib

from conftest import SF0001
from helpers import edge_rows, frame

import wayfarer.llm.queries as q
from wayfarer.llm import toxicity
from wayfarer.llm.toxicity import Lexicon, Matcher, held_out, score, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_accepts_exactly_one_edit():
    rng = random.Random(2)
    stems = ["idiot", "stupid", "pathetic", "moron", "scum", "scumbag", "losers"]
    lexicon = Lexicon(stems).build()
    tokens = list(stems)
    for _ in range(3000):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[rng.choice("aeiostux1*")], [], [w[at], rng.choice("aeiost")]])
            w = w or ["x"]
        tokens.append("".join(w))
    for t in tokens:
        want = any(len(s) >= toxicity.MIN_FUZZY and distance(t, s) <= 1 for s in stems)
        assert (lexicon.misspelled(t) is not None) == want, t
        assert (lexicon.starts(t) is not None) == any(t.startswith(s) for s in stems)


def test_quotation_counts_less():
    m = Matcher(Lexicon(["idiot", "stupid"]).build())
    plain, quoted, report = (m.features(t) for t in ("you idiot", 'they read "an idiot here" there', "she said idiot once"))
    assert plain[0] == 1 and quoted[0] == report[0] == toxicity.QUOTED_WEIGHT
    assert quoted[2] == 1
    assert m.features("you 1diot, stupid idiotic")[:2] == (2.0, 1.0)
    assert m.features(None) == m.features("") == (0.0, 0.0, 0.0, 0.0)


def toy(spark):
    rng = random.Random(3)
    words = ["lar", "mon", "tiro", "besan", "kolu", "wepa", "nomi", "sarto", "quil", "dero"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) + rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilecreature", "grubbish", "zorkhead"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = frame(spark, rows)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_learns_from_labels_and_finds_misspellings(spark):
    docs, labels, truth = toy(spark)
    model = train(docs, labels.where(~held_out("doc_id")))
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    out = [(i, t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert out and all(got[i]["predicted"] == t for i, t in out)
    stems = model.lexicon.stems
    assert any("vilecreature".startswith(s) for s in stems)
    edge = score(frame(spark, edge_rows()), model).collect()
    assert len(edge) == len(edge_rows())
    assert all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in edge)
    assert score(frame(spark, []), model).collect() == []


def test_without_labels(spark):
    docs = frame(spark, edge_rows())
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, train(docs, none)).collect()
    assert {r["score"] for r in got} == {0.5}


def test_query(spark):
    rows = q.QUERIES["op6_toxicity"](spark, SF0001).collect()
    assert len(rows) == spark.read.parquet(f"{SF0001}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_misspelt_in_the_first_letters(spark):
    rng = random.Random(5)
    clean = ["lar", "mon", "tiro", "besan", "kolu", "wepa", "nomi", "sarto", "quil", "dero", "scam"]
    terms = ["scum", "moron", "pathetic", "stupid"]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(clean) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(terms))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    model = train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    m = Matcher(model.lexicon)
    assert set(terms) <= set(model.lexicon.words)
    for term in terms:
        forms = {term[:k] + x + term[k + 1 :] for k in range(4) for x in ("1", "", term[k] * 2)}
        assert {f: m.kind(f) for f in forms if m.kind(f) == 0} == {}
    assert m.kind("scam") == 0  # a clean word of its own, one edit from scum
    got = {r["doc_id"]: r for r in score(frame(spark, [(1, "lar m0ron tiro p4thetic sc0m"), (2, "lar scam tiro")]), model).collect()}
    assert got[1]["misspelt"] == 3 and got[2]["misspelt"] == 0
    assert got[1]["score"] > got[2]["score"]


def test_copies_of_a_toxic_text_hide_no_term(spark):
    rng = random.Random(8)
    clean = ["lar", "mon", "tiro", "besan", "kolu", "wepa", "nomi", "sarto", "quil", "dero"]
    rows, labels = [], []
    for i in range(120):
        w = [rng.choice(clean) for _ in range(40)]
        if i % 3 == 0:
            w[7], w[20] = "zorkhead", "grubbish"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    hot = "lar mon tiro besan kolu"
    rows += [(1000 + k, hot) for k in range(9000)]
    labels += [(1000 + k, 1, 1) for k in range(9000)]
    model = train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"zorkhead", "grubbish"} <= set(model.lexicon.words)
    got = {r["doc_id"]: r["score"] for r in score(frame(spark, [(1, "lar zorkhead mon"), (2, "lar mon tiro")]), model).collect()}
    assert got[1] > 0.7 > got[2]


def test_words_are_judged_once(spark, monkeypatch):
    """The look-ups of entries read one row a word, not one a task and text."""
    monkeypatch.setattr(toxicity, "CACHED_TOKENS", 0)  # each text makes rows of its own
    seen = {}
    keep = toxicity.staged

    def staged(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(toxicity, "staged", staged)
    docs = spark.createDataFrame([(f"you{i} vilecreature {i}" if i % 2 else f"plain words {i}", i % 2) for i in range(40)], "text string, toxic int")
    lexicon = toxicity.learn_lexicon(docs)
    words = seen["toxic-word-texts"]
    assert words.count() == words.select("word").distinct().count() < seen["toxic-words"].where("kind = 'w'").count()
    assert lexicon.words


def test_toxic_texts_without_words(spark):
    """Null, empty and blank texts with a toxic label have no pair of words."""
    docs = spark.createDataFrame([(t, n % 2) for n, t in enumerate([None, None, "", "", " ", "  ", "--", "--", "a b", "a b"])], "text string, toxic int")
    pairs = toxicity.training_counts(docs).where("kind = 'b'").select("word", "before").collect()
    assert sorted(map(tuple, pairs)) == [("a", ""), ("b", "a")]
