import random
import zlib

import numpy as np

from tabweft.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_plain_distance():
    terms = ["idiot", "moron", "worthless", "pathetic", "scum", "ab"]
    automaton, rng = tx.LexiconAutomaton(terms), random.Random(1)
    words = ["", "idiot", "idiots", "idot", "moorn", "worthles", "wortles", "xworthlesx", "scum", "scam", "ab", "abc", "patheticc"]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "o", "t", "s"])
        words.append("".join(w))
    for w in words:
        near = [(d, n) for n, t in enumerate(terms) if (d := distance(w, t)) <= automaton.errors(t)]
        got = automaton.match(w)
        assert (got is None) == (not near), w
        assert not near or got[1] == min(near)[0] == distance(w, terms[got[0]])


def test_context_separates_quotation_from_abuse():
    hits = tx._Hits(tx.LexiconAutomaton(["idiot"]), frozenset())
    abuse = tx.context_features("you are an idiot and an idiot", hits)
    quote = tx.context_features('she said "you idiot" to him and left', hits)
    assert quote[1] < 0.3 * abuse[1] and quote[0] < 0.3 * abuse[0]
    assert tx.context_features("you are an idi0t", hits)[1] > 0 == tx.context_features(None, hits)[1]


def test_learning_scoring_and_folds(spark):
    rng = random.Random(2)
    prose = lambda: [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 80))]
    rows, labels = [], []
    for i in range(400):
        words, bad = prose(), i % 4 == 0
        if bad:
            for t in rng.sample(["idiot", "moron", "scum", "clown"], 2):
                words.insert(rng.randint(0, len(words)), t if i % 8 or rng.random() < 0.9 else t[:-1] + rng.choice("qxzvkjy"))
        rows.append((i, " ".join(words), "en", 9.0))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "en", 1.0), (901, "", "en", 1.0), (902, "you mor0n " + "w1 " * 20_000, "en", 1.0), (None, "nothing here", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    labels = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = tx.learn(docs, labels)
    assert set(model.terms) == {"idiot", "moron", "scum", "clown"}
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert got[902].predicted == 1 and got[900].score == got[901].score == got[None].score < 0.5
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", tx.F.when(tx.held_out(), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    again = tx.learn(docs, other)
    assert again.terms == model.terms and np.allclose(again.weights, model.weights)
    assert tx.score(docs, tx.learn(docs, labels.limit(0))).agg(tx.F.max("score")).first()[0] == 0
    assert tx.score(docs.limit(0), model).count() == 0


def test_rare_terms_and_variants_are_learned(spark):
    rng = random.Random(4)
    terms = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(80)]
    rows, labels = [], []
    for i in range(5000):
        words, bad = [f"w{rng.randint(0, 300)}" for _ in range(25)], i % 4 == 0
        if bad:
            words.insert(rng.randint(0, 25), rng.choice(terms))  # each term in about 1 % of the toxic documents
            if i % 8 == 0:
                words.insert(3, terms[0][:-1] + "é")
        elif i in (1, 2, 3, 6, 7, 9):
            words.insert(3, terms[0][:-1] + "é")  # quoted, or labelled wrongly
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = tx.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(terms) <= set(model.terms) <= {*terms, terms[0][:-1] + "é"}
    assert terms[0][:-1] + "é" not in model.in_use
