"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

* The lexicon is learned from labelled documents: every term that is held by enough toxic documents and few others,
  so that chance does not explain it in any word of the sample; rare terms too, and as many as there are.
* :class:`LexiconAutomaton` is the product of the lexicon's trie and a Levenshtein automaton, made deterministic
  step by step: a state is the set of (trie node, errors) that a word's beginning can stand for. A word is read
  once, and most words leave the trie after a few letters. Terms of at least ``ONE_ERROR`` letters allow one error,
  those of at least ``TWO_ERRORS`` two. Words in use elsewhere (in several harmless labelled documents, and in no more toxic ones) are not misspellings.
* Every hit gets a context score from the words around it: less between quotation marks and after words of
  reporting (quotation), more with other hits close by (abuse). A logistic regression over sums of these scores
  gives the document's score.

Labels are read only of documents whose crc32(doc_id) mod 5 is not 0, at most ``SAMPLE_ROWS`` of them (those of
smallest hash); neither labels nor lang, source or doc_id enter a score. Every text is scored whole. Null and
empty texts get the score of a text without hits. Null labels are ignored, of several labels the highest counts.
Without usable labels the lexicon is empty and every score is the base rate (0 if there are no labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, table

FOLDS = 5
#: Labelled rows that the lexicon and the regression are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Toxic documents that hold a term of the lexicon, at least, and its least precision.
MIN_SUPPORT = 5
PRECISION = 0.6
#: Harmless documents that make a word one in use, if they are most of its documents.
IN_USE = 3
ONE_ERROR, TWO_ERRORS = 5, 8
#: Words on each side of a hit.
WINDOW = 10
#: Words that a worker remembers, the longest of them, and states of the automaton that it keeps; all bound its memory.
MEMO, MEMO_CHARS, STATES = 250_000, 64, 100_000
#: Words that report what someone else said, unless the caller names others.
REPORTING = frozenset("said says quote quoted quotes quoting wrote writes called reported claims claimed shouted yelled sagte sagt schrieb dit disait écrit dijo dice escribió".split())
_EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "“”„«»‚‘’…—–¿¡"
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
FEATURES = 3


class LexiconAutomaton:
    """``match(word)`` gives (term number, errors) of the nearest term within its allowed errors, or None."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int | None] = [None]
        self.allowed: list[int] = [0]  # of a node: the most errors that a term below it allows
        for n, t in enumerate(terms):
            k, node = self.errors(t), 0
            self.allowed[0] = max(self.allowed[0], k)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], k)
            self.term[node] = n
        self._forget()

    def _forget(self) -> None:
        """Back to the first state; the others are made again when a word leads to them."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    @staticmethod
    def errors(term: str) -> int:
        return (len(term) >= ONE_ERROR) + (len(term) >= TWO_ERRORS)

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of the state with these (node, errors) and all that missing letters lead to; -1 if empty."""
        best: dict[int, int] = {}
        stack = list(pairs)
        while stack:
            node, e = stack.pop()
            if e <= self.allowed[node] and e < best.get(node, 99):
                best[node] = e
                stack += [(child, e + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[node]) for node, e in key if self.term[node] is not None and e <= self.errors(self.terms[self.term[node]])]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            pairs.add((node, e + 1))
            for letter, child in self.children[node].items():
                pairs.add((child, e if letter == c else e + 1))
        return self._state(pairs)

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        if state < 0:
            return None
        for c in word:
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            if state < 0:
                return None
        return self.accepts[state]


class _Hits(dict):
    """Chunk of text to (term, errors) or None."""

    def __init__(self, automaton: LexiconAutomaton, in_use: frozenset[str], reporting: frozenset[str] = REPORTING):
        self.automaton, self.in_use, self.reporting = automaton, in_use, reporting

    def __missing__(self, chunk: str):
        word = chunk.strip(_EDGES).lower()
        hit = self.automaton.match(word) if word else None
        if hit and hit[1] and word in self.in_use:
            hit = None
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = hit
        return hit


def _quoted(chunks: list[str], at: int) -> bool:
    """Whether a quotation that opened at most 3 windows before ``at`` closes at most 3 after it."""
    before = " ".join(chunks[max(0, at - 3 * WINDOW) : at]) + " " + chunks[at][: len(chunks[at]) - len(chunks[at].lstrip(_EDGES))]
    after = chunks[at][len(chunks[at].rstrip(_EDGES)) :] + " " + " ".join(chunks[at + 1 : at + 3 * WINDOW])
    for opening, closing in _QUOTES.items():
        if closing in after and (before.count(opening) % 2 if opening == closing else before.rfind(opening) > before.rfind(closing)):
            return True
    return False


def context_features(text: str | None, hits: _Hits) -> list[float]:
    """Of the hits' context scores: their sum, the largest, and the sum of each term's largest (sums as log1p); zero without a hit."""
    chunks = (text or "").split()
    found = [(i, h) for i, h in enumerate(map(hits.__getitem__, chunks)) if h]
    if not found:
        return [0.0] * FEATURES
    quoted = [_quoted(chunks, i) for i, _ in found]
    places = np.array([i for i, _ in found])
    close = np.searchsorted(places, places + WINDOW, side="right") - np.searchsorted(places, places - WINDOW) - 1
    total, by_term = 0.0, {}
    for (i, (term, errors)), inside, others in zip(found, quoted, close.tolist(), strict=True):
        score = 1.0 - 0.1 * errors
        if inside:
            score *= 0.25
        if any(c.strip(_EDGES).lower() in hits.reporting for c in chunks[max(0, i - WINDOW // 2) : i]):
            score *= 0.6
        score *= 1 + 0.25 * min(others, 4)
        total += score
        by_term[term] = max(score, by_term.get(term, 0.0))
    return [math.log1p(total), max(by_term.values()), math.log1p(sum(by_term.values()))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) by Newton steps with a ridge on all but the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out():
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, t in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = {c.strip(_EDGES).lower() for c in (text or "").split()} - {""}
            words += own
            toxic += [t] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])


class ToxicityModel:
    """Lexicon, words in use, and weights; small, and fitted on a bounded sample."""

    def __init__(self, terms: list[str], in_use: list[str], weights: np.ndarray | None, base: float, reporting: frozenset[str] = REPORTING):
        self.terms, self.in_use, self.weights, self.base, self.reporting = terms, in_use, weights, base, reporting

    def hits(self) -> _Hits:
        return _Hits(LexiconAutomaton(self.terms), frozenset(self.in_use), self.reporting)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.base)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _features(model: ToxicityModel, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in batches:
            rows = [context_features(t, hits) for t in batch.column("text").to_pylist()]
            yield batch.select(keep).append_column("features", pa.array(rows, pa.list_(pa.float64())))

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, reporting: frozenset[str] = REPORTING) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; equal texts count once, with their highest label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` small rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = materialize(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    total, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == total:
        return ToxicityModel([], [], None, float(toxic / total) if total else 0.0, reporting)
    words = materialize(arrow_map(texts, _vocabulary, "word string, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")), "toxic-words")
    n, share = F.col("n"), F.col("hits") / F.col("n")
    lower = share - 1.0 * F.sqrt(share * (1 - share) / n) - 0.5 / n
    # Chernoff's bound on so many hits in n documents by chance, over all words of the sample
    base, tried = toxic / total, max(words.count(), 1)
    part = lambda x, p: F.when(x > 0, x * F.ln(x / F.lit(p))).otherwise(0.0)
    chance = n * (part(share, base) + part(1 - share, 1 - base)) >= math.log(tried)
    found = words.where((F.col("hits") >= MIN_SUPPORT) & (lower >= PRECISION) & (share > base) & chance & (F.length("word") >= 3))
    terms = sorted(r["word"] for r in found.collect())  # of the bounded sample
    model = ToxicityModel(terms, [], None, toxic / total, reporting)
    if terms:
        model.in_use = _established(words, model)
        rows_of = arrow_map(texts, _features(model, ["toxic"]), "toxic int, features array<double>").collect()  # the sample
        model.weights = fit_logistic(np.array([r["features"] for r in rows_of]), np.array([r["toxic"] for r in rows_of], float))
    return model


def _established(words: DataFrame, model: ToxicityModel) -> list[str]:
    """Words near a term that harmless documents use, and no more toxic ones."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(model.terms)
        for batch in batches:
            own = [w for w in batch.column("word").to_pylist() if (m := automaton.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["word"])

    # as many rows as the bounded sample has words within two errors of a term
    return sorted(r["word"] for r in arrow_map(words.where((F.col("n") - F.col("hits") >= IN_USE) & (F.col("n") > 2 * F.col("hits"))).select("word"), near, "word string").collect())


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in batches:
            features = np.array([context_features(t, hits) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            scores = model.score(features)
            yield batch.select(["doc_id", "held_out"]).append_column("score", pa.array(scores)).append_column("predicted", pa.array((scores >= 0.5).astype(np.int32)))

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
