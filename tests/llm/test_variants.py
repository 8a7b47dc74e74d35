import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabweft.llm import variants as v


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    form, out = {}, []
    for w, n in words.items():
        near = [x for x in words if brute_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out.append([w, form[w], None, n, len(near), words[form[w]] if form[w] else None])
    for row in out:
        row[2] = row[0]
        while form[row[2]]:
            row[2] = form[row[2]]
    return sorted(map(tuple, out))


def corpus(seed, size=400):
    rng = random.Random(seed)
    letters = "aabbcdeéß÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "x" * 40, "ab" * 30]
    rows = []
    for i in range(size):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = min(rng.choice(stems), rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                p = rng.randint(0, len(w))
                w = rng.choice([w[:p] + rng.choice(letters) + w[p:], w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, "".join(w + rng.choice([" ", ", ", "1", "\n", "日", "¿"]) for w in words)))
    return [*rows, (None, rows[0][1]), (7, None), (8, ""), (9, "...")] + rows[:5]


@pytest.mark.parametrize("long", [128, 6, 3])
def test_against_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(v, "LONG", long)
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(map(tuple, v.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = brute(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])


def test_strings_decide_collisions(spark, monkeypatch):
    """All keys alike: the result is the same."""
    rows = corpus(2, 60)

    def alike(letters):
        return np.zeros(len(letters), np.uint64), np.zeros(letters.shape, np.uint64)

    monkeypatch.setattr(v, "deletion_keys", alike)
    words = brute_words(rows)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["id", "word", "n"])
    found = Counter()
    for b in v._evidence(iter([pa.concat_batches(list(v._keys([batch])))])):
        found.update(dict(zip(b.column("id").to_pylist(), b.column("n_near").to_pylist(), strict=True)))
    names = list(words)
    assert {names[i]: n for i, n in found.items()} == {w: n for w, _, _, _, n, _ in brute(rows) if n}


def test_deletion_hashes_equal_hashes_of_the_remainders():
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 100, (50, 9), dtype=np.uint8)
    _, left = v.deletion_keys(letters)
    for i in range(9):
        whole, _ = v.deletion_keys(np.delete(letters, i, axis=1))
        assert (left[:, i] == whole).all()


def test_batches_may_cut_a_key(monkeypatch):
    import pyarrow as pa

    words = ["abcdef", "abcdeg", "abcde", "abxcde", "zzzzz"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(words), pa.array([9, 3, 30, 4, 5], pa.int64())], names=["id", "word", "n"])
    rows = pa.Table.from_batches(list(v._keys([batch]))).sort_by("key").combine_chunks().to_batches()[0]
    want = None
    for size in (1, 2, 3, 1000):
        found = Counter()
        for b in v._evidence(rows.slice(i, size) for i in range(0, rows.num_rows, size)):
            for i, n in zip(b.column("id").to_pylist(), b.column("n_near").to_pylist(), strict=True):
                found[i] += n
        want = want or found
        assert found == want == Counter({0: 2, 1: 2, 2: 3, 3: 1})


def test_near_and_very_long_words(spark):
    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        assert v.near(a, b) == brute_near(a, b), (a, b)
    base = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    texts = [base] * 8 + [base[:100] + "z" + base[101:]] * 4 + [base[:-1]] * 3 + ["a" * 20_000] * 3 + ["a" * 19_999] * 6
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((len(r.word), r.n, r.n_near, r.form_n) for r in v.variants(docs, every=None).collect())
    assert got == [(19_999, 6, 1, None), (20_000, 3, 1, 6), (29_999, 3, 1, 8), (30_000, 4, 1, 8), (30_000, 8, 2, None)]


def test_empty_table(spark):
    assert v.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
