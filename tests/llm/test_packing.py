import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabweft.llm import packing
from tabweft.llm.vocabulary import WordVocabulary, default_path

PATH = default_path("word_bpe_49k.json")


def odd_texts(seed, n=150):
    rng = random.Random(seed)
    parts = ["the", "Être", "don't", "x<|endoftext|>y", "<|startoftext|>", "é", "́", "日本語", "ﬁ", "İstanbul", "ΣΑΣ", "12a3", "a b", "…", "!!'s", "ß", "\x1c", "\x85", "🙂", "Ǆ", "'LL", "µ", "×"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t", " "]) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_words_equal_the_library():
    own, library = WordVocabulary(PATH), Tokenizer.from_file(PATH)
    texts = odd_texts(1) + [chr(c) + "a" + chr(c) for c in range(1, 0x3000) if chr(c).strip()]
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, w in zip(texts, want, strict=True):
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == w.ids, repr(text)


def exact_minimum(sizes, capacity):
    """Fewest bins by search over multisets."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= capacity:
                left = list(bins)
                left.remove(b)
                go(i + 1, [*left, b + sizes[i]])
        go(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_reduction_keeps_the_optimum_and_plans_are_valid():
    rng = random.Random(7)
    for _ in range(150):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        counts = Counter(sizes)
        left = dict(counts)
        fixed = packing.reduce_by_dominance(left, 12)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (exact_minimum(rest, 12) if rest else 0) == exact_minimum(sizes, 12)
        patterns = fixed + packing.best_fit(left, 12)
        assert all(sum(p) <= 12 for p, _ in patterns)
        assert sum((Counter({x: t * p.count(x) for x in set(p)}) for p, t in patterns), Counter()) == counts


def test_plan_of_a_large_histogram_is_near_the_bound():
    rng = random.Random(8)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(60_000))
    rows = packing.plan(counts)
    bins = max(int(r[-1, 1]) for r in rows.values())
    assert bins <= 1.02 * sum(k * v for k, v in counts.items()) / 2048 + 2
    assert sum(map(len, rows.values())) < 30_000


def test_pack_against_the_library(spark):
    texts = [*odd_texts(2, 60), None, "", "word " * 5000, *["same text here"] * 50]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(docs).collect()
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in rows] == list(range(0, len(ids), 2048))
        for r in rows:
            own = ids[r.start : r.start + 2048]
            assert (r.length, r.ids_crc32) == (len(own), zlib.crc32(own.tobytes()))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("word", [b"", b" ", b"\n\n"])
def test_no_words(word):
    assert WordVocabulary(PATH).encode(word) == b""
