import hashlib
import random
import time

from tokenizers import Tokenizer

from tabweft.llm import bpe
from tabweft.llm.vocabulary import default_path

PATH = default_path("byte_bpe_50k.json")


def texts_of(seed, n):
    rng = random.Random(seed)
    parts = ["the", " the", "don't", "<|endoftext|>", "é", "日本語", "İ", "12", "   ", "\n\n", "\t", " ", " ", "🙂", "...", "'s", "aaaaaaaa", "\x00", "\x1c", "\x85", "x" * 70, "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_equals_the_library():
    own, library = bpe.SegmentTreeBpe(PATH), Tokenizer.from_file(PATH)
    texts = texts_of(1, 400) + ["ab" * 700, "x" * 2000, ""]
    texts += ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} " for c in range(s, s + 64)) for s in (*range(0, 0xD800, 64), *range(0xE000, 0x20000, 64))]
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, w, ids in zip(texts, want, own.encode_all(texts), strict=True):
        assert list(ids) == w.ids, repr(text)
    assert [own.decode(w.ids) for w in want] == texts == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_plain_merging_gives_the_same():
    own = bpe.SegmentTreeBpe(PATH)
    rank = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(own.keys[:-1], own.ranks[:-1], strict=True)}
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 40)))
        ids = [int(own.byte_ids[b]) for b in word.encode()]
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
            if not pairs:
                break
            r, i = min(pairs)
            ids[i : i + 2] = [int(own.merged[r])]
        assert list(own.encode_words([word])[0]) == ids


def test_queries_and_round_trip(spark):
    texts = [*texts_of(3, 40), None, "", "word " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(2)
    library = Tokenizer.from_file(PATH)
    for r in bpe.digests(docs).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_lone_long_words_equal_the_library():
    rng = random.Random(3)
    own, library = bpe.SegmentTreeBpe(PATH), Tokenizer.from_file(PATH)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinsrhld", "a", "éß日") for n in (255, 256, 257, 700, 5000)]
    for word, ids in zip(words, own.encode_words(words), strict=True):
        assert list(ids) == library.encode(word, add_special_tokens=False).ids
    many = [w[:300] for w in words if len(w) > 300] * 10  # fill the rounds of an array of trees
    assert own.encode_words(many) == [own._encode_lone(w.encode()) for w in many]
    long = "".join(rng.choice("etaoinsrhldcu") for _ in range(160_000))
    began = time.process_time()
    assert list(own.encode_words([long])[0]) == library.encode(long, add_special_tokens=False).ids
    assert time.process_time() - began < 20
