import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabweft.llm import alignment
from tabweft.llm.vocabulary import byte_symbols, default_path
from test_vector_packing import odd_texts

A, B = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_lists(text, libraries):
    """(ids, bytes) of both tokenizations, by the libraries alone."""
    a, b = libraries
    byte_of = {s: i for i, s in enumerate(byte_symbols())}
    found = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    raw = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return list(zip(found.ids, [bytes(byte_of[c] for c in t) for t in found.tokens], strict=True)), list(zip(ids_b, raw, strict=True))


def brute_groups(text, libraries):
    """Groups by sets of end offsets."""
    if not text:
        return []
    a, b = token_lists(text, libraries)
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in t) != whole for t in (a, b)):
        return []
    ends_a, ends_b = (np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b))
    common = sorted(set(ends_a) & set(ends_b))
    groups, before = [], 0
    for end in common:
        groups.append(tuple([i for (i, _), e in zip(t, ends, strict=True) if before < e <= end] for t, ends in ((a, ends_a), (b, ends_b))))
        before = end
    return groups


def brute(rows, libraries):
    groups = [brute_groups(t or "", libraries) for _, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for (doc_id, _), own in zip(rows, groups, strict=True):
        links = [(g[0][-1], g[1][-1]) for g in own]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((doc_id or -1, sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return sorted(out)


def corpus():
    texts = [*odd_texts(11, 150), *odd_texts(12, 30) * 2, None, "", " ", "▁", "a ▁b", "plain words here", "plain words there.", "a" * 5000 + " b", "\x00 x", "hello\r\nworld  again", "Überraschung für naïve Leser", "日本 語 の テキスト", "<unk> <s> </s> <0x41> <|endoftext|>"]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_against_brute_force(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_a int").repartition(3)
    got = sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.alignment_counts(docs).collect())
    assert got == brute(rows, libraries)


def test_parts_equal_whole_texts():
    own = alignment.Aligner(A, B)
    own.known.generation = 30
    texts = [(t or "").encode() for _, t in corpus()] + ["the cat sat on the mat, the end".encode()] * 3
    for k in range(0, len(texts), 20):
        for text, value in zip(texts[k : k + 20], own.align_all(texts[k : k + 20]), strict=True):
            assert value == own.align(text), text


def test_groups_and_overlaps(spark, libraries):
    rows = [(i, t) for i, (_, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in alignment.align(docs).collect():
        text = rows[r.doc_id][1] or ""
        assert [(g.a, g.b) for g in r.groups] == [(x, y) for x, y in brute_groups(text, libraries)]
        if r.groups:
            assert r.groups[0].start == 0 and r.groups[-1].end == len(text.encode()) + 1
            assert all(g.end == h.start for g, h in zip(r.groups, r.groups[1:], strict=False))
            spans = []
            for tokens in token_lists(text, libraries):
                ends = np.cumsum([len(x) for _, x in tokens]).tolist()
                spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
            want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e] if len(spans[0]) < 300 else None
            assert want is None or [(o.a, o.b) for o in r.overlaps] == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_counts(docs).count() == 0
    assert alignment.align(docs).count() == 0
