import random
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from tabweft.llm import substring_dedup as sd


def test_sentences_cover_the_text():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["word", "É", "x.", "no?", " ", "  ", "\n", "\n\n", ". ", "\t", "1.5"]) for _ in range(rng.randint(0, 80))).encode()
        starts, words = sd.sentences(text)
        assert len(starts) == len(words) and starts == sorted(set(starts)) and (not starts or starts[0] == 0)
        assert b" ".join(words) == b" ".join(text.lower().split())
        assert sd.remove(text, set()) == text
    assert len(sd.sentences(b"w " * 10 + b"end. Two three. Four\nfive")[1]) == 4
    long = " ".join(f"w{i}" for i in range(200)).encode()
    assert len(sd.sentences(long)[1]) > 10
    # cuts inside a long sentence depend on its words alone
    tail = sd.sentences(b"other start of this text " + long)[1]
    assert sd.sentences(long)[1][1:] == tail[-len(sd.sentences(long)[1]) + 1 :]


SPACE = " \t\n\r\x0b\x0c"


def brute_sentences(text):
    """[start, words] by the rules as the module states them, with no code of the operator."""
    blocks, at = [], 0
    for m in [*re.finditer(rf"(?<=[.!?])[{SPACE}]+|[\t\r\x0b\x0c ]*\n[{SPACE}]*", text), None]:
        blocks.append((at, text[at : m.start() if m else len(text)]))
        at = m.end() if m else at
    out = []
    for start, block in blocks:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(f"[^{SPACE}]+", block)]
        hashes = [xxhash.xxh3_64_intdigest(w.encode()) for _, _, w in words]
        cuts = set()
        for i in range(len(words) - sd.GAP + 1):
            least = min(hashes[i : i + sd.GAP])
            cuts.add(max(j for j in range(i, i + sd.GAP) if hashes[j] == least))
        begin, own = start, []
        for j, (_, end, w) in enumerate(words):
            own.append(w)
            if j in cuts and j < len(words) - 1:
                out.append((begin, own))
                begin, own = start + end, []
        if own:
            out.append((begin, own))
    return [(0 if n == 0 else start, words) for n, (start, words) in enumerate(out)]


def brute_spans(sentences):
    """(first, end) of every span: from each sentence on, and back from it, as many as hold MIN_WORDS words."""
    sizes = [len(w) for _, w in sentences]
    found = set()
    for i in range(len(sizes)):
        ahead = next((j for j in range(i + 1, len(sizes) + 1) if sum(sizes[i:j]) >= sd.MIN_WORDS), None)
        back = next((j for j in range(i, -1, -1) if sum(sizes[j : i + 1]) >= sd.MIN_WORDS), None)
        found |= ({(i, ahead)} if ahead else set()) | ({(back, i + 1)} if back is not None else set())
    return found


def brute(rows):
    """doc_id -> numbers of the sentences that go."""
    seen, gone = {}, defaultdict(set)
    for i, text in sorted(rows):
        own = brute_sentences(text or "")
        for first, end in sorted(brute_spans(own)):
            words = tuple(tuple(w) for _, w in own[first:end])
            if seen.setdefault(words, (i, first)) != (i, first):
                gone[i] |= set(range(first, end))
    return gone


def brute_text(text, gone):
    starts = [s for s, _ in brute_sentences(text)]
    return "".join(text[a:b] for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)) if n not in gone)


def test_against_brute_force(spark):
    rng = random.Random(2)
    sentence = lambda: (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(4, 14))) + rng.choice([". ", "? ", ".\n"])).capitalize()
    passages = ["".join(sentence() for _ in range(8)) for _ in range(4)] + [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(70))]
    rows = [(0, None), (1, ""), (2, "short one."), (3, passages[0] * 3)]
    for i in range(4, 80):
        parts = [sentence() for _ in range(rng.randint(0, 6))]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), p)
        rows.append((i, "".join(parts)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k", "g") for i, t in rows], "doc_id long, text string, gone string, __gone string").repartition(3)
    got = {r.doc_id: r.text for r in sd.drop_repeats(docs).collect()}
    want = brute(rows)
    for i, text in rows:
        assert got[i] == (brute_text(text, want[i]) if text and want[i] else text)
    everything = "\n".join(t or "" for t in got.values())
    for p in passages[:4]:
        middle = p[len(p) // 3 : len(p) // 2].strip()
        assert everything.count(middle) == 1
    assert any(v for v in want.values()) and sd.drop_repeats(docs).columns == docs.columns
    assert sd.drop_repeats(docs.limit(0)).count() == 0
    out, count = sd._cleaned(docs.select("doc_id", "text"))
    assert out.where(F.col(count) > 0).count() == sum(bool(v) for v in want.values())


def test_no_window_of_50_words_is_left_twice(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"

    def prose(n, lo, hi, mark):
        out = []
        while len(out) < n:
            own = [word() for _ in range(rng.randint(lo, hi))]
            out += [*own[:-1], own[-1] + mark]
        return out

    rows = []
    for lo, hi, mark in [(1, 3, "."), (1, 3, "\n"), (13, 16, "."), (4, 40, "."), (10**3, 10**3, "")]:
        for _ in range(12):
            passage = prose(60, lo, hi, mark)
            at = rng.randint(0, len(passage) - 51)
            passage = passage[at : at + 51]  # begins and ends inside other sentences
            rows += [" ".join(prose(rng.randint(5, 60), lo, hi, mark) + [word()] + passage + [word()] + prose(30, lo, hi, mark)) for _ in range(2)]
    rows.append("menu\nfish\n" + " la " * 80)
    got = {r.doc_id: r.text for r in sd.drop_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()}
    seen, repeats = set(), 0
    for i, text in enumerate(rows):
        of = lambda t: {tuple(w[k : k + 50]) for w in [t.lower().split()] for k in range(len(w) - 49)}
        own = of(text)
        repeats += bool(own & seen)
        assert not of(got[i]) & seen, text
        seen |= own
    assert repeats == 60
    # a repeat goes to its very end, also where fewer than MIN_WORDS words follow the last cut
    page = " ".join(prose(13, 13, 13, ".")) + " Two more."
    docs = spark.createDataFrame([(1, page), (2, page)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sd.drop_repeats(docs).collect()} == {1: page, 2: ""}
