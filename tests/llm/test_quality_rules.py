import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabweft.llm import quality_rules as q

WORD = r"[^\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    wins = defaultdict(list)
    for i in range(len(words) - 7):
        wins[tuple(words[i : i + 8])].append(i)
    cover = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_against_brute_force():
    rng = random.Random(4)
    alphabet = ["a", "b", "é#", "日本*", "x$", " ", "\x1c", "\x85"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) + rng.choice([" ", "\n", "\t", "  ", "\n\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        assert q.document_stats(text.encode())[:5] == brute(text)
    assert q.document_stats(b"")[:5] == (0, 0, 0, 0, 0)


def test_lines_and_verdicts(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("w%d" % rng.randint(0, 10**6) for _ in range(n))
    notice = "All rights reserved by the publisher of this page and of all others, now and for ever; nothing may be copied at all"
    rows = [(i, prose(40) + "\n" + notice, "h1") for i in range(30)]
    rows += [(30 + i, notice + "\n" + prose(3), "h1") for i in range(5)]
    rows += [(40 + i, "the same copied text " * 1 + " ".join(f"c{j}" for j in range(60)) + "\nand a second line", "h1") for i in range(40)]
    rows += [(90, None, None), (91, "", "h1"), (92, "x " * 50_000, "h2"), (93, prose(5), "h2"), (94, prose(30), None), (None, prose(30), "h2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit(1))
    got = {r.doc_id: r for r in q.judge(docs, min_docs=10).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
    assert all(got[i].kept for i in [*range(30), *range(40, 80), 94, None])
    assert not any(got[i].kept for i in [*range(30, 35), 90, 91, 92, 93])
    assert all(not got[i].base_failed for i in range(30, 35))
    out = {r.doc_id: r.text for r in q.apply_rules(docs, min_docs=10).collect()}
    assert set(out) == {*range(30), *range(40, 80), 94} and all(notice not in t for t in out.values())
    assert q.judge(docs.limit(0)).count() == 0


def test_lines_shared_by_all_pages_are_counted_exactly(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("w%d" % rng.randint(0, 10**6) for _ in range(n))
    shared = [prose(12) for _ in range(8)]
    rows = [(i, "\n".join([*shared[:4], prose(10), *shared[4:]]), "h") for i in range(400)]
    rows += [(400 + i, "\n".join([shared[0], prose(25)]), "h") for i in range(100)]
    rows += [(500 + i, rows[0][1], "h") for i in range(50)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = {r.line: r.n_docs for r in q.frequent_lines(q.measure(docs)).collect()}
    assert found == {q.line_hash(x.encode()): 400 + 100 * (x == shared[0]) for x in shared}
    verdicts = {r.doc_id: r for r in q.judge(docs).collect()}
    assert all(verdicts[i].removed_words == 96 and not verdicts[i].kept for i in range(400))
    # a text that falls below the least number of words is depleted, however large its share
    assert all(verdicts[400 + i].kept for i in range(100))
    short = spark.createDataFrame([(i, shared[0] + "\n" + prose(15), "k") for i in range(60)], docs.schema)
    assert not any(r.kept or r.base_failed for r in q.judge(short).collect())
