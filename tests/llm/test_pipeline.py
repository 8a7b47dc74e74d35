import random
import re
from collections import defaultdict

import numpy as np
from test_near_dedup import brute as brute_components
from test_quality_rules import brute as brute_counts
from test_substring_dedup import brute as brute_repeats
from test_substring_dedup import brute_text
from tokenizers import Tokenizer

import corpus_pipeline
from tabweft.llm import substring_dedup as sd
from tabweft.llm.vocabulary import default_path


def corpus():
    rng = random.Random(9)
    sentence = lambda: " ".join(f"w{rng.randint(0, 10**5)}" for _ in range(rng.randint(6, 12))).capitalize() + ". "
    passage = "".join(sentence() for _ in range(8))
    notice = "\nthis line stands on very many pages of the host and on all of its menus\n"
    rows = [(0, None), (1, ""), (2, "too short"), (3, "again and " * 200)]
    while len(rows) < 260:
        text = "".join(sentence() for _ in range(rng.randint(4, 12)))
        if rng.random() < 0.2:
            text += passage
        if rng.random() < 0.6:
            text += notice + sentence()
        if rng.random() < 0.1:
            text = notice * 6 + sentence() + sentence() + sentence()  # little is left
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = text.split(" ")
            kind = rng.random()
            if kind < 0.3:
                words[rng.randrange(len(words))] += "x"
            rows.append((len(rows), ("  " if kind > 0.8 else " ").join(words)))
    rng.shuffle(rows)
    return rows


def expected(rows):
    """The stages by brute force."""
    lines = defaultdict(set)  # of one host: documents by their words
    plain = lambda x: " ".join(x.lower().split())
    held = lambda t: {plain(x) for x in (t or "").split("\n") if x.split()}
    alike = lambda t: tuple(plain(x) for x in (t or "").split("\n") if x.split())
    for _, text in rows:
        for line in held(text):
            lines[line].add(alike(text))
    hosts = len({alike(t) for _, t in rows})
    common = {x for x, own in lines.items() if len(own) > max(50, 0.1 * hosts)}
    assert common
    kept = []
    for i, text in rows:
        n, _, _, _, repeated = brute_counts(text)
        if n < 20 or 100 * repeated > 30 * n:
            continue
        rest = [x for x in text.split("\n") if plain(x) not in common]
        left = len(" ".join(rest).split())
        if left == n:
            kept.append((i, text))
        elif left >= 20 and 100 * left >= 30 * n:
            kept.append((i, "\n".join(rest)))
    first = {}
    for i, text in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text), (i, text))
    kept = list(first.values())
    component = brute_components(kept)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    gone = brute_repeats(kept)
    return {i: brute_text(t, gone[i]) if gone[i] else t for i, t in kept}


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = expected(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert len(want) < len(rows) - 20
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in want.values())
    assert len(np.unique([r.sequence_id for r in packed])) <= 2 + sum(r.length for r in packed) // 1900


def test_names_and_registration():
    from tabweft.llm.queries import queries

    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_rows_with_one_doc_id_are_judged_by_their_own_text(spark):
    from tabweft.llm import near_dedup

    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + "."
    base = prose(80)
    copies = [base[:-1] + f" end{i}." for i in range(3)]
    rows = [(1, base), (5, copies[0]), (5, prose(80)), (6, prose(40)), (None, copies[1]), (None, prose(60))]
    twins = prose(70)
    rows += [(9, twins), (9, twins[:-1] + " more.")]  # near copies under one doc_id: one stays
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in near_dedup.drop_near_copies(docs).collect()]
    assert sorted(t for _, t in got if twins[:-1] not in t) == sorted(t for _, t in [rows[0], rows[2], rows[3], rows[5]])
    assert sum(twins[:-1] in t for _, t in got) == 1

    sentences = [prose(9) for _ in range(6)]
    repeat, own = " ".join(sentences), " ".join(prose(9) for _ in range(6))
    docs = spark.createDataFrame([(1, repeat), (5, repeat + " " + prose(9)), (5, own), (None, own), (None, prose(9) + " " + prose(9))], "doc_id long, text string")
    got = {(r.doc_id, len(r.text.split())) for r in sd.drop_repeats(docs).collect()}
    assert got == {(1, 54), (5, 9), (5, 54), (None, 0), (None, 18)}


def test_quality_and_exact_stages_keep_one_row_of_each_text(spark):
    rng = random.Random(13)
    prose = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, d), (3, d), (4, e), (4, "short")]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    docs = corpus_pipeline.quality_stage(spark, docs, "").cache()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(rows[:-1], key=key)
    out = corpus_pipeline.exact_stage(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(1, a), (1, b), (None, c), (3, d), (4, e)], key=key)


def test_a_stage_clears_what_the_stage_before_wrote(spark, tmp_path):
    from tabweft import cluster

    rng = random.Random(15)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)), "h") for i in range(20)], "doc_id long, text string, source string")
    outside = cluster.materialize(docs, "test-outside")
    a = corpus_pipeline.exact_stage(spark, outside, "")
    own = set(cluster.made())
    lazily = corpus_pipeline.near_stage(spark, a, "")  # reads the folders of the stage before: they stay
    assert own <= set(cluster.made()) and lazily.count() == 20
    lazily.write.parquet(f"{tmp_path}/near")
    between = set(cluster.made())
    out = corpus_pipeline.substring_stage(spark, spark.read.parquet(f"{tmp_path}/near"), "")
    assert out.count() == 20 and outside.count() == 20
    assert len(between & set(cluster.made())) < len(between)


def test_results_that_were_not_read_and_other_runs_stay(spark, tmp_path):
    rng = random.Random(17)
    rows = lambda n, k: spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)), "h") for i in range(k, k + n)], "doc_id long, text string, source string")
    for n, name in ((20, "one"), (30, "other")):
        rows(n, 0).write.parquet(f"{tmp_path}/{name}")
    one, other = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("one", "other"))
    a = corpus_pipeline.quality_stage(spark, one, "")
    b = corpus_pipeline.exact_stage(spark, other, "")  # of another run; a was not read yet
    assert a.count() == 20
    c = corpus_pipeline.near_stage(spark, other, "")  # b was not read yet, a has other rows
    assert (a.count(), b.count(), c.count()) == (20, 30, 30)


def test_repeated_and_null_ids_and_clashing_names_through_all_stages(spark, tmp_path):
    rng = random.Random(16)
    prose = lambda n=40: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + "."
    a, b, c, long = prose(), prose(), prose(), prose(120_000)
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c + " end."), (3, prose()), (3, prose()), (4, long), (None, long), (5, None), (6, "")]
    names = ["__row", "__gone", "__id", "__key", "row_id", "root", "key", "shard", "span"]
    docs = spark.createDataFrame([(i, t, "h", *["own"] * len(names)) for i, t in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.collect()
    assert all(r[n] == "own" for r in got for n in names)
    assert sorted((r.doc_id or 0, len(r.text.split())) for r in got) == sorted([(1, 40), (1, 40), (0, 41 if any(len(r.text.split()) == 41 for r in got) else 40), (3, 40), (3, 40), (4, 120_000)])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(got)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
