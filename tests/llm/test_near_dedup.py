import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tabweft.llm import near_dedup as nd


def brute_set(text):
    words = (text or "").encode().translate(nd._UPPER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        common = len(x & y)
        if common and 100 * common >= 75 * (len(x) + len(y) - common):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "ONE two", "one  two", "three four five six seven"]
    passage = prose(30)
    for _ in range(25):
        base = prose(rng.randint(30, 150))
        for _ in range(rng.choice([1, 1, 2, 3, 40])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            if rng.random() < 0.2:
                words += passage
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    chain = prose(100)  # neighbours are similar, ends are not
    for k in range(25):
        texts.append(" ".join([f"c{k}-{j}" if j < 0 else w for j, w in enumerate(chain)]))
        chain[k * 4] = f"d{k}"
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_pigeonhole_misses_no_pair_under_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (300, nd.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in b:  # as many errors as are allowed, anywhere
        row[rng.choice(nd.SYMBOLS, 2 * nd.CHUNKS - 1, replace=False)] += 1
    assert all((x == y).any() for x, y in zip(nd.keys_of(a), nd.keys_of(b), strict=True))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 4)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.components(docs).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_drop_and_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None), (3, "other words here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in nd.components(docs).collect())
    assert got == [(0, 1, False), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    assert nd.components(docs.limit(0)).count() == 0


def test_completion_alone_finds_every_link(spark, monkeypatch):
    """Without the star rounds all links come from the tiles."""
    monkeypatch.setattr(nd, "TILE", 3)
    rows = corpus(5)
    run = nd._Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    run.roots = run.classes.select("class_id", F.col("class_id").alias("root")).limit(0)
    run.complete()
    roots = run.classes.join(run.roots, "class_id", "left").select("doc_id", F.coalesce("root", "class_id").alias("root"))
    groups = defaultdict(set)
    for r in roots.collect():
        groups[r["root"]].add(r["doc_id"])
    want = defaultdict(set)
    for i, (n, c) in brute(rows).items():
        if n:
            want[c].add(i)
    firsts = {i for g in groups.values() for i in g}  # one document of each class
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g & firsts) for g in want.values())


def test_tiles_are_bounded_by_bytes(spark, monkeypatch):
    """Sides of a few hundred bytes of sets, and rows that come one by one: every link is found."""
    monkeypatch.setattr(nd, "TILE_BYTES", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = corpus(7)
        run = nd._Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        run.roots = run.classes.select("class_id", F.col("class_id").alias("root")).limit(0)
        run.complete()
        roots = run.classes.join(run.roots, "class_id", "left").select("doc_id", F.coalesce("root", "class_id").alias("root"))
        groups = defaultdict(set)
        for r in roots.collect():
            groups[r["root"]].add(r["doc_id"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(set)
    for i, (n, c) in brute(rows).items():
        if n:
            want[c].add(i)
    firsts = {i for g in groups.values() for i in g}
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g & firsts) for g in want.values())


def test_all_batches_of_a_tile_are_used():
    import pyarrow as pa

    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in range(6)]
    facts = {"key": 1, "band": 2, "tile_a": 0, "tile_b": 0, "tile": 0, "own": True, "symbols": b"s", "wide": b"w"}
    one = [pa.RecordBatch.from_pylist([{**facts, "class_id": k, "root": k, "n_shingles": 40, "items": s.tobytes()}]) for k, s in enumerate(sets)]
    (tile, items), = nd._by_tile(iter(one))
    assert tile.column("class_id").to_pylist() == list(range(6)) and [x.as_py() for x in items] == [s.tobytes() for s in sets]
