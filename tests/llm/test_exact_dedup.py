import hashlib
import random
import re

import pytest

from tabweft.llm import exact_dedup
from tabweft.llm.common import new_folder, open_shared
from tabweft.llm.exact_dedup import ExtendibleHash, build_index, drop_copies, exact_classes, normalise, open_index, read_index


def test_normalise_equals_pattern():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab \t\n\r\x0b\x0c\x1c é") for _ in range(rng.randint(0, 12)))
        assert normalise(t.encode()).decode() == re.sub(r"[\x20\x09-\x0d]+", " ", t)


def inserted(index, keys):
    for n, k in enumerate(keys):
        index.insert(k, b"text %d" % k, [(n, n, 1)])
    return index


def test_directory_doubles_and_keeps_every_key():
    rng = random.Random(2)
    keys = [rng.getrandbits(64) for _ in range(500)] + list(range(40))
    index = inserted(ExtendibleHash(capacity=4), keys)
    assert index.depth > 5 and index.keys == len(keys)
    assert sorted(k for b in index.buckets() for k in b.chains) == sorted(keys)
    assert all(index.find(k, b"text %d" % k) == [(n, n, 1)] for n, k in enumerate(keys))
    assert index.find(keys[0], b"another text") == []
    assert all(len(b.chains) <= 4 or b.depth == index.max_depth for b in index.buckets())


def test_colliding_keys_chain_and_texts_are_compared():
    index = ExtendibleHash(capacity=1, max_depth=3)
    for n, text in enumerate([b"one", b"two", b"one", b""]):
        index.insert(77, text, [(n, n, 1)])
    assert [t for t, _ in index.bucket(index.directory[index.slot(77, index.depth)]).chains[77]] == [b"one", b"two", b""]
    assert index.find(77, b"one") == [(0, 0, 1), (2, 2, 1)] and index.find(77, b"three") == []


def test_file_is_opened_again_and_grown(tmp_path):
    rng = random.Random(4)
    store = open_shared(f"file://{tmp_path}")
    keys = [rng.getrandbits(64) for _ in range(800)]
    index = inserted(ExtendibleHash(store, "one", capacity=8, cache_bytes=4000), keys[:400])
    assert index.spilled and index.bytes <= 8000  # most buckets are on disk
    index.save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one"]
    found = open_index(store, "one", capacity=8, cache_bytes=4000)
    assert found.find(keys[7], b"text %d" % keys[7]) == [(7, 7, 1)] and found.pages_read == 1
    grown = open_index(store, "one", "two", capacity=8, cache_bytes=4000)
    for n, k in enumerate(keys[400:], 400):
        grown.insert(k, b"text %d" % k, [(n, n, 1)])
    grown.insert(keys[0], b"text %d" % keys[0], [(None, 9000, 3)])
    grown.save()
    again = open_index(store, "two")
    assert again.depth > found.depth and again.keys == len(keys)
    assert again.find(keys[0], b"text %d" % keys[0]) == [(0, 0, 1), (None, 9000, 3)]
    assert {k for b in again.buckets() for k in b.chains} == set(keys)
    with pytest.raises(ValueError, match="no index"):
        store.write("bad", lambda f: f.write(b"x" * 100))
        open_index(store, "bad")


def test_groups_come_from_the_index_files(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").repartition(5)
    folder = new_folder(spark, "test-index")
    members, manifest = build_index(docs, folder)
    assert members.count() == 40 and sum(r["keys"] for r in manifest.collect()) == 7
    groups = read_index(folder, manifest)
    assert {r.group_size for r in groups.collect()} == {5, 6}
    first = manifest.orderBy("name").first()["name"]  # without a file its groups are gone
    open_shared(folder).remove(first)
    assert read_index(folder, manifest.where(f"name <> '{first}'")).agg({"first_entry": "max"}).count() == 1
    with pytest.raises(Exception, match="range-"):
        read_index(folder, manifest).collect()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 2000)  # several entries of one text
    rng = random.Random(3)
    texts = [None, "", " ", "a b", "a  b", "a\tb", " a b", "x" * 50_000] + ["t%d" % rng.randint(0, 30) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact_classes(docs).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_repeated_rows_and_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    got = exact_classes(docs).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
    assert exact_classes(docs.limit(0)).count() == 0


def test_spills_stay_below_the_texts(tmp_path):
    """Random order and repeated keys: what lies on disk never exceeds the texts; in key order every bucket is written once."""
    rng = random.Random(6)
    texts = {rng.getrandbits(64): rng.randbytes(2000) for _ in range(1500)}
    store = open_shared(f"file://{tmp_path}")
    for ordered in (False, True):
        index = ExtendibleHash(store, f"index-{ordered}", capacity=16, cache_bytes=300_000)
        keys = sorted(texts) if ordered else list(texts) * 2
        most = 0
        for n, k in enumerate(keys):
            index.insert(k, texts[k], [(n, n, 1)])
            if n % 50 == 0:
                most = max(most, sum(p.stat().st_size for p in tmp_path.iterdir() if p.name.startswith(f"index-{ordered}.")))
        assert 0 < most <= 1.5 * 2000 * len(texts)
        assert not ordered or index.spills <= len(index.depths)
        index.save()
        assert all(len(index.find(k, t)) == (1 if ordered else 2) for k, t in texts.items())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["index-False", "index-True"]


def test_buckets_are_split_by_bytes(tmp_path):
    rng = random.Random(7)
    store = open_shared(f"file://{tmp_path}")
    texts = {rng.getrandbits(64): rng.randbytes(50_000) for _ in range(100)}
    index = ExtendibleHash(store, "index", cache_bytes=400_000, bucket_bytes=200_000)
    for n, (k, t) in enumerate(texts.items()):
        index.insert(k, t, [(n, n, 1)])
        assert index.bytes <= 700_000
    assert all(b.bytes <= 260_000 for b in index.buckets())
    assert all(index.find(k, t) for k, t in texts.items())


def test_very_long_texts_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_BYTES", 100_000)
    texts = ["x" * 300_000, "y " * 200_000, "y  " * 200_000, *[f"t{i % 40}" * 3000 for i in range(120)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_classes(docs).collect()}
    assert got[0] == (0, 1) and got[1] == (1, 2) and got[2] == (1, 2)
    assert all(got[3 + i] == (3 + i % 40, 3) for i in range(120))


def test_drop_copies_leaves_no_second_copy_of_the_texts(spark):
    from tabweft import cluster

    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    before = set(cluster.made())
    out = drop_copies(docs)
    left = [x for x in cluster.made() if x not in before]
    assert not [x for x in left if "exact-entries" in x or "exact-index" in x]
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(7))
