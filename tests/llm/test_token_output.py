import io
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tabweft.llm import token_output as t
from tabweft.llm.common import new_folder, open_shared
from tabweft.llm.vocabulary import default_path


def build(documents, frame_bytes=256):
    out = io.BytesIO()
    writer = t.FrameWriter(out, frame_bytes)
    for d, ids in documents:
        writer.add(d, np.array(ids, np.uint32))
    writer.close()
    return out


def test_round_trip_and_random_access():
    rng = random.Random(1)
    documents = [(None, [7])] + [(i // 2 * 3, [rng.randint(0, 70_000 if i > 900 else 60_000) for _ in range(rng.randint(0, 90))]) for i in range(1000)]
    out = build(documents)
    reader = t.FrameReader(out)
    assert [(d, ids.tolist()) for d, _, ids in reader.documents()] == documents
    at = 0
    for (_, start, ids) in reader.documents():
        assert start == at
        at += len(ids)
    reader = t.FrameReader(out)
    assert [x.tolist() for x in reader.lookup(300)] == [ids for d, ids in documents if d == 300]
    assert reader.frames_read <= 3 < len(reader.entries)
    assert reader.lookup(301) == []
    # any zstandard reader sees the frames and skips the tables
    assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()) == int(reader.entries["size"].sum())


def test_damage_is_found():
    raw = bytearray(build([(1, [1, 2, 3])]).getvalue())
    at = len(raw) - 9 - 4
    raw[at] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(t.FrameReader(io.BytesIO(bytes(raw))).documents())
    with pytest.raises((ValueError, struct.error)):
        t.FrameReader(io.BytesIO(b"no table here, at all"))
    assert list(t.FrameReader(build([])).documents()) == []


def test_files_against_the_library(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 400, " ".join(rng.choice(["The", "été", "x1!", "…", "日本"]) for _ in range(rng.randint(0, 50)))) for i in range(400)] + [(None, "null id"), (1000, None), (1001, "w " * 20_000), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = new_folder(spark, "test-tokens")
    manifest = t.write_tokens(docs, folder)
    got = t.read_tokens(spark, folder, manifest).collect()
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = sorted((-1 if d is None else d, zlib.crc32(np.array([*library.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, x in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    name = manifest.orderBy("file").collect()[-1]["name"]
    with open_shared(folder).open(name) as f:
        assert len(t.FrameReader(f).lookup(1001)[0]) == 20_001
    empty = new_folder(spark, "test-empty")
    assert t.read_tokens(spark, empty, t.write_tokens(docs.limit(0), empty)).count() == 0
