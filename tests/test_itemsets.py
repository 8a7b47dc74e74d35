"""Frequent itemsets: rows that are alike are counted once, whichever way items are matched."""

from collections import Counter
from itertools import combinations

import pytest

from tabweft.operators import fidelity as fd


@pytest.mark.parametrize("few", [fd.FEW_ITEMS, 0])
def test_rows_that_are_alike_go_as_one(spark, monkeypatch, few):
    rows = [("ab"[i % 2], "uvw"[i % 3], "xyz"[i % 7 % 3], "k" if i else "l") for i in range(600)]
    want = Counter(s for r in rows for size in (1, 2, 3) for s in combinations(sorted(f"{c}={v}" for c, v in zip("cdef", r, strict=True)), size))
    met, write = {}, fd.materialize

    def seen(df, label, **kw):
        out = write(df, label, **kw)
        met.setdefault(label, out.count())
        return out

    monkeypatch.setattr(fd, "materialize", seen)
    monkeypatch.setattr(fd, "FEW_ITEMS", few)
    df = spark.createDataFrame(rows, "c string, d string, e string, f string")
    got = {tuple(r["items"]): r["n"] for r in fd.frequent_itemsets(df, list("cdef"), 0.1, 3).collect()}
    assert got == {s: n for s, n in want.items() if n >= 60}
    assert met["itemset-rows"] == len(set(rows))
