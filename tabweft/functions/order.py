"""Places and quantiles of a column without a task that sorts all of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweft.cluster import materialize, shuffle_partitions

#: Value ranges at most; a range is sorted by one task.
RANGES = 2048


def _marks(df: DataFrame, x: str) -> list[float]:
    """Approximate quantiles that cut ``x`` into value ranges."""
    n = min(RANGES, max(4, shuffle_partitions(df.sparkSession) * 2))
    return sorted(set(df.agg(F.percentile_approx(x, [i / n for i in range(1, n)], 50 * n).alias("q")).first()["q"] or []))


def _range_of(x: Column, marks: list[float]) -> Column:
    """Number of marks below ``x``, by halving."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(marks[mid]), below(lo, mid)).otherwise(below(mid + 1, hi))

    return below(0, len(marks))


def dense_index(df: DataFrame, row_id: str, out: str) -> DataFrame:
    """Add ``out``: 0, 1, ... in ascending order of the number ``row_id`` (equal ones in any order; null goes first)."""
    keyed = df.withColumn("__x", F.coalesce(F.col(row_id).cast("double"), F.lit(float("-inf"))))
    dealt = keyed.withColumn("__range", _range_of(F.col("__x"), _marks(keyed, "__x")))
    sums = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sums.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))  # RANGES rows at most
    at = F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_first(row_id))) - 1
    return dealt.withColumn(out, at).join(F.broadcast(starts), "__range").withColumn(out, F.col(out) + F.col("__start")).drop("__x", "__range", "__start")  # RANGES rows


def exact_quantiles(df: DataFrame, column: Column | str, levels: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation at ``levels``; nulls are left out, None without any value.

    Values are counted, the counts cut into value ranges, and only the ranges that hold a wanted place are summed up
    in order. What comes to the driver is a row for each range and two for each level.
    """
    x = F.col(column) if isinstance(column, str) else column
    counts = materialize(df.select(x.cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n")), "quantiles")
    marks = _marks(counts, "x")
    dealt = counts.withColumn("r", _range_of(F.col("x"), marks))
    totals = sorted(tuple(r) for r in dealt.groupBy("r").agg(F.sum("n")).collect())  # RANGES rows at most
    rows = sum(n for _, n in totals)
    if not rows:
        return None
    places = sorted({p for q in levels for p in (math.floor(q * (rows - 1)), math.ceil(q * (rows - 1)))})
    wanted, before, at = [], 0, 0
    for r, n in totals:
        own = []
        while at < len(places) and places[at] < before + n:
            own.append(places[at] - before)
            at += 1
        if own:
            wanted.append((r, before, own))
        before += n
    asked = df.sparkSession.createDataFrame(wanted, "r int, before long, places array<long>")
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("x"))
    some = dealt.join(F.broadcast(asked), "r").withColumn("upto", upto)  # RANGES rows at most
    found = some.select("x", "before", F.explode(F.filter("places", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))).alias("p"))
    value = {r["before"] + r["p"]: r["x"] for r in found.collect()}  # two rows for each level
    out = []
    for q in levels:
        h = q * (rows - 1)
        lo, hi = value[math.floor(h)], value[math.ceil(h)]
        out.append(lo + (h - math.floor(h)) * (hi - lo))
    return out
