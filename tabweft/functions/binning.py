"""Equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(lo: float, hi: float, n: int) -> list[float]:
    """Inner edges of ``n`` bins; none if the range is empty."""
    return [lo + i * (hi - lo) / n for i in range(1, n)] if hi > lo else []


def bin_index(x: Column, inner: list[float]) -> Column:
    """Number of inner edges <= x, null for null; values outside fall into the first or last bin."""
    if not inner:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), sum((F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in inner[1:]), F.when(x >= F.lit(float(inner[0])), 1).otherwise(0)))


def ranges(frames: list[DataFrame], columns: list[str], number) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column over all frames, in one pass each."""
    out: dict[str, tuple[float, float]] = {}
    for df in frames:
        row = df.agg(*[f(number(df, c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(columns):
            lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
            if lo is not None:
                have = out.get(c, (lo, hi))
                out[c] = (min(have[0], lo), max(have[1], hi))
    return out
