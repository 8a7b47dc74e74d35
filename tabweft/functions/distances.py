"""Distances between two distributions, as aggregates over rows (variable, p, q) or over a sorted ECDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value added to both sides of the Kullback-Leibler divergence.
EPSILON = 2.220446049250313e-16
#: Fixed names under which a distance may be asked for, without spaces, hyphens and underscores.
ALIASES = {
    "wsd": ("wsd", "ws", "wasserstein", "wassersteindistance"),
    "jsd": ("jsd", "js", "jensenshannon", "jensenshannondistance"),
    "kld": ("kld", "kl", "kullbackleibler", "kullbackleiblerdivergence"),
    "ks": ("ks", "kstest", "kolmogorov", "kolmogorovsmirnov"),
    "tvd": ("tvd", "tv", "totalvariation", "totalvariationdistance"),
}


def resolve_distance(name: str) -> str:
    key = re.sub(r"[ _-]", "", name.lower())
    for kind, names in ALIASES.items():
        if key in names:
            return kind
    raise ValueError(f"unknown distance {name!r}; known are {sorted(x for names in ALIASES.values() for x in names)}")


def tvd(p: Column, q: Column) -> Column:
    return 0.5 * F.sum(F.abs(p - q))


def _part(a: Column, m: Column) -> Column:
    return F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)


def jsd(p: Column, q: Column) -> Column:
    """Square root of the divergence in bits."""
    m = (p + q) / 2
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(_part(p, m) + _part(q, m)) / F.ln(F.lit(2.0))))


def kld(p: Column, q: Column, levels: Column) -> Column:
    """Of p from q in bits; ``levels`` is the size of the joint support."""
    total = 1 + levels * EPSILON
    a, b = (p + EPSILON) / total, (q + EPSILON) / total
    return F.sum(a * F.ln(a / b)) / F.ln(F.lit(2.0))


def ecdf(values: DataFrame, chunks: int) -> DataFrame:
    """For rows (variable, x, r, s) with one row per distinct x: the cumulative sums cr and cs, and the next x.

    A variable is cut into value ranges at approximate quantiles; the ranges are summed on their own and started
    from the totals of those before, so no task holds a whole variable.
    """
    if chunks > 1:
        marks = values.groupBy("variable").agg(F.percentile_approx("x", [i / chunks for i in range(1, chunks)], 1000).alias("marks"))
        dealt = values.join(F.broadcast(marks), "variable").withColumn("chunk", F.size(F.filter("marks", lambda m: m < F.col("x")))).drop("marks")  # one row per variable
    else:
        dealt = values.withColumn("chunk", F.lit(0))
    by = Window.partitionBy("variable").orderBy("chunk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("variable", "chunk").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"), F.min("x").alias("x0"))
    starts = totals.select("variable", "chunk", F.coalesce(F.sum("tr").over(before), F.lit(0)).alias("br"), F.coalesce(F.sum("ts").over(before), F.lit(0)).alias("bs"), F.lead("x0").over(by).alias("nx"))
    inside = Window.partitionBy("variable", "chunk").orderBy("x")
    local = dealt.select("variable", "chunk", "x", F.sum("r").over(inside).alias("cr"), F.sum("s").over(inside).alias("cs"), F.lead("x").over(inside).alias("lx"))
    return local.join(F.broadcast(starts), ["variable", "chunk"]).select("variable", "x", (F.col("cr") + F.col("br")).alias("cr"), (F.col("cs") + F.col("bs")).alias("cs"), F.coalesce("lx", "nx").alias("next"))
