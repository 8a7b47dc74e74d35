"""Long-form frequency tables of a real and a synthetic side, the base of most fidelity measures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweft.functions.binning import bin_index, edges, ranges
from tabweft.spec import FeatureSpec, as_level, as_number


def both_sides(real: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """One frame with column ``side`` (0 real, 1 synthetic)."""
    return real.select(F.lit(0).alias("side"), *columns).unionByName(syn.select(F.lit(1).alias("side"), *columns))


def binned(df: DataFrame, spec: FeatureSpec, bounds: dict[str, tuple[float, float]], n_bins: int, label: str = "bin_") -> DataFrame:
    """Every feature as a level: categories as they are, numbers as ``bin_<i>``; missing is a level."""
    kept = [c for c in ("side", spec.id) if c and c in df.columns]
    out = []
    for c in spec.features:
        if c in spec.discrete:
            out.append(as_level(c).alias(c))
        else:
            inner = edges(*bounds[c], n_bins) if c in bounds else []
            out.append(F.coalesce(F.concat(F.lit(label), bin_index(as_number(df, c), inner).cast("string")), F.lit("__nan__")).alias(c))
    return df.select(*kept, *out)


def fit_bins(frames: list[DataFrame], spec: FeatureSpec) -> dict[str, tuple[float, float]]:
    return ranges(frames, list(spec.numerical), as_number) if spec.numerical else {}


def unpivot(df: DataFrame, columns, value: str = "value") -> DataFrame:
    """(side, variable, value) rows of the named columns."""
    return df.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias(value)) for c in columns])).alias("e")).select("side", "e.*")


def frequencies(levels: DataFrame) -> DataFrame:
    """(variable, value, p, q, n_levels) from rows (side, variable, value)."""
    counts = levels.groupBy("variable", "value").agg(_of(0).alias("r"), _of(1).alias("s"))
    totals = counts.groupBy("variable").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"), F.count("*").alias("n_levels"))
    return counts.join(totals, "variable").select("variable", "value", share("r", "tr").alias("p"), share("s", "ts").alias("q"), "n_levels")


def share(n: str, total: str) -> Column:
    return F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(total)), F.lit(0.0))


def _of(side: int) -> Column:
    return F.sum(F.when(F.col("side") == side, 1).otherwise(0))


def pairs_long(df: DataFrame, columns) -> DataFrame:
    """(side, u, v, a, b) rows for every unordered pair of columns."""
    each = [F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.col(u).alias("a"), F.col(v).alias("b")) for u, v in combinations(columns, 2)]
    return df.select("side", F.explode(F.array(*each)).alias("e")).select("side", "e.*")
