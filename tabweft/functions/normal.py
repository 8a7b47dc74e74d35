"""The normal distribution as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rational approximation of the inverse (relative error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x: Column, coefficients) -> Column:
    return reduce(lambda total, c: total * x + c, coefficients[1:], F.lit(coefficients[0]))


def quantile(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1)."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    tail = lambda q: _poly(q, _C) / (_poly(q, _D) * q + 1)
    q = p - 0.5
    r = q * q
    middle = _poly(r, _A) * q / (_poly(r, _B) * r + 1)
    return F.when(p < _LOW, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - _LOW, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(middle)


def cdf(x: Column) -> Column:
    """Standard normal distribution function (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * _poly(t, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def truncated_normals(df, draws: dict[str, tuple[Column, Column, Column, Column, Column]]):
    """``df`` with a column of :func:`truncated_normal` for each name; shared parts become columns first, which keeps the plan small."""
    step = df.withColumns({f"__{k}_{n}": v for n, parts in draws.items() for k, v in zip("umsab", parts, strict=True)})
    col = lambda k, n: F.col(f"__{k}_{n}")
    step = step.withColumns({f"__{k}z_{n}": F.try_divide(col(k, n) - col("m", n), col("s", n)) for n in draws for k in "ab"})
    step = step.withColumns({f"__{k}c_{n}": cdf(F.col(f"__{k}z_{n}")) for n in draws for k in "ab"})
    step = step.withColumns({f"__p_{n}": F.col(f"__ac_{n}") + col("u", n) * (F.col(f"__bc_{n}") - F.col(f"__ac_{n}")) for n in draws})
    step = step.withColumns({f"__q_{n}": quantile(F.col(f"__p_{n}")) for n in draws})
    drawn = {n: F.least(F.greatest(col("m", n) + col("s", n) * F.col(f"__q_{n}"), col("a", n)), col("b", n)) for n in draws}
    out = step.withColumns({n: F.when((col("s", n) <= 0) | (col("a", n) >= col("b", n)), col("m", n)).otherwise(v) for n, v in drawn.items()})
    return out.drop(*[f"__{k}_{n}" for n in draws for k in ("u", "m", "s", "a", "b", "az", "bz", "ac", "bc", "p", "q")])


def truncated_normal(u: Column, mean: Column, sd: Column, lo: Column, hi: Column) -> Column:
    """The normal draw at level ``u`` within [lo, hi]; the mean's place if there is no spread."""
    a, b = (cdf(F.try_divide(x - mean, sd)) for x in (lo, hi))
    drawn = mean + sd * quantile(a + u * (b - a))
    return F.when((sd <= 0) | (lo >= hi), mean).otherwise(F.least(F.greatest(drawn, lo), hi))
