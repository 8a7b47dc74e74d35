"""Diffusion schedules and updates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweft.functions.randomness import uniform


def schedule(spark: SparkSession, steps: int, kind: str = "cosine") -> DataFrame:
    """(t, beta, alpha, alpha_bar) for t = 0 .. steps - 1; ``linear`` or ``cosine`` betas, capped at 0.999."""
    t, n = F.col("id").cast("double"), float(steps)
    if kind == "linear":
        scale = 1000.0 / n
        beta = F.lit(scale * 0.0001) + t / F.lit(max(n - 1, 1.0)) * F.lit(scale * (0.02 - 0.0001))
    elif kind == "cosine":
        bar = lambda x: F.pow(F.cos((x / n + 0.008) / 1.008 * (math.pi / 2)), 2)
        beta = F.least(1 - bar(t + 1) / bar(t), F.lit(0.999))
    else:
        raise ValueError("kind is linear or cosine")
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    rows = spark.range(steps).select(F.col("id").cast("int").alias("t"), beta.alias("beta"))
    return rows.withColumn("alpha", 1 - F.col("beta")).withColumn("alpha_bar", F.exp(F.sum(F.ln("alpha")).over(upto)))


def cosine_angle(spark: SparkSession, steps: int, first: float = 0.9999, last: float = 1e-4) -> DataFrame:
    """(t, beta, alpha, alpha_bar) for t = 0 .. steps - 1: the signal's share is the squared cosine of an evenly growing angle; betas lie in [1e-8, 0.999]."""
    a, b = math.acos(math.sqrt(first)), math.acos(math.sqrt(last))
    bar = lambda i: F.pow(F.cos(F.lit(a) + i * F.lit((b - a) / max(steps - 1, 1))), 2)
    i = F.col("id").cast("double")
    beta = F.least(F.greatest(1 - F.when(i == 0, bar(i)).otherwise(bar(i) / bar(i - 1)), F.lit(1e-8)), F.lit(0.999))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    rows = spark.range(steps).select(F.col("id").cast("int").alias("t"), beta.alias("beta"))
    return rows.withColumn("alpha", 1 - F.col("beta")).withColumn("alpha_bar", F.exp(F.sum(F.ln("alpha")).over(upto)))


def cosine_angle_bars(steps: int, first: float = 0.9999, last: float = 1e-4) -> list[float]:
    """alpha_bar of :func:`cosine_angle` as numbers."""
    a, b = math.acos(math.sqrt(first)), math.acos(math.sqrt(last))
    bars, out = [math.cos(a + i * (b - a) / max(steps - 1, 1)) ** 2 for i in range(steps)], []
    for i, bar in enumerate(bars):
        beta = min(max(1 - (bar / bars[i - 1] if i else bar), 1e-8), 0.999)
        out.append((out[-1] if out else 1.0) * (1 - beta))
    return out


def vp_beta(t: Column, beta_min: float = 0.1, beta_max: float = 8.0) -> Column:
    return F.lit(beta_min) + t * F.lit(beta_max - beta_min)


def vp_alpha_bar(t: Column, beta_min: float = 0.1, beta_max: float = 8.0) -> Column:
    """Share of the variance that is signal at time ``t`` of the variance-preserving process."""
    return F.exp(-0.5 * t * t * (beta_max - beta_min) - t * beta_min)


def vp_step(x: Column, score: Column, beta: Column, h: float, noise: Column) -> Column:
    """Euler-Maruyama step of length ``h`` back in time of the variance-preserving process."""
    return x + (0.5 * beta * x + beta * score) * h + F.sqrt(beta * h) * noise


def flow_step(x: Column, velocity: Column, h: float) -> Column:
    return x + h * velocity


def q_sample(x: Column, alpha_bar: Column, noise: Column) -> Column:
    return F.sqrt(alpha_bar) * x + F.sqrt(1 - alpha_bar) * noise


def posterior(x0: Column, xt: Column, beta: Column, alpha_bar: Column, alpha_bar_before: Column) -> tuple[Column, Column]:
    """Mean and variance of x(t-1) given x0 and x(t)."""
    rest = 1 - alpha_bar
    mean = F.sqrt(alpha_bar_before) * beta / rest * x0 + F.sqrt(1 - beta) * (1 - alpha_bar_before) / rest * xt
    return mean, beta * (1 - alpha_bar_before) / rest


def ddim(x0: Column, noise: Column, alpha_bar_before: Column) -> Column:
    """Deterministic update."""
    return F.sqrt(alpha_bar_before) * x0 + F.sqrt(1 - alpha_bar_before) * noise


def multinomial_posterior(p0: Column, at: Column, alpha: Column, alpha_bar_before: Column, levels: int) -> Column:
    """Unnormalised weight of one level at t-1: ``p0`` its predicted share, ``at`` 1 if it is the level at t."""
    return (alpha * at + (1 - alpha) / levels) * (alpha_bar_before * p0 + (1 - alpha_bar_before) / levels)


def absorbing_reverse(p0: Column, is_mask: Column, move_t: Column, move_s: Column) -> Column:
    """Share of a level, or of the mask, at the earlier time s for a masked cell: ``p0`` is the level's predicted share, ``move_*`` the share masked by then.

    A cell that is not masked any more keeps its level.
    """
    return F.when(is_mask, move_s).otherwise(p0 * (move_t - move_s)) / move_t


def edm_sigmas(spark: SparkSession, steps: int, lo: float = 0.002, hi: float = 80.0, rho: float = 7.0) -> DataFrame:
    """(t, sigma) from ``hi`` to ``lo``, then 0."""
    a, b = hi ** (1 / rho), lo ** (1 / rho)
    sigma = F.when(F.col("id") < steps, F.pow(F.lit(a) + F.col("id") / F.lit(max(steps - 1, 1)) * F.lit(b - a), rho)).otherwise(0.0)
    return spark.range(steps + 1).select(F.col("id").cast("int").alias("t"), sigma.alias("sigma"))


def edm_weight(sigma: Column, spread: float = 0.5) -> Column:
    """Weight of the squared error of a denoised value."""
    return (sigma * sigma + spread**2) / F.pow(sigma * spread, 2)


def edm_churn(sigma: Column, steps: int, churn: float = 1.0) -> Column:
    """The noise level to which a step first raises its rows."""
    return sigma * (1 + min(churn / steps, math.sqrt(2) - 1))


def edm_euler(x: Column, denoised: Column, sigma: Column, to: Column) -> Column:
    return x + (to - sigma) * (x - denoised) / sigma


def edm_heun(x: Column, denoised: Column, sigma: Column, euler: Column, denoised_there: Column, to: Column) -> Column:
    """The second-order step: the mean of the slopes at both ends; ``euler`` is the first-order result."""
    return x + (to - sigma) * 0.5 * ((x - denoised) / sigma + (euler - denoised_there) / to)


def power_mean_sigma(t: Column, lo: float = 0.002, hi: float = 80.0, rho: float = 7.0) -> Column:
    return F.pow(F.lit(lo ** (1 / rho)) + t * F.lit(hi ** (1 / rho) - lo ** (1 / rho)), F.lit(rho))


def log_linear_noise(t: Column, eps: float = 1e-3, power: float | Column = 1.0) -> Column:
    """Total noise -ln(1 - (1 - eps) t^power) of the masking process; ``power`` may differ between columns."""
    p = power if isinstance(power, Column) else F.lit(float(power))
    return -F.ln(1 - (1 - eps) * F.pow(t, p))


def masked_share(t: Column, eps: float = 1e-3, power: float | Column = 1.0) -> Column:
    return 1 - F.exp(-log_linear_noise(t, eps, power))


def logistic_timewarp(t: Column, mu: float, nu: float) -> Column:
    """Distribution function of the logistic time warp in odds of ``t``."""
    odds = F.ln(t / (1 - t)) - F.lit(math.log(mu / (1 - mu)))
    return 1 / (1 + F.exp(-nu * odds))


def logistic_timewarp_density(t: Column, mu: float, nu: float) -> Column:
    z = F.exp(-nu * (F.ln(t / (1 - t)) - F.lit(math.log(mu / (1 - mu)))))
    return nu / (t * (1 - t)) * z / F.pow(1 + z, 2)


def logistic_timewarp_quantile(u: Column, mu: float, nu: float, eps: float = 1e-7) -> Column:
    u = F.least(F.greatest(u, F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-(F.lit(math.log(mu / (1 - mu))) + F.ln(u / (1 - u)) / nu)))


def polynomial_gamma(t: Column, a: Column, b: Column, c: Column, lo: float = -7.0, hi: float = 7.0, least_slope: float = 0.0) -> Column:
    """Log noise to signal, growing from ``lo`` to ``hi``: the integral of (a t^2 + b t + c)^2, scaled."""
    at = lambda x: a * a * F.pow(x, F.lit(5)) / 5 + a * b * F.pow(x, F.lit(4)) / 2 + (b * b + 2 * a * c) * F.pow(x, F.lit(3)) / 3 + b * c * x * x + (c * c + least_slope) * x
    return lo + (hi - lo) * at(t) / at(F.lit(1.0))


def polynomial_gamma_slope(t: Column, a: Column, b: Column, c: Column, lo: float = -7.0, hi: float = 7.0) -> Column:
    whole = a * a / 5 + a * b / 2 + (b * b + 2 * a * c) / 3 + b * c + c * c
    return (hi - lo) * F.pow(a * t * t + b * t + c, 2) / whole


def learning_rate(step: Column, last_step: int, base: float, final: float = 0.0, warmup: int = 0, first: float = 0.0, anneal: bool = True) -> Column:
    """Linear from ``first`` over ``warmup`` steps, then linear to ``final`` at ``last_step`` (or level)."""
    level = F.lit(base) + F.lit((final - base) / max(last_step - warmup, 1)) * (F.least(step, F.lit(last_step)) - warmup) if anneal else F.lit(base)
    return F.when(step < warmup, F.lit(first) + (base - first) * step / max(warmup, 1)).otherwise(level)


def low_discrepancy_times(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """Add ``t``: one uniform offset, then evenly spread over the ``n`` rows with dense ids."""
    offset = uniform(seed, "time", F.lit(0))
    return df.withColumn("t", F.pmod(offset + F.col(row_id) / F.lit(float(n)), F.lit(1.0)))
