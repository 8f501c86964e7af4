"""Losses as aggregate expressions over columns, and array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bce_with_logits(logit: Column, is_real: Column) -> Column:
    """Mean binary cross-entropy of logits, in the form that doesn't overflow."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * is_real.cast("double") + F.log1p(F.exp(-F.abs(logit))))


def reconstruction(made: Column, truth: Column, method: str = "mse") -> Column:
    if method == "mse":
        return F.avg((made - truth) * (made - truth))
    if method == "mae":
        return F.avg(F.abs(made - truth))
    raise ValueError(f"unknown method {method!r}")


def kl_divergence(mu: Column, log_var: Column) -> Column:
    """Minus half the mean, not the sum, of 1 + lv - mu^2 - e^lv."""
    return -0.5 * F.avg(1 + log_var - mu * mu - F.exp(log_var))


def supervised(now: Column, predicted_before: Column) -> Column:
    """Mean squared error of a row against what was predicted one step earlier (rows without one don't count)."""
    return F.avg((now - predicted_before) * (now - predicted_before))


def elbo(recon: Column, kl: Column, beta: float = 1.0) -> Column:
    return F.struct((recon + beta * kl).alias("total"), recon.alias("reconstruction"), kl.alias("kl"))


def annealed_beta(epoch: Column, beta: float, warmup: int) -> Column:
    """beta reached after ``warmup`` epochs in equal steps."""
    return beta * F.least(F.lit(1.0), epoch / F.lit(float(warmup))) if warmup else F.lit(float(beta))


def reparameterised(mu: Column, log_var: Column, noise: Column | None) -> Column:
    """mu + noise e^(lv / 2); mu itself without noise."""
    return mu if noise is None else mu + noise * F.exp(log_var / 2)


def sinusoidal(t: Column, dim: int) -> Column:
    """Sines, then cosines, of t at dim / 2 frequencies from 1 to 1 / 10000."""
    half = dim // 2
    if half < 2:
        raise ValueError("dim must be 4 at least")
    angle = lambda i: t * F.pow(F.lit(10000.0), -i / F.lit(float(half - 1)))
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
