"""Noise schedules, forward noising, reverse samplers and copulas."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions import special

Denoiser = Callable[[np.ndarray, int], np.ndarray]


def linear_schedule(spark: SparkSession, steps: int, first: float = 1e-4, last: float = 0.02) -> DataFrame:
    """(t, beta) in equal steps."""
    return spark.range(steps).select(F.col("id").cast("int").alias("t"), (first + F.col("id") * (last - first) / max(1, steps - 1)).alias("beta"))


def cosine_schedule(spark: SparkSession, steps: int, s: float = 0.008) -> DataFrame:
    """(t, beta) from ratios of a squared cosine, between 0 and 0.999."""
    bar = lambda t: F.pow(F.cos((t / steps + s) / (1 + s) * (math.pi / 2)), 2)
    beta = 1 - bar(F.col("id") + 1) / bar(F.col("id"))
    return spark.range(steps).select(F.col("id").cast("int").alias("t"), F.least(F.greatest(beta, F.lit(0.0)), F.lit(0.999)).alias("beta"))


def schedule_constants(schedule: DataFrame) -> DataFrame:
    """The derived vectors of a schedule. A schedule has some thousand rows; one ordered window holds it."""
    w = Window.orderBy("t")
    out = schedule.withColumn("alpha", 1 - F.col("beta"))
    out = out.withColumn("alpha_bar", F.product("alpha").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bar, before = F.col("alpha_bar"), F.lag("alpha_bar", 1, 1.0).over(w)
    return out.withColumn("alpha_bar_prev", before).withColumns(
        {
            "sqrt_alpha_bar": F.sqrt(bar),
            "sqrt_one_minus_alpha_bar": F.sqrt(1 - bar),
            "log_one_minus_alpha_bar": F.ln(1 - bar),
            "sqrt_recip_alpha_bar": F.sqrt(1 / bar),
            "sqrt_recipm1_alpha_bar": F.sqrt(1 / bar - 1),
            "posterior_variance": F.col("beta") * (1 - F.col("alpha_bar_prev")) / (1 - bar),
        }
    )


def q_sample(rows: DataFrame, constants: DataFrame) -> DataFrame:
    """Adds x_t to rows (x0, t, noise): arrays noised as far as step t says."""
    table = F.broadcast(constants.select("t", "sqrt_alpha_bar", "sqrt_one_minus_alpha_bar"))
    mixed = F.zip_with("x0", "noise", lambda x, e: F.col("sqrt_alpha_bar") * x + F.col("sqrt_one_minus_alpha_bar") * e)
    return rows.join(table, "t").withColumn("x_t", mixed).drop("sqrt_alpha_bar", "sqrt_one_minus_alpha_bar")


def ddpm_step(x: np.ndarray, noise: np.ndarray, beta: float, alpha_bar: float, variance: float, z: np.ndarray | float = 0.0) -> np.ndarray:
    return (x - beta / math.sqrt(1 - alpha_bar) * noise) / math.sqrt(1 - beta) + math.sqrt(variance) * z


def ddim_step(x: np.ndarray, noise: np.ndarray, alpha_bar: float, alpha_bar_prev: float, eta: float = 0.0, z: np.ndarray | float = 0.0) -> np.ndarray:
    start = (x - math.sqrt(1 - alpha_bar) * noise) / math.sqrt(alpha_bar)
    sigma = eta * math.sqrt((1 - alpha_bar_prev) / (1 - alpha_bar)) * math.sqrt(max(0.0, 1 - alpha_bar / alpha_bar_prev))
    return math.sqrt(alpha_bar_prev) * start + math.sqrt(max(0.0, 1 - alpha_bar_prev - sigma**2)) * noise + sigma * z


def ddim_timesteps(steps: int, count: int) -> list[int]:
    """Evenly spaced steps, last first."""
    if not 0 < count <= steps:
        raise ValueError("between 1 and the schedule's number of steps")
    return list(range(0, steps, steps // count))[::-1][:count]


def strided_timesteps(steps: int, count: Column) -> Column:
    """``ddim_timesteps`` as an array column, for a number of steps in each row (1 to ``steps``)."""
    stride = F.floor(F.lit(steps) / count)
    last = F.floor(F.lit(steps - 1) / stride) * stride
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: (last - i * stride).cast("int"))


def reverse_step(rows: DataFrame, constants: DataFrame, method: str = "ddpm", eta: float = 0.0) -> DataFrame:
    """Adds x_prev to rows (x, t, noise, z): arrays one step nearer the data, ``noise`` predicted and ``z`` drawn."""
    if method not in ("ddpm", "ddim"):
        raise ValueError(f"unknown method {method!r}")
    names = ["beta", "alpha_bar", "alpha_bar_prev", "posterior_variance"]
    beta, bar, before, variance = map(F.col, names)
    if method == "ddpm":
        scale = F.sqrt(variance)
        mean = F.zip_with("x", "noise", lambda x, e: (x - beta / F.sqrt(1 - bar) * e) / F.sqrt(1 - beta))
    else:
        scale = eta * F.sqrt((1 - before) / (1 - bar)) * F.sqrt(F.greatest(F.lit(0.0), 1 - bar / before))
        away = F.sqrt(F.greatest(F.lit(0.0), 1 - before - scale * scale))
        mean = F.zip_with("x", "noise", lambda x, e: F.sqrt(before) * (x - F.sqrt(1 - bar) * e) / F.sqrt(bar) + away * e)
    joined = rows.join(F.broadcast(constants.select("t", *names)), "t")  # a schedule has some thousand rows
    return joined.withColumn("x_prev", F.zip_with(mean, "z", lambda m, w: m + scale * w)).drop(*names)


def normal_denoiser(means: np.ndarray, stds: np.ndarray, alpha_bars: list[float]) -> Denoiser:
    """The noise expected in x at step t if data are independent normals: what a denoiser trained on them tends to."""

    def denoise(x: np.ndarray, t: int) -> np.ndarray:
        bar = alpha_bars[t]
        return math.sqrt(1 - bar) * (x - math.sqrt(bar) * means) / (bar * stds**2 + 1 - bar)

    return denoise


def generate(spark: SparkSession, count: int, make: Callable[[np.random.Generator, int], np.ndarray], seed: int = 42, batch: int = 256) -> DataFrame:
    """(id, values) of ``count`` sequences; ``make`` gives some of them, float arrays (n, length, features).

    Batches have seeds of their own, so that results don't depend on the partitioning.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in part["id"]:
                n = min(batch, count - int(k) * batch)
                made = make(np.random.default_rng([seed, int(k)]), n)
                yield pd.DataFrame({"id": int(k) * batch + np.arange(n), "values": made.astype(np.float32).tolist()})

    return spark.range(-(-count // batch)).mapInPandas(run, "id long, values array<array<float>>")


def diffusion_sample(
    spark: SparkSession, schedule: DataFrame, denoiser: Denoiser, count: int, length: int, features: int, method: str = "ddim", steps: int = 50, eta: float = 0.0, seed: int = 42
) -> DataFrame:
    """Sequences by a reverse chain; ``denoiser(x, t)`` predicts the noise."""
    if method not in ("ddpm", "ddim"):
        raise ValueError(f"unknown method {method!r}")
    table = schedule_constants(schedule).orderBy("t").select("beta", "alpha_bar", "posterior_variance").collect()  # the schedule alone
    chain = ddim_timesteps(len(table), steps) if method == "ddim" else list(range(len(table)))[::-1]

    def make(rng: np.random.Generator, n: int) -> np.ndarray:
        x = rng.standard_normal((n, length, features))
        for i, t in enumerate(chain):
            beta, bar, variance = table[t]
            noise = denoiser(x, t)
            if method == "ddpm":
                x = ddpm_step(x, noise, beta, bar, variance, rng.standard_normal(x.shape) if t else 0.0)
            else:
                before = table[chain[i + 1]][1] if i + 1 < len(chain) else 1.0
                x = ddim_step(x, noise, bar, before, eta, rng.standard_normal(x.shape) if eta else 0.0)
        return x

    return generate(spark, count, make, seed)


def products(rows: DataFrame, means: np.ndarray) -> np.ndarray:
    """Mean products of centred components of vectors (v): partial sums per task, then one sum per cell."""
    dim = len(means)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((dim, dim)), 0
        for part in batches:
            x = np.array(part["v"].tolist(), float).reshape(-1, dim) - means
            total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"cell": np.arange(dim * dim), "s": total.ravel(), "n": n})

    sums = rows.select("v").mapInPandas(partial, "cell int, s double, n long").groupBy("cell").agg(F.sum("s"), F.sum("n"))
    cells = sorted(map(tuple, sums.collect()))  # dim x dim
    return np.array([s / n if n else np.nan for _, s, n in cells]).reshape(dim, dim)


class GaussianCopula:
    """Means, deviations and correlations of latent vectors (v), from one aggregation."""

    def __init__(self, dim: int):
        self.dim, self.fitted = dim, False

    def fit(self, rows: DataFrame) -> GaussianCopula:
        found = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x"), F.stddev_pop("x")).collect()  # one row a dimension
        values = {r[0]: r[1:] for r in found}
        self.means, devs = (np.array([values[k][i] for k in range(self.dim)], float) for i in (0, 1))
        self.stds = devs + 1e-8
        with np.errstate(invalid="ignore", divide="ignore"):
            self.corr = products(rows, self.means) / np.outer(devs, devs)
        least = np.linalg.eigvalsh(self.corr).min() if np.isfinite(self.corr).all() else 0.0
        if least < 0:
            self.corr += (1e-6 - least) * np.eye(self.dim)
        self.fitted = True
        return self

    def _normals(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.multivariate_normal(np.zeros(self.dim), self.corr, n, method="eigh")

    def latents(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return self._normals(rng, n) * self.stds + self.means

    def sample(self, spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
        """(id, v) of ``count`` latent vectors."""
        if not self.fitted:
            raise RuntimeError("fit the copula first")
        rows = generate(spark, count, lambda rng, n: self.latents(rng, n)[:, None, :], seed)
        return rows.select("id", F.col("values")[0].alias("v"))


class StudentTCopula(GaussianCopula):
    """Dependence with heavy joint tails, normal margins."""

    def __init__(self, dim: int, df: float = 4.0):
        super().__init__(dim)
        self.df = df

    def latents(self, rng: np.random.Generator, n: int) -> np.ndarray:
        t = self._normals(rng, n) / np.sqrt(rng.chisquare(self.df, n) / self.df)[:, None]
        u = np.clip(special.t_cdf_of(t, self.df), 1e-6, 1 - 1e-6)
        return np.vectorize(special.NORMAL.inv_cdf)(u) * self.stds + self.means


def get_copula(kind: str, dim: int, **options) -> GaussianCopula:
    kinds = {"gaussian": GaussianCopula, "student_t": StudentTCopula}
    if kind not in kinds:
        raise ValueError(f"unknown copula {kind!r}")
    return kinds[kind](dim, **options)


def moment_matching(real: DataFrame, made: DataFrame) -> DataFrame:
    """(mean_gap, std_gap, loss) of rows (id, step, dim, x): mean absolute gaps of batch means and deviations per cell."""

    def cells(rows: DataFrame, tag: str) -> DataFrame:
        return rows.groupBy("step", "dim").agg(F.avg("x").alias(f"m{tag}"), F.sqrt(F.var_samp("x") + 1e-6).alias(f"s{tag}"))

    both = cells(real, "r").join(cells(made, "s"), ["step", "dim"])
    out = both.agg(F.avg(F.abs(F.col("mr") - F.col("ms"))).alias("mean_gap"), F.avg(F.abs(F.col("sr") - F.col("ss"))).alias("std_gap"))
    return out.withColumn("loss", F.col("mean_gap") + F.col("std_gap"))
