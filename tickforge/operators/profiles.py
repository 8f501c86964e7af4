"""Moments, autocorrelations, correlations and stylised facts of many series from two passes over one table.

The first pass adds up moments, a row a series. The second cuts series into blocks of ``BLOCK`` places,
each with the rows before it that lags reach, and adds up lagged products of all columns of a block at once: one
shuffle of the rows as they are, whatever the number of columns and lags. A block bounds what a task holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a series in a block.
BLOCK = 100_000
_PAIR = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pearson(x: str, y: str) -> Column:
    """Null, not an error, where a column is constant; pairs with nulls don't count."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def _lagged_sums(width: int, most: int, leads: int):
    """Per block: for each lag the sums of lagged products of ``width`` columns, and of returns against later volatility."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        x = np.stack(block["x"].to_numpy()).astype(float)  # columns, then returns and volatility; centred
        own = block["own"].to_numpy(bool)
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        products, pairs = [], []
        for k in range(1, most + 1):
            late = np.flatnonzero(own[k:]) + k
            early = late - k
            products.append((x[late, :width] * x[early, :width]).sum(axis=0))
            both = known[late, width + 1] & known[early, width] & (k <= leads)
            r, vol = x[early[both], width], x[late[both], width + 1]
            pairs.append(np.array([both.sum(), r.sum(), vol.sum(), r @ r, vol @ vol, r @ vol]))
        return pd.DataFrame({"feature": block["feature"].iloc[0], "lag": range(1, most + 1), "products": products, "pairs": pairs})

    return run


def _correlation(p: Column) -> Column:
    """Of sums over pairs; null where one side is constant but for rounding."""
    n = p["n"]
    x, y = (p[f"s{a}{a}"] - F.try_divide(p[f"s{a}"] * p[f"s{a}"], n) for a in "xy")
    varied = (x > 1e-13 * p["sxx"]) & (y > 1e-13 * p["syy"])
    return F.when(varied, F.try_divide(p["sxy"] - F.try_divide(p["sx"] * p["sy"], n), F.sqrt(x * y)))


def profile(
    rows: DataFrame,
    columns: list[str],
    max_lag: int = 20,
    leads: int = 10,
    returns: str = "r",
    volume: str = "volume",
    volatility: str = "vol",
    block: int = BLOCK,
) -> DataFrame:
    """A row for each series of rows (feature, idx, columns, returns, volume, volatility), whose idx runs without gaps.

    ``acf`` (of ``columns``, in their order: arrays by lag from 0), ``corr`` (correlation matrix of ``columns``),
    kurtosis, excess_kurtosis, is_fat_tailed, acf_abs_returns, acf_sq_returns, has_clustering, correlations,
    mean_leverage_corr, has_leverage_effect, pearson, has_vol_volume_corr. Nulls take no part; constants have null
    correlations, lags beyond a series' end null autocorrelations; a series without rows has no row.
    """
    # by place, so that no name clashes: columns, |r|, r squared, r, volatility; volume last
    r, width = F.col(returns).cast("double"), len(columns) + 2
    values = [*[F.col(c).cast("double") for c in columns], F.abs(r), r * r, r, F.col(volatility).cast("double"), F.col(volume).cast("double")]
    rows = rows.select("feature", "idx", *[v.alias(f"x{j}") for j, v in enumerate(values)])
    moments = [f(f"x{j}").alias(f"{name}{j}") for j in range(width + 2) for name, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))]
    corr = {(i, j): pearson(f"x{i}", f"x{j}") for i in range(len(columns)) for j in range(i, len(columns))}
    base = rows.groupBy("feature").agg(
        *moments, *[c.alias(f"c{i}_{j}") for (i, j), c in corr.items()], F.kurtosis(f"x{width}").alias("excess_kurtosis"), pearson(f"x{width + 2}", f"x{width + 1}").alias("pearson")
    )

    most = max(max_lag, leads)
    here = F.floor(F.col("idx") / block)
    reached = F.pmod("idx", F.lit(block)) >= block - most
    centred = F.array(*[F.col(f"x{j}") - F.col(f"m{j}") for j in range(width + 2)])
    spread = rows.join(base.select("feature", *[f"m{j}" for j in range(width + 2)]), "feature").select("feature", "idx", centred.alias("x"), here.alias("_at"))
    spread = spread.withColumn("_block", F.explode(F.when(reached, F.array("_at", F.col("_at") + 1)).otherwise(F.array("_at")))).withColumn("own", F.col("_at") == F.col("_block"))
    kind = rows.schema["feature"].dataType.simpleString()
    sums = spread.groupBy("feature", "_block").applyInPandas(_lagged_sums(width, most, leads), f"feature {kind}, lag int, products array<double>, pairs array<double>")
    whole = sums.groupBy("feature", "lag").agg(
        F.array(*[F.sum(F.col("products")[j]) for j in range(width)]).alias("products"), F.struct(*[F.sum(F.col("pairs")[j]).alias(c) for j, c in enumerate(_PAIR)]).alias("p")
    )
    by_lag = whole.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("lag", "products", "p"))).alias("lags"))  # ``most`` elements

    def acf(j: int) -> Column:
        value = lambda e: F.when(F.col(f"n{j}") > e["lag"], e["products"][j] / (F.col(f"v{j}") + 1e-10) / (F.col(f"n{j}") - e["lag"]))
        return F.transform(F.slice("lags", 1, max_lag), value)

    def mean(a: Column) -> Column:
        there = F.filter(a, lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, v: s + v), F.size(there))

    matrix = [F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(len(columns))]) for i in range(len(columns))]
    found = base.join(by_lag, "feature").select(
        "feature",
        F.array(*[F.concat(F.array(F.lit(1.0)), acf(j)) for j in range(len(columns))]).alias("acf"),
        F.array(*matrix).alias("corr"),
        (F.col("excess_kurtosis") + 3).alias("kurtosis"),
        "excess_kurtosis",
        (F.col("excess_kurtosis") > 1.0).alias("is_fat_tailed"),
        mean(F.transform(acf(width - 2), F.abs)).alias("acf_abs_returns"),
        mean(F.transform(acf(width - 1), F.abs)).alias("acf_sq_returns"),
        F.transform(F.slice("lags", 1, leads), lambda e: _correlation(e["p"])).alias("correlations"),
        "pearson",
        (F.col("pearson") > 0.1).alias("has_vol_volume_corr"),
    )
    found = found.withColumns({"has_clustering": F.col("acf_abs_returns") > 0.05, "mean_leverage_corr": mean(F.col("correlations"))})
    return found.withColumn("has_leverage_effect", F.col("mean_leverage_corr") < -0.05)
