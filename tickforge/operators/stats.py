"""Distribution tests, autocorrelation, correlation structure and stylised facts.

Series are long tables (feature, idx, x) with idx running without gaps, as windows flattened
row after row give. A lag is looked up within a block of idx, to which the rows of the block
before that lags reach are copied: series of any length spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions import special
from tickforge.operators import ordered, profiles
from tickforge.operators.profiles import pearson
from tickforge.sources.shared import stored

#: Rows of a series in a block.
BLOCK = 100_000


def long_series(windows: DataFrame, columns: list[str], length: int, key: Column | None = None) -> DataFrame:
    """(feature, idx, x) of windows (window_id, step, columns), one window after the other.

    With a ``key``, as a ticker, features are named ``key:column``: a series for each.
    """
    idx = F.col("window_id") * length + F.col("step")
    name = lambda c: F.lit(c) if key is None else F.concat(key, F.lit(f":{c}"))
    pairs = F.explode(F.array(*[F.struct(name(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    return windows.select(idx.alias("idx"), pairs.alias("p")).select("p.feature", "idx", "p.x")


def shifted(series: DataFrame, columns: list[str], lags: list[int], back: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds ``{column}_{k}``: the column's value k rows before (``back``) or after; null where there is none."""
    reach = max(lags)
    place = F.pmod("idx", F.lit(block))
    here = F.floor(F.col("idx") / block)
    near = place >= block - reach if back else place < reach
    other = here + 1 if back else here - 1
    spread = series.withColumn("_b", F.explode(F.when(near, F.array(here, other)).otherwise(F.array(here)))).withColumn("_own", F.col("_b") == here)
    w = Window.partitionBy("feature", "_b").orderBy("idx")
    look = F.lag if back else F.lead
    return spread.withColumns({f"{c}_{k}": look(c, k).over(w) for c in columns for k in lags}).filter("_own").drop("_b", "_own")


def acf(series: DataFrame, max_lag: int = 20) -> DataFrame:
    """(feature, lag, acf): lag 0 is 1; else the mean lagged product over the population variance + 1e-10."""
    base = series.groupBy("feature").agg(F.avg("x").alias("_m"), F.var_pop("x").alias("_v"), F.count("x").alias("_n"))
    lags = list(range(1, max_lag + 1))
    centred = series.join(F.broadcast(base), "feature").withColumn("x", F.col("x") - F.col("_m"))
    moved = shifted(centred.select("feature", "idx", "x"), ["x"], lags)
    sums = moved.groupBy("feature").agg(*[F.sum(F.col("x") * F.col(f"x_{k}")).alias(f"s{k}") for k in lags])
    each = F.explode(F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}") / (F.col("_v") + 1e-10), F.col("_n") - k).alias("acf")) for k in lags]))
    return sums.join(F.broadcast(base), "feature").select("feature", each.alias("a")).select("feature", "a.lag", "a.acf")


def acf_comparison(real: DataFrame, synthetic: DataFrame, max_lag: int = 20) -> DataFrame:
    """(feature, real_acf, synthetic_acf, mae): arrays by lag; the error counts lag 0."""
    both = acf(real, max_lag).withColumnRenamed("acf", "r").join(acf(synthetic, max_lag).withColumnRenamed("acf", "s"), ["feature", "lag"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("lag", c))), lambda x: x[c])
    return both.groupBy("feature").agg(ordered("r").alias("real_acf"), ordered("s").alias("synthetic_acf"), F.avg(F.abs(F.col("r") - F.col("s"))).alias("mae"))


def paired_counts(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, r, s, and each with _before and _all): how often each distinct value is real (``r`` of a row is 1) and synthetic (0).

    Equal values are counted before they are shuffled, so that ties meet; running sums go over
    parts of each key's distinct values.
    """
    counts = tagged.filter("x IS NOT NULL").groupBy(*keys, "x").agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("s"))
    return ordered.running(counts, keys, "x", ["r", "s"])


def largest_gap(run: DataFrame) -> DataFrame:
    """(feature, ks_statistic, n, m) of ``paired_counts`` by feature."""
    share = lambda c: F.try_divide(F.col(c) + F.col(f"{c}_before"), F.col(f"{c}_all"))
    return run.groupBy("feature").agg(F.max(F.abs(share("r") - share("s"))).alias("ks_statistic"), F.first("r_all").alias("n"), F.first("s_all").alias("m"))


def ks_statistic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(feature, ks_statistic, n, m) of series (feature, x)."""
    tagged = real.select("feature", "x", F.lit(1).alias("r")).unionAll(synthetic.select("feature", "x", F.lit(0).alias("r")))
    return largest_gap(paired_counts(tagged, ["feature"]))


def with_p_values(statistics: DataFrame) -> dict[str, dict[str, float]]:
    """Statistic and p per feature: exact for samples up to special.EXACT values, else asymptotic."""
    return {r["feature"]: {"ks_statistic": r["ks_statistic"], "p_value": special.ks_p_value(r["ks_statistic"], r["n"], r["m"])} for r in statistics.collect()}


def ks_test(real: DataFrame, synthetic: DataFrame) -> dict[str, dict[str, float]]:
    return with_p_values(ks_statistic(real, synthetic))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, corr) of every pair of columns, in one pass."""
    pairs = [(i, j) for k, i in enumerate(columns) for j in columns[k:]]
    wide = rows.agg(*[pearson(i, j).alias(f"c{n}") for n, (i, j) in enumerate(pairs)])
    cell = lambda i, j, n: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{n}").alias("corr"))
    cells = [c for n, (i, j) in enumerate(pairs) for c in ([cell(i, j, n)] if i == j else [cell(i, j, n), cell(j, i, n)])]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def cross_correlation(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, real_corr, synthetic_corr, signed_diff, diff)."""
    r, s = correlations(real, columns).withColumnRenamed("corr", "real_corr"), correlations(synthetic, columns).withColumnRenamed("corr", "synthetic_corr")
    signed = F.col("real_corr") - F.col("synthetic_corr")
    return r.join(s, ["i", "j"]).withColumns({"signed_diff": signed, "diff": F.abs(signed)})


def frobenius(cells: DataFrame, column: str = "signed_diff") -> DataFrame:
    return cells.agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("frobenius_norm"))


def fat_tails(series: DataFrame) -> DataFrame:
    """(feature, kurtosis, excess_kurtosis, is_fat_tailed): population moments."""
    excess = F.kurtosis("x")
    return series.groupBy("feature").agg((excess + 3).alias("kurtosis"), excess.alias("excess_kurtosis"), (excess > 1.0).alias("is_fat_tailed"))


def volatility_clustering(series: DataFrame, max_lag: int = 20) -> DataFrame:
    """(feature, acf_abs_returns, acf_sq_returns, has_clustering): mean absolute acf over lags from 1."""
    kinds = F.explode(F.array(F.struct(F.lit("abs").alias("k"), F.abs("x").alias("x")), F.struct(F.lit("sq").alias("k"), (F.col("x") * F.col("x")).alias("x"))))
    split = series.select("feature", "idx", kinds.alias("v")).select(F.struct("feature", "v.k").alias("feature"), "idx", "v.x")
    mean = acf(split, max_lag).filter("lag > 0").groupBy(F.col("feature.feature").alias("feature")).agg(
        F.avg(F.when(F.col("feature.k") == "abs", F.abs("acf"))).alias("acf_abs_returns"),
        F.avg(F.when(F.col("feature.k") == "sq", F.abs("acf"))).alias("acf_sq_returns"),
    )
    return mean.withColumn("has_clustering", F.col("acf_abs_returns") > 0.05)


def leverage_effect(pairs: DataFrame, lags: int = 10) -> DataFrame:
    """(feature, correlations, mean_leverage_corr, has_leverage_effect) of rows (feature, idx, r, vol): r against later volatility."""
    ks = list(range(1, lags + 1))
    moved = shifted(pairs.select("feature", "idx", "r", "vol"), ["vol"], ks, back=False)
    wide = moved.groupBy("feature").agg(*[pearson("r", f"vol_{k}").alias(f"c{k}") for k in ks])
    every = wide.select("feature", F.array(*[f"c{k}" for k in ks]).alias("correlations"))
    valid = F.filter("correlations", lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x), F.size(valid))
    return every.withColumn("mean_leverage_corr", mean).withColumn("has_leverage_effect", F.col("mean_leverage_corr") < -0.05)


def average_ranks(rows: DataFrame, ranks: dict[str, str], counts: DataFrame | None = None) -> DataFrame:
    """Adds per column a rank from 1, named as ``ranks`` says, ties averaged. Rows without one of the values go.

    One running count goes over the distinct values of all columns, unless ``counts`` (feature, _c, _x, _rank)
    has been made; the ranks are joined back by value.
    """
    columns = list(ranks)
    rows = rows.dropna(subset=columns)
    if counts is None:
        rows = stored(rows, "ranked")
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in columns]))
        values = rows.select("feature", pairs.alias("_p")).select("feature", F.col("_p.c").alias("_c"), F.col("_p.x").alias("_x"))
        counts = stored(ordered.counted(values, ["feature", "_c"], "_x").select("feature", "_c", "_x", (F.col("n_before") + (F.col("n") + 1) / 2).alias("_rank")), "ranks")
    for c, name in ranks.items():
        rows = rows.join(counts.filter(F.col("_c") == c).select("feature", F.col("_x").alias(c), F.col("_rank").alias(name)), ["feature", c])
    return rows


def volume_volatility(pairs: DataFrame) -> DataFrame:
    """(feature, pearson, spearman, n, has_vol_volume_corr) of rows (feature, volume, vol)."""
    ranked = average_ranks(pairs.select("feature", "volume", "vol"), {"volume": "_rv", "vol": "_rw"})
    out = ranked.groupBy("feature").agg(pearson("volume", "vol").alias("pearson"), pearson("_rv", "_rw").alias("spearman"), F.count("*").alias("n"))
    return out.withColumn("has_vol_volume_corr", F.col("pearson") > 0.1)


def stylized_table(rows: DataFrame, max_lag: int = 20, lags: int = 10) -> DataFrame:
    """All facts of series (feature, idx, r, volume, vol), a row each; p-values are left to ``stylized_facts``."""
    rows = stored(rows.select("feature", "idx", "r", "volume", "vol"), "facts")
    ranked = average_ranks(rows.select("feature", "volume", "vol"), {"volume": "_rv", "vol": "_rw"})
    spearman = ranked.groupBy("feature").agg(pearson("_rv", "_rw").alias("spearman"), F.count("*").alias("n"))
    return profiles.profile(rows, [], max_lag, lags).join(spearman, "feature", "left").drop("acf", "corr")


_FACTS = {
    "fat_tails": ("kurtosis", "excess_kurtosis", "is_fat_tailed"),
    "volatility_clustering": ("acf_abs_returns", "acf_sq_returns", "has_clustering"),
    "leverage_effect": ("correlations", "mean_leverage_corr", "has_leverage_effect"),
    "volume_volatility": ("pearson", "spearman", "has_vol_volume_corr"),
}


def facts_of(found: dict) -> dict:
    """A row of ``stylized_table``, grouped by fact, with p-values of the correlations."""
    out = {k: {c: found.get(c) for c in columns} for k, columns in _FACTS.items()}
    n = found.get("n") or 0
    out["volume_volatility"] |= {f"{k}_p": special.correlation_p_value(found.get(k), n) for k in ("pearson", "spearman")}
    return out


def stylized_facts(rows: DataFrame, max_lag: int = 20, lags: int = 10) -> dict:
    """All facts of one series (idx, r, volume, vol), with p-values of its correlations."""
    found = stylized_table(rows.withColumn("feature", F.lit("returns")), max_lag, lags).first()
    return facts_of(found.asDict() if found else {})


def histogram(series: DataFrame, bins: int = 50) -> DataFrame:
    """(feature, bin, left, right, count, density): equal bins between each feature's extremes, the last one closed."""
    edges = series.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    # a constant gets a range of one around it
    edges = edges.withColumns({"lo": F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("hi") == F.col("lo"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counted = series.filter("x IS NOT NULL").join(F.broadcast(edges), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("count"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counted, ["feature", "bin"], "left")
    count = F.coalesce("count", F.lit(0))
    return every.select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), count.alias("count"), F.try_divide(count, F.col("n") * width).alias("density"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max) with exact, interpolated quartiles."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = stored(rows.select(pairs.alias("p")).select("p.*"), "described")
    out = long.groupBy("feature").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.join(ordered.percentiles(long, ["feature"], "x", [0.25, 0.5, 0.75]), "feature", "left")
    return out.select("feature", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def ticker_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("Date").alias("first"), F.max("Date").alias("last"))


def sample_series(windows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` windows: what a plot of series shows."""
    return windows.filter(F.col("window_id") < count)
