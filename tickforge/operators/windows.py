"""Scaling, sliding windows, splits and their unions.

Windows are long tables (ticker, window_id, step, features): each bar is exploded into the
windows that hold it; rows are numbered by range partitions, so that a series may span tasks. Scaler parameters are one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators import features as feats
from tickforge.operators import series

DEFAULT_FEATURES = ["Open", "High", "Low", "Close", "Volume", "LogReturn", "LogVolume", "DollarVolume"]


def fit_scaler(df: DataFrame, columns: list[str], method: str = "minmax") -> DataFrame:
    """One row: per column its offset and scale; the scale of a constant is 1, so that it becomes 0."""
    if method == "minmax":
        low, scale = F.min, lambda c: F.max(c) - F.min(c)
    elif method == "zscore":
        low, scale = F.avg, F.stddev_pop
    else:
        raise ValueError(f"unknown normalization {method!r}")
    one = lambda s: F.when(s == 0, 1.0).otherwise(s)
    return df.agg(*[x for c in columns for x in (low(c).alias(f"_low_{c}"), one(scale(c)).alias(f"_scale_{c}"))])


def scale(df: DataFrame, params: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """Columns by the parameters, a single row that is broadcast."""

    def moved(c: str) -> Column:
        low, size = F.col(f"_low_{c}"), F.col(f"_scale_{c}")
        return F.col(c) * size + low if inverse else F.try_divide(F.col(c) - low, size)

    joined = df.crossJoin(F.broadcast(params))
    return joined.withColumns({c: moved(c) for c in columns}).select(*df.columns)


def normalize(df: DataFrame, columns: list[str] | None = None, method: str = "minmax") -> tuple[DataFrame, DataFrame]:
    """(scaled rows, parameters)."""
    columns = columns or feats.numeric_columns(df)
    params = fit_scaler(df, columns, method)
    return scale(df, params, columns), params


def _counted(rows: DataFrame) -> DataFrame:
    """Placed rows with _n, their series' length."""
    return rows.join(rows.groupBy("ticker").agg(F.count("*").alias("_n")), "ticker")


def create_windows(df: DataFrame, window_size: int = 30, columns: list[str] | None = None, stride: int = 1, check: bool = False) -> DataFrame:
    """(ticker, window_id, step, columns as float): windows at rows 0, stride, 2 stride... of each series.

    ``check`` raises if there is none, at the price of a job.
    """
    columns = columns or feats.numeric_columns(df)
    rows = _counted(series.placed(df.select("ticker", "Date", *[F.col(c).cast("float").alias(c) for c in columns])))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - window_size + 1) / stride)).cast("long")
    last = F.floor(F.least(F.col("_at"), F.col("_n") - window_size) / stride).cast("long")
    held = rows.filter(F.col("_n") >= window_size).withColumn("_ids", F.when(first <= last, F.sequence(first, last)))
    out = held.withColumn("window_id", F.explode("_ids")).withColumn("step", (F.col("_at") - F.col("window_id") * stride).cast("int"))
    out = out.select("ticker", "window_id", "step", *columns)
    if check and out.isEmpty():
        raise ValueError(f"no series has {window_size} rows")
    return out


def split(windows: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15, embargo: int = 0) -> DataFrame:
    """Adds split: train, val or test by place in each series' windows.

    ``embargo`` drops that many windows before each boundary (0: none, neighbours overlap).
    """
    n = F.max("window_id").over(Window.partitionBy("ticker")) + 1
    a = F.floor(n * train_ratio)
    b = a + F.floor(n * val_ratio)
    at = F.col("window_id")
    named = F.when(at < a - (embargo and F.lit(embargo)), "train").when((at >= a) & (at < b - (embargo and F.lit(embargo))), "val").when(at >= b, "test")
    return windows.withColumn("split", named).filter("split IS NOT NULL")


def derive(df: DataFrame) -> DataFrame:
    """Returns, log volume and dollar volume."""
    return df.transform(feats.log_returns).transform(feats.log_volume).transform(feats.dollar_volume)


def preprocess(
    df: DataFrame,
    columns: list[str] | None = None,
    window_size: int = 30,
    method: str = "minmax",
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    fit_scaler_on: str = "all",
    stride: int = 1,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(windows with split, scaler parameters, columns): derive, select, drop nulls, scale, cut, split.

    ``fit_scaler_on='train'`` fits on each series' first ``train_ratio`` rows only.
    """
    rows = derive(df)
    columns = feats.existing(rows, columns or DEFAULT_FEATURES)
    rows = rows.dropna(subset=columns)
    fitted = rows
    if fit_scaler_on == "train":
        fitted = _counted(series.placed(rows)).filter(F.col("_at") < F.floor(F.col("_n") * train_ratio))
    params = fit_scaler(fitted, columns, method)
    windows = create_windows(scale(rows, params, columns), window_size, columns, stride)
    return split(windows, train_ratio, val_ratio), params, columns


def as_arrays(windows: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker, window_id, values): each window as an array of rows."""
    row = F.struct("step", F.array(*columns).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])
    return windows.groupBy("ticker", "window_id").agg(ordered.alias("values"))


def flat_vectors(arrays: DataFrame) -> DataFrame:
    """(ticker, window_id, v): each window as one vector, row after row."""
    return arrays.select("ticker", "window_id", F.flatten("values").cast("array<double>").alias("v"))


def classification(arrays: DataFrame, return_index: int, horizon: int = 1) -> DataFrame:
    """(ticker, window_id, x, y): all but the last ``horizon`` rows, and whether the last row's return is positive."""
    x = F.flatten(F.slice("values", F.lit(1), F.size("values") - horizon)).cast("array<double>")
    y = (F.element_at(F.element_at("values", -1), return_index + 1) > 0).cast("int")
    return arrays.select("ticker", "window_id", x.alias("x"), y.alias("y"))


def union_all(parts: dict[str, DataFrame]) -> DataFrame:
    """Windows of several series under one running idx; names and lengths must agree."""
    if not parts:
        raise ValueError("no windows")
    frames = list(parts.items())
    names = [c for c in frames[0][1].columns if c != "ticker"]
    for ticker, f in frames:
        if [c for c in f.columns if c != "ticker"] != names:
            raise ValueError(f"{ticker} has other features")
    every = reduce(DataFrame.unionByName, [f.withColumns({"ticker": F.lit(t), "_part": F.lit(k)}) for k, (t, f) in enumerate(frames)])
    lengths = every.groupBy("_part").agg(F.max("step").alias("n")).agg(F.count_distinct("n")).first()[0]
    if lengths > 1:
        raise ValueError("windows of different lengths")
    # prefix sums over the parts, not a sort of all rows
    sizes = every.groupBy("_part").agg((F.max("window_id") + 1).alias("_size"))
    start = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.join(F.broadcast(sizes.select("_part", start.alias("_start"))), "_part").withColumn("idx", F.col("_start") + F.col("window_id")).drop("_part", "_start")


def number(windows: DataFrame) -> DataFrame:
    """Windows of all series under one running window_id, series in order of ticker; no series is scanned by itself."""
    sizes = windows.groupBy("ticker").agg((F.max("window_id") + 1).alias("_size"))  # one row a ticker
    start = F.coalesce(F.sum("_size").over(Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return windows.join(sizes.select("ticker", start.alias("_start")), "ticker").withColumn("window_id", F.col("_start") + F.col("window_id")).select(*windows.columns)


def item(windows: DataFrame, place: int, columns: list[str], key: str = "window_id") -> np.ndarray:
    """One window (length, columns) by its number ``key`` (``idx`` after ``union_all``); numbers below 0 count from the end."""
    if place < 0:
        place += (windows.agg(F.max(key)).first()[0] or 0) + 1
    rows = windows.filter(F.col(key) == place).orderBy("step").select(*columns).collect()  # a window's length
    if not rows:
        raise IndexError(place)
    return np.array(rows, np.float32)


def shape(windows: DataFrame) -> tuple[int, int, int]:
    """(windows, length, features)."""
    n, steps = windows.agg(F.count_distinct("ticker", "window_id"), F.max("step")).first()
    return n, (steps if steps is not None else -1) + 1, len([c for c in windows.columns if c not in ("ticker", "window_id", "step", "idx", "split")])
