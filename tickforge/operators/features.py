"""Derived columns of bars: returns, volumes, rolling and smoothed indicators.

Series are numbered and cut into blocks (``series``), so that a long one spreads over tasks.
Rolling columns are window functions over a block and the copied end of the one before it.
Exponentially smoothed ones are recurrences, scanned block by block, all columns in one scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators import series

YEAR = 252


def by_date() -> WindowSpec:
    """Rows of a ticker in order."""
    return Window.partitionBy("ticker").orderBy("Date")


def _full(value: Column, counted: Column, n: int) -> Column:
    """The value once the frame holds ``n`` values."""
    return F.when(F.count(counted).over(series.in_block(n)) == n, value)


def log_returns(df: DataFrame, price_col: str = "Close") -> DataFrame:
    """LogReturn against the row before; rows with any null go, each series' first among them.

    Prices that are not positive have no logarithm, so that their rows go too.
    """
    ratio = F.try_divide(F.col(price_col), F.lag(price_col, 1).over(series.in_block()))
    rows = series.with_edges(series.placed(df), 1).withColumn("LogReturn", F.ln(ratio))
    return series.own(rows).drop(*series.HELPERS).dropna()  # places change as rows go


def log_volume(df: DataFrame, volume_col: str = "Volume") -> DataFrame:
    return df.withColumn("LogVolume", F.log1p(volume_col))


def dollar_volume(df: DataFrame, price_col: str = "Close", volume_col: str = "Volume") -> DataFrame:
    return df.withColumn("DollarVolume", F.col(price_col) * F.col(volume_col))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def existing(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` that there are, in order."""
    return [c for c in columns if c in df.columns]


def realized_volatility(df: DataFrame, window: int = 21, returns_col: str = "LogReturn") -> DataFrame:
    """Rolling sample deviation, annualised; ``df`` as it is where the returns are missing."""
    if returns_col not in df.columns:
        return df
    value = F.stddev_samp(returns_col).over(series.in_block(window)) * math.sqrt(YEAR)
    rows = series.with_edges(series.placed(df), window - 1).withColumn("RealizedVol", _full(value, F.col(returns_col), window))
    return series.bare(series.own(rows), df)


def bollinger_bands(df: DataFrame, window: int = 20, window_dev: float = 2.0, col: str = "Close") -> DataFrame:
    """Mean and population deviations around it; width in percent of the mean."""
    frame = series.in_block(window)
    mid, dev = F.avg(col).over(frame), F.stddev_pop(col).over(frame) * window_dev
    out = series.with_edges(series.placed(df), window - 1).withColumns({"BB_Middle": _full(mid, F.col(col), window), "_dev": _full(dev, F.col(col), window)})
    return series.bare(series.own(out), df).withColumns(
        {
            "BB_Upper": F.col("BB_Middle") + F.col("_dev"),
            "BB_Lower": F.col("BB_Middle") - F.col("_dev"),
            "BB_Width": F.try_divide(2 * F.col("_dev"), F.col("BB_Middle")) * 100,
        }
    ).drop("_dev")


def true_range(df: DataFrame) -> DataFrame:
    before = F.lag("Close", 1).over(series.in_block())
    ranges = F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - before), F.abs(F.col("Low") - before))
    return series.bare(series.own(series.with_edges(series.placed(df), 1).withColumn("TR", ranges)), df)


def _gains(rows: DataFrame, col: str) -> DataFrame:
    """_up and _down: what a placed row gains or loses against the one before it."""
    step = F.col(col) - F.lag(col, 1).over(series.in_block())
    part = lambda x: F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))
    return series.own(series.with_edges(rows, 1).withColumns({"_up": part(step), "_down": part(-step)}))


def _rsi_of(up: str, down: str) -> Column:
    return F.when(F.col(up).isNotNull(), F.when(F.col(down) == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down))))


def _ranges_from_mean(rows: DataFrame, n: int) -> DataFrame:
    """_tr: what Wilder's mean smooths, the mean of the first ``n`` true ranges at the nth, then each of the others."""
    first = true_range(rows).withColumn("TR", F.col("TR").cast("double"))
    mean = first.filter(F.col("_at") < n).groupBy("ticker").agg(F.avg("TR").alias("_mean"))  # a row a ticker
    named = F.when(F.col("_at") == n - 1, F.col("_mean")).when(F.col("_at") >= n, F.col("TR"))
    return first.join(mean, "ticker").withColumn("_tr", named).drop("TR", "_mean")


def _smoothed_features(df: DataFrame, rsi_of: tuple[str, int] | None, macd_of: tuple[str, int, int, int] | None, atr_of: int | None) -> DataFrame:
    """RSI, MACD and ATR as asked for, by one scan; a second one smooths the MACD line."""
    rows, asked, out, helpers = series.placed(df), {}, {}, []
    if rsi_of:
        col, n = rsi_of
        rows = _gains(rows, col)
        asked |= {"_s_up": ("_up", 1 / n, n), "_s_down": ("_down", 1 / n, n)}
        out["RSI"] = _rsi_of("_s_up", "_s_down")
        helpers += ["_up", "_down"]
    if macd_of:
        col, slow, fast, sign = macd_of
        rows = rows.withColumn("_price", F.col(col).cast("double"))
        asked |= {"_s_fast": ("_price", 2 / (fast + 1), fast), "_s_slow": ("_price", 2 / (slow + 1), slow)}
        out["MACD"] = F.col("_s_fast") - F.col("_s_slow")
        helpers.append("_price")
    if atr_of:
        rows = _ranges_from_mean(rows, atr_of)
        asked["_s_tr"] = ("_tr", 1 / atr_of, 0)
        out["ATR"] = F.coalesce("_s_tr", F.lit(0.0))
        helpers.append("_tr")
    if not asked:
        return df
    rows = series.smoothed(rows, asked).withColumns(out).drop(*helpers, *asked)
    if macd_of:
        rows = series.smoothed(rows, {"MACD_Signal": ("MACD", 2 / (sign + 1), sign)})
        rows = rows.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))
    return series.bare(rows, df)


def rsi(df: DataFrame, window: int = 14, col: str = "Close") -> DataFrame:
    return _smoothed_features(df, (col, window), None, None)


def macd(df: DataFrame, window_slow: int = 26, window_fast: int = 12, window_sign: int = 9, col: str = "Close") -> DataFrame:
    return _smoothed_features(df, None, (col, window_slow, window_fast, window_sign), None)


def atr(df: DataFrame, window: int = 14) -> DataFrame:
    """Wilder's mean of true ranges: zero before ``window`` rows, the mean of theirs at the last of them."""
    return _smoothed_features(df, None, None, window)


def add_features(
    df: DataFrame,
    use_rsi: bool = True,
    use_macd: bool = True,
    use_bollinger: bool = True,
    use_atr: bool = True,
    use_realized_vol: bool = True,
    rsi_window: int = 14,
    vol_window: int = 21,
) -> DataFrame:
    """All indicators asked for; the series are numbered once."""
    rows = _smoothed_features(series.placed(df), ("Close", rsi_window) if use_rsi else None, ("Close", 26, 12, 9) if use_macd else None, 14 if use_atr else None)
    if use_bollinger:
        rows = bollinger_bands(rows)
    if use_realized_vol:
        rows = realized_volatility(rows, vol_window)
    return series.bare(rows, df)
