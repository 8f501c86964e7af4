"""Repair of bars that break price and volume rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.operators import series

LEAST_PRICE = 1e-6


def _strict(best: Column, *cols: Column) -> Column:
    """Null where any input is null or NaN, as min and max of arrays give."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | c.isNull() | F.isnan(c)
    return F.when(~bad, best)


def enforce_ohlc(df: DataFrame, strict: bool = False) -> DataFrame:
    """Low no more, High no less than Open and Close."""
    o, h, lo, c = (F.col(x) for x in ("Open", "High", "Low", "Close"))
    low, high = F.least(lo, o, c), F.greatest(h, o, c)
    return df.withColumns({"Low": _strict(low, lo, o, c) if strict else low, "High": _strict(high, h, o, c) if strict else high})


def enforce_volume(df: DataFrame, min_volume: float = 1.0, round_to_int: bool = False) -> DataFrame:
    """Volume floored; rounded half to even on request."""
    v = F.greatest(F.col("Volume"), F.lit(float(min_volume)))
    return df.withColumn("Volume", F.bround(v, 0).cast("bigint") if round_to_int else v)


def enforce_positive_prices(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.greatest(F.col(c), F.lit(LEAST_PRICE)) for c in ("Open", "High", "Low", "Close") if c in df.columns})


def enforce_price_continuity(df: DataFrame, max_gap_pct: float = 0.2, price_col: str = "Close", key: str = "ticker", order: str = "Date") -> DataFrame:
    """Each price within ``max_gap_pct`` of the corrected one before it: a recurrence over blocks of each series."""
    return series.enforce_continuity(df, max_gap_pct, price_col, key, order)


def apply_all(df: DataFrame, round_volume: bool = False, max_gap_pct: float = 0.2, strict: bool = False) -> DataFrame:
    """Positive prices, OHLC order, volume, continuity. ``strict`` orders OHLC once more, as clipped closes may leave it."""
    out = df.transform(enforce_positive_prices).transform(enforce_ohlc).transform(lambda d: enforce_volume(d, round_to_int=round_volume))
    out = enforce_price_continuity(out, max_gap_pct)
    return enforce_ohlc(out) if strict else out
