"""Streaming extension: bars from an event stream, and recurrences with keyed state.

Lags and row frames aren't defined on streams; the two recurrences keep their last value per
ticker as state instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(ticker, Date, Open..Volume) of events (event_type, ts, event_id, value) in tumbling windows."""
    order = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("ticker"))
    bars = grouped.agg(
        F.min_by("value", order).alias("Open"),
        F.max("value").alias("High"),
        F.min("value").alias("Low"),
        F.max_by("value", order).alias("Close"),
        F.count("*").cast("double").alias("Volume"),
    )
    return bars.select("ticker", F.col("w.start").alias("Date"), "Open", "High", "Low", "Close", "Volume")


def _recurrence(rows: DataFrame, step: Callable[[float | None, float], float], price_col: str, out: str) -> DataFrame:
    """A fold over each ticker's rows in order of Date; the state is the last value and its Date.

    A micro-batch's rows of a ticker are sorted as a whole, however many chunks they come in: a
    trigger bounds them. Rows dated before the last of an earlier batch come too late for an
    append-only result: they are returned with a null value and change nothing.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        part = pd.concat(list(parts), ignore_index=True).sort_values("Date", kind="stable")
        values: list[float | None] = []
        for date, x in zip(part["Date"], part[price_col], strict=True):
            if seen is not None and date < seen or pd.isna(date):
                values.append(None)
                continue
            last, seen = step(last, float(x)), date
            values.append(last)
        if last is not None:
            state.update((last, seen))
        yield pd.DataFrame({"ticker": key[0], "Date": part["Date"], out: pd.Series(values, part.index, "float64")})

    return rows.groupBy("ticker").applyInPandasWithState(run, f"ticker string, Date timestamp, {out} double", "last double, seen timestamp", "append", "NoTimeout")


def stream_continuity(rows: DataFrame, max_gap_pct: float = 0.2, price_col: str = "Close") -> DataFrame:
    """Prices no farther than a gap from the corrected one before."""

    def step(last: float | None, x: float) -> float:
        if not last or abs((x - last) / last) <= max_gap_pct:
            return x
        return last * (1 + max_gap_pct) if (x - last) / last > 0 else last * (1 - max_gap_pct)

    return _recurrence(rows, step, price_col, price_col)


def stream_ema(rows: DataFrame, alpha: float, price_col: str = "Close") -> DataFrame:
    """Exponential smoothing seeded by the first value."""
    return _recurrence(rows, lambda last, x: x if last is None else alpha * x + (1 - alpha) * last, price_col, "EMA")
