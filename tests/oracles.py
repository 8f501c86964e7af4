"""Indicators of one series as plain folds, for comparison."""

import numpy as np
import pandas as pd


def smooth(x: pd.Series, alpha: float, least: int = 0) -> pd.Series:
    """y = a x + (1 - a) y before it, from the first value on; null before ``least`` values."""
    return x.ewm(alpha=alpha, min_periods=least, adjust=False).mean()


def rsi_values(close: pd.Series, n: int) -> pd.Series:
    step = close.diff()
    up, down = smooth(step.clip(lower=0).fillna(0.0), 1 / n, n), smooth((-step).clip(lower=0).fillna(0.0), 1 / n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = pd.Series(np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)), close.index)
    return value.where(up.notna())


def macd_values(close: pd.Series, slow: int, fast: int, sign: int) -> tuple[pd.Series, pd.Series, pd.Series]:
    line = smooth(close, 2 / (fast + 1), fast) - smooth(close, 2 / (slow + 1), slow)
    signal = smooth(line, 2 / (sign + 1), sign)
    return line, signal, line - signal


def atr_values(tr: pd.Series, n: int) -> pd.Series:
    """Wilder's mean of true ranges: zero before ``n`` values, their mean at the nth."""
    out = np.zeros(len(tr))
    x = tr.to_numpy()
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return pd.Series(out, tr.index)


