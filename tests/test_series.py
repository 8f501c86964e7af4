"""Long series in blocks against plain folds of each series."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import oracles
from tickforge.operators import constraints, features, ordered, series, windows


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 24)


def bars(seed=1, lengths=(1, 2, 23, 24, 25, 26, 60, 200), holes=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for k, n in enumerate(lengths):
        close = 100 + np.cumsum(rng.normal(0, 2, n))
        part = pd.DataFrame({"ticker": f"T{k}", "Date": pd.bdate_range("2020-01-01", periods=n), "High": close + 1, "Low": close - rng.random(n), "Close": close})
        if holes:
            part.loc[rng.random(n) < holes, "Close"] = np.nan
        out.append(part)
    return pd.concat(out, ignore_index=True)


def frame_of(spark, rows):
    made = spark.createDataFrame(rows.sample(frac=1, random_state=1))
    return made.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


def per_ticker(rows, names, compute):
    parts = []
    for _, part in rows.groupby("ticker"):
        part = part.copy()
        for name, values in zip(names, compute(part), strict=True):
            part[name] = np.asarray(values, float)
        parts.append(part)
    return pd.concat(parts)


def same(mine, theirs, names):
    mine = mine.toPandas().sort_values(["ticker", "Date"])
    for n in names:
        np.testing.assert_allclose(mine[n].to_numpy(float), theirs.sort_values(["ticker", "Date"])[n].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=n)


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_smoothed_features(spark, small, holes):
    rows = bars(holes=holes)
    b = frame_of(spark, rows)
    same(features.rsi(b), per_ticker(rows, ["RSI"], lambda p: [oracles.rsi_values(p["Close"], 14)]), ["RSI"])
    names = ["MACD", "MACD_Signal", "MACD_Hist"]
    same(features.macd(b), per_ticker(rows, names, lambda p: oracles.macd_values(p["Close"], 26, 12, 9)), names)
    assert features.macd(b).columns == [*b.columns, *names]


def test_wilder_mean_over_blocks(spark, small):
    rows = bars()

    def ranges(p):
        before = p["Close"].shift(1)
        return pd.concat([p["High"] - p["Low"], (p["High"] - before).abs(), (p["Low"] - before).abs()], axis=1).max(axis=1)

    same(features.atr(frame_of(spark, rows)), per_ticker(rows, ["ATR"], lambda p: [oracles.atr_values(ranges(p), 14)]), ["ATR"])


def test_rolling_features(spark, small):
    rows = bars(3)
    b = frame_of(spark, rows)
    want = per_ticker(rows, ["BB_Middle", "dev"], lambda p: [p["Close"].rolling(20).mean(), p["Close"].rolling(20).std(ddof=0)])
    want["BB_Upper"] = want["BB_Middle"] + 2 * want["dev"]
    same(features.bollinger_bands(b), want, ["BB_Middle", "BB_Upper"])
    want = per_ticker(rows, ["LogReturn"], lambda p: [np.log(p["Close"] / p["Close"].shift(1))]).dropna()
    same(features.log_returns(b), want, ["LogReturn"])
    want = per_ticker(want, ["RealizedVol"], lambda p: [p["LogReturn"].rolling(21).std() * np.sqrt(252)])
    same(features.realized_volatility(features.log_returns(b)), want, ["RealizedVol"])
    every = features.add_features(features.log_returns(b))
    assert "_at" not in every.columns and every.count() == len(want)
    with pytest.raises(ValueError, match="frames"):
        features.realized_volatility(features.log_returns(b), 60)


def test_windows_span_blocks(spark, small):
    got = windows.create_windows(frame_of(spark, bars(5)), 30, ["Close"], 7).groupBy("ticker").agg(F.count_distinct("window_id").alias("n"), F.count("*").alias("rows")).toPandas()
    assert {r.ticker: (r.n, r.rows) for r in got.itertuples()} == {"T6": (5, 150), "T7": (25, 750)}


@pytest.mark.parametrize("seed", range(4))
def test_continuity_with_repairs(spark, monkeypatch, seed):
    monkeypatch.setattr(series, "BLOCK", 7)
    rng = random.Random(seed)
    made = []
    for t, n in enumerate((1, 6, 7, 8, 50, 120)):
        price = 100.0
        for d in range(n):
            price = max(0.01, price * rng.choice([1.0, 1.01, 0.98, 3.0, 0.2] if seed % 2 else [1.0, 1.3, 1.3]))
            made.append((f"T{t}", d, None if rng.random() < 0.03 else price))
    frame = spark.createDataFrame(made, "ticker string, Date int, Close double").repartition(5)
    got = {(r["ticker"], r["Date"]): r["Close"] for r in constraints.enforce_price_continuity(frame).collect()}
    for t in {m[0] for m in made}:
        mine = [(d, p) for k, d, p in made if k == t]
        want = series.continuous(np.array([np.nan if p is None else p for _, p in mine]), 0.2)
        for (d, _), x in zip(mine, want, strict=True):
            assert got[t, d] == x or got[t, d] is None and np.isnan(x)


def test_heads_are_folded_until_they_meet():
    rng = np.random.default_rng(2)
    prices = np.exp(np.cumsum(rng.normal(0, 0.3, 300)))
    for before in (0.001, 1.0, 1e6):
        guess = series.continuous(prices, 0.2, prices[0])
        assert series.continuous(prices, 0.2, before, guess).tolist() == series.continuous(prices, 0.2, before).tolist()


def test_one_ticker_of_a_million_rows(spark):
    """Sixteen blocks of one series; the most that a task gets is a block."""
    n = 1_000_000
    close = (F.col("id") % 1009 + F.sin(F.col("id") / 50.0) * 20 + 100).alias("Close")
    rows = spark.range(n).select(F.lit("A").alias("ticker"), F.timestamp_seconds("id").alias("Date"), close)
    placed = series.placed(rows)
    sizes = placed.groupBy("_block").count().toPandas()["count"]
    assert sizes.max() == series.BLOCK and len(sizes) == -(-n // series.BLOCK)
    got = features.macd(placed).filter("_at % 997 = 0 OR _at > 999990").orderBy("_at").toPandas()
    at = np.arange(n)
    want = oracles.macd_values(pd.Series(at % 1009 + np.sin(at / 50.0) * 20 + 100.0), 26, 12, 9)
    for name, values in zip(["MACD", "MACD_Signal", "MACD_Hist"], want, strict=True):
        np.testing.assert_allclose(got[name].to_numpy(float), values.to_numpy()[got["_at"]], rtol=1e-9, atol=1e-9)


def test_numbers_within_keys(spark):
    rng = random.Random(1)
    made = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(2000)]
    got = ordered.numbered(spark.createDataFrame(made, "k string, o int, i int").repartition(7), ["k"], ["o"], "place", 5).toPandas()
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values("place")
        assert part["place"].tolist() == list(range(len(part))) and part["o"].is_monotonic_increasing


def test_logistic_regression_is_optimal(spark):
    """Newton steps over tasks against NumPy's on the whole rows, with collinear columns and an outlying one."""
    from tickforge.operators import utility

    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 6))
    x[:, 4] = x[:, 3]
    x[:, 5] *= 30
    y = (x @ [1.0, -2.0, 0.0, 0.5, 0.5, 0.01] + 0.3 + rng.logistic(size=500) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(7)
    weights, intercept, norms = utility.fit_logistic(rows)
    p = 1 / (1 + np.exp(-(x @ weights + intercept)))
    assert norms[-1] < 1e-8 and len(norms) < 15
    np.testing.assert_allclose(x.T @ (p - y) + weights, 0, atol=1e-6)
    assert abs((p - y).sum()) < 1e-6 and abs(weights[3] - weights[4]) < 1e-9
    assert utility.fit_logistic(rows.filter("y = 1"))[1] == np.inf
