"""Invariants and hand-derived values of the operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import oracles
from tickforge.functions import losses, special
from tickforge.operators import constraints, features, generative, networks, pairwise, report, stats, training, utility, windows
from tickforge.operators.series import continuous
from tickforge.sources import files


def bars(spark, n=100, seed=42, tickers=("A",)):
    rng = np.random.default_rng(seed)
    out = []
    for t in tickers:
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        days = pd.bdate_range("2020-01-01", periods=n)
        out.append(pd.DataFrame({"ticker": t, "Date": days, "Open": close + rng.normal(0, 0.5, n), "High": close + 1, "Low": close - 1, "Close": close, "Volume": rng.integers(1000, 10000, n).astype(float)}))
    return spark.createDataFrame(pd.concat(out))


def vecs(spark, array):
    return spark.createDataFrame([(i, r) for i, r in enumerate(np.asarray(array, float).tolist())], "id long, v array<double>")


def series(spark, x, feature="x"):
    return spark.createDataFrame([(feature, i, float(v)) for i, v in enumerate(x)], "feature string, idx long, x double")


class TestFiles:
    @pytest.mark.parametrize("kind", files.FORMATS)
    def test_round_trip(self, spark, tmp_path, kind):
        b = bars(spark, 20, tickers=("A", "B"))
        files.write_bars(b, str(tmp_path), file_format=kind)
        assert files.load_bars(spark, "A", str(tmp_path), file_format=kind).count() == 20
        assert files.load_bars(spark, "C", str(tmp_path), file_format=kind) is None

    def test_ingest_skips_what_fails(self, spark, tmp_path):
        def fetch(s, t):
            if t == "X":
                raise OSError(t)
            return None if t == "N" else bars(s, 5)

        assert files.ingest(spark, ["A", "X", "N", "B"], fetch, str(tmp_path)).select("ticker").distinct().count() == 2

    def test_unknown_formats(self, spark, tmp_path):
        with pytest.raises(ValueError):
            files.load_bars(spark, "A", str(tmp_path), file_format="xml")
        with pytest.raises(ValueError):
            files.load_table(spark, "x.txt")

    def test_arrays(self, spark, tmp_path):
        a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
        np.save(tmp_path / "a.npy", a)
        rows = files.load_table(spark, str(tmp_path / "a.npy"))
        files.save_array(rows, str(tmp_path / "b.npy"), [f"f{k}" for k in range(4)])
        assert (np.load(tmp_path / "b.npy") == a).all()

    @pytest.mark.parametrize("order", ["C", "F"])
    def test_arrays_by_ranges_and_parts(self, spark, tmp_path, monkeypatch, order):
        from tickforge.sources import arrays

        monkeypatch.setattr(arrays, "CHUNK", 100)
        rng = np.random.default_rng(0)
        a, flat = rng.normal(size=(23, 3, 2)).astype(np.float32), rng.normal(size=(17, 5))
        np.save(tmp_path / "a.npy", np.asarray(a, order=order))
        np.save(tmp_path / "flat.npy", np.asarray(flat, order=order))
        rows = files.load_table(spark, str(tmp_path / "a.npy"))
        back = rows.toPandas().sort_values(["window_id", "step"])[["f0", "f1"]].to_numpy().reshape(a.shape)
        assert (back == a).all()
        vectors = files.load_table(spark, str(tmp_path / "flat.npy")).toPandas().sort_values("id")
        assert (np.stack(vectors["v"].to_numpy()) == flat).all()
        for parts in (False, True):
            path = str(tmp_path / f"out-{parts}.npy")
            arrays.write(rows.repartition(5), path, ["f0", "f1"], parts)
            again = files.load_table(spark, path).toPandas().sort_values(["window_id", "step"])
            assert (again[["f0", "f1"]].to_numpy().reshape(a.shape) == a).all()
        assert (np.load(tmp_path / "out-False.npy") == a).all()

    def test_arrays_that_are_no_windows(self, spark, tmp_path):
        from tickforge.sources import arrays

        np.save(tmp_path / "one.npy", np.arange(3.0))
        with pytest.raises(ValueError):
            files.load_table(spark, str(tmp_path / "one.npy"))
        rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "window_id long, step int, f0 double")
        with pytest.raises(ValueError):
            arrays.write(rows, str(tmp_path / "x.npy"), ["f0"])
        for parts in (False, True):
            arrays.write(rows.limit(0), str(tmp_path / f"none-{parts}.npy"), ["f0"], parts)
            assert files.load_table(spark, str(tmp_path / f"none-{parts}.npy")).count() == 0

    def test_config_and_checkpoint(self, tmp_path):
        (tmp_path / "c.yaml").write_text("a: {b: 1, c: 2}\n")
        (tmp_path / "d.yaml").write_text("a: {b: 3}\n")
        assert files.load_and_merge(str(tmp_path / "c.yaml"), str(tmp_path / "d.yaml")) == {"a": {"b": 3, "c": 2}}
        with pytest.raises(FileNotFoundError):
            files.load_config(str(tmp_path / "none.yaml"))
        files.save_checkpoint(str(tmp_path / "m.npz"), {"w": np.ones(3)}, 4, {"loss": 0.5})
        state, meta = files.load_checkpoint(str(tmp_path / "m.npz"))
        assert meta == {"epoch": 4, "metrics": {"loss": 0.5}} and state["w"].sum() == 3

    def test_report_and_metric_log(self, spark, tmp_path):
        path = files.save_report({"x": np.float64(1.5), "ok": np.bool_(True), "a": np.arange(2)}, str(tmp_path))
        assert json.load(open(path)) == {"x": 1.5, "ok": True, "a": [0, 1]}
        for e in (1, 2):
            files.log_metrics(str(tmp_path / "log"), e, {"loss": 1 / e})
        assert files.read_metrics(spark, str(tmp_path / "log")).count() == 2


class TestFeatures:
    def test_columns_and_warm_up(self, spark):
        out = features.add_features(features.log_returns(bars(spark, 60))).toPandas()
        assert out["RSI"].isna().sum() == 13 and out["RSI"].dropna().between(0, 100).all()
        assert out["RealizedVol"].isna().sum() == 20 and out["MACD"].isna().sum() == 25
        assert (out["BB_Upper"].dropna() >= out["BB_Lower"].dropna()).all()

    def test_first_return_goes_per_ticker(self, spark):
        assert features.log_returns(bars(spark, 30, tickers=("A", "B"))).count() == 58

    def test_missing_returns_pass_through(self, spark):
        b = bars(spark, 5)
        assert features.realized_volatility(b).columns == b.columns

    def test_wilder_mean(self):
        assert oracles.atr_values(pd.Series([1.0, 2, 3, 4]), 2).tolist() == [0, 1.5, 2.25, 3.125]


class TestConstraints:
    def test_gap_recurrence(self):
        assert continuous(np.array([100.0, 200, 201]), 0.2).tolist() == pytest.approx([100, 120, 144])
        assert continuous(np.array([0.0, 5, 6]), 0.2).tolist() == [0, 5, 6]

    @given(st.lists(st.floats(0.01, 1e6), max_size=30), st.floats(0.01, 0.9))
    def test_no_gap_is_left(self, prices, gap):
        out = continuous(np.array(prices), gap)
        assert all(abs(b - a) <= a * gap * (1 + 1e-9) for a, b in zip(out, out[1:], strict=False))

    def test_invariants(self, spark):
        rows = [("A", 1, 10.0, 9.0, 11.0, 12.0, -5.0), ("A", 2, 0.0, -1.0, 3.0, 2.5, 0.0), ("A", 3, 5.0, 6.0, 4.0, 5.0, 2.5)]
        df = spark.createDataFrame(rows, "ticker string, Date int, Open double, High double, Low double, Close double, Volume double")
        out = constraints.apply_all(df, round_volume=True, strict=True).toPandas()
        assert (out["High"] >= out[["Open", "Close"]].max(axis=1) - 1e-10).all() and (out["Low"] <= out[["Open", "Close"]].min(axis=1) + 1e-10).all()
        assert (out["Volume"] >= 1).all() and out["Volume"].dtype == np.int64 and (out["Open"] > 0).all()
        assert sorted(out["Volume"]) == [1, 1, 2]

    def test_strict_nulls(self, spark):
        df = spark.createDataFrame([(1.0, None, 2.0, 3.0)], "Open double, High double, Low double, Close double")
        assert constraints.enforce_ohlc(df).first()["High"] == 3.0
        assert constraints.enforce_ohlc(df, strict=True).first()["High"] is None


class TestWindows:
    @pytest.mark.parametrize(("n", "size", "stride"), [(30, 30, 1), (31, 30, 1), (50, 7, 3), (10, 4, 4), (9, 5, 2)])
    def test_count_and_content(self, spark, n, size, stride):
        b = bars(spark, n)
        out = windows.create_windows(b, size, ["Close"], stride).orderBy("window_id", "step").toPandas()
        close = b.toPandas()["Close"].to_numpy(np.float32)
        want = [close[s : s + size] for s in range(0, n - size + 1, stride)]
        assert len(out) == len(want) * size
        assert (out["Close"].to_numpy(np.float32).reshape(-1, size) == np.array(want)).all()

    def test_too_short(self, spark):
        with pytest.raises(ValueError):
            windows.create_windows(bars(spark, 3), 30, ["Close"], check=True)

    def test_split_is_70_15_15(self, spark):
        w = spark.range(100).select(F.lit("A").alias("ticker"), F.col("id").alias("window_id"), F.lit(0).alias("step"))
        assert dict(map(tuple, windows.split(w).groupBy("split").count().collect())) == {"train": 70, "val": 15, "test": 15}
        assert windows.split(w, embargo=5).count() == 90

    def test_scalers(self, spark):
        df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "x double, c double")
        out = windows.normalize(df)[0].toPandas()
        assert out["x"].tolist() == pytest.approx([0, 1 / 3, 1]) and (out["c"] == 0).all()
        scaled, params = windows.normalize(df, ["x"], "zscore")
        assert scaled.toPandas()["x"].std(ddof=0) == pytest.approx(1)
        assert windows.scale(scaled, params, ["x"], inverse=True).toPandas()["x"].tolist() == pytest.approx([1, 2, 4])
        with pytest.raises(ValueError):
            windows.normalize(df, ["x"], "other")

    def test_union(self, spark):
        a, b = (windows.create_windows(bars(spark, n), 5, ["Close"]) for n in (8, 9))
        both = windows.union_all({"A": a, "B": b})
        assert sorted(r[0] for r in both.select("idx").distinct().collect()) == list(range(9))
        with pytest.raises(ValueError):
            windows.union_all({})
        with pytest.raises(ValueError):
            windows.union_all({"A": a, "B": b.withColumnRenamed("Close", "Open")})
        with pytest.raises(ValueError):
            windows.union_all({"A": a, "B": windows.create_windows(bars(spark, 9), 6, ["Close"])})


class TestStatistics:
    def test_ks_ties_and_symmetry(self, spark):
        a, b = series(spark, [1, 1, 2, 3]), series(spark, [1, 2, 2, 5, 6])
        d = stats.ks_statistic(a, b).first()["ks_statistic"]
        assert d == pytest.approx(0.4) and d == stats.ks_statistic(b, a).first()["ks_statistic"]
        assert stats.ks_statistic(a, a).first()["ks_statistic"] == 0

    def test_blocks_dont_change_lags(self, spark):
        x = np.random.default_rng(0).normal(size=50)
        for back in (True, False):
            out = stats.shifted(series(spark, x), ["x"], [1, 3], back, block=7).orderBy("idx").toPandas()
            for k in (1, 3):
                want = pd.Series(x).shift(k if back else -k)
                assert out[f"x_{k}"].fillna(-99).tolist() == pytest.approx(want.fillna(-99).tolist())

    def test_acf(self, spark):
        x = np.random.default_rng(1).normal(size=80)
        got = {r["lag"]: r["acf"] for r in stats.acf(series(spark, x), 5).collect()}
        m, v = x.mean(), x.var() + 1e-10
        assert got[0] == 1 and all(got[k] == pytest.approx(((x[k:] - m) * (x[:-k] - m)).sum() / (80 - k) / v) for k in range(1, 6))

    def test_constant_correlation_is_null(self, spark):
        df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
        assert all(r["corr"] is None for r in stats.correlations(df, ["a", "b"]).filter("i <> j").collect())

    def test_fat_tails(self, spark):
        x = np.random.default_rng(42).laplace(size=1000)
        assert stats.fat_tails(series(spark, x)).first()["kurtosis"] > 3

    def test_average_ranks(self, spark):
        df = spark.createDataFrame([("f", v) for v in (3.0, 1.0, 1.0, 2.0)], "feature string, v double")
        assert sorted(r["k"] for r in stats.average_ranks(df, {"v": "k"}).collect()) == [1.5, 1.5, 3, 4]

    def test_histogram_of_constant(self, spark):
        out = stats.histogram(series(spark, [2, 2, 2]), 10).toPandas()
        assert out["count"].sum() == 3 and len(out) == 10

    def test_tails(self):
        assert special.ks_p_value(0.5, 1000, 1000) < 1e-10 and special.ks_p_value(0.0, 10, 10) == 1
        assert special.kolmogorov_tail(1.36) == pytest.approx(0.0494, abs=1e-3)
        assert special.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4) and special.t_cdf(-1.0, 1) == pytest.approx(0.25)
        for df in (1.0, 4.0, 37.5):
            values = np.array([[-50.0, -3.0, -0.2, 0.0], [1e-3, 0.7, 2.0, 400.0]])
            assert special.t_cdf_of(values, df) == pytest.approx(np.array([[special.t_cdf(x, df) for x in row] for row in values]), abs=1e-11)
        cauchy = np.array([-30.0, -1e-9, 1e-9, 0.4, 12.0])
        assert special.t_cdf_of(cauchy, 1.0) == pytest.approx(0.5 + np.arctan(cauchy) / np.pi, abs=1e-15)
        edges = special.t_cdf_of(np.array([np.inf, -np.inf, np.nan]), 4.0)
        assert edges[:2].tolist() == [1.0, 0.0] and np.isnan(edges[2]) and special.t_cdf_of(np.zeros(0), 4.0).shape == (0,)
        assert special.correlation_p_value(0.0, 10) == pytest.approx(1) and special.correlation_p_value(1.0, 10) == 0


class TestPairwise:
    def test_mmd(self, spark):
        rng = np.random.default_rng(2)
        x = rng.normal(size=(60, 5))
        assert pairwise.mmd_rbf(vecs(spark, x), vecs(spark, x))["mmd"] == pytest.approx(0, abs=1e-12)
        assert pairwise.mmd_rbf(vecs(spark, x), vecs(spark, x + 5))["mmd"] > 0.05

    @pytest.mark.parametrize("k, block", [(1, 5), (4, 11), (4, 2048), (50, 7)])
    def test_neighbours_across_cells(self, spark, k, block):
        rng = np.random.default_rng(3)
        x, y = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
        x[:8] = x[0]  # copies, ties
        want = np.sort(np.linalg.norm(y[:, None] - x[None], axis=2), axis=1)[:, :k]
        got = pairwise.nearest(vecs(spark, y), vecs(spark, x), k, block).orderBy("id", "rank").toPandas()
        assert got["distance"].to_numpy().reshape(30, -1) == pytest.approx(want)

    def test_far_cells_are_skipped(self, spark):
        """Groups far apart: what is skipped, and that nothing is lost by it."""
        rng = np.random.default_rng(5)
        x = np.repeat(rng.normal(size=(12, 4)) * 100, 25, axis=0) + rng.normal(size=(300, 4))
        y = x + rng.normal(size=x.shape) / 10
        real, made = pairwise.in_cells(vecs(spark, x), vecs(spark, y), block=10)
        found, skipped = pairwise.neighbours(made, real, 3)
        want = np.sort(np.linalg.norm(y[:, None] - x[None], axis=2), axis=1)[:, :3]
        assert found.orderBy("id", "rank").toPandas()["distance"].to_numpy().reshape(300, 3) == pytest.approx(want)
        assert skipped > 0.5
        kernels = pairwise.mmd_rbf(vecs(spark, x), vecs(spark, y), block=10)
        for name, (a, b) in {"xx": (x, x), "yy": (y, y), "xy": (x, y)}.items():
            want = np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / 2).mean()
            assert kernels[name] == pytest.approx(want, abs=1e-12)
        assert kernels["pairs_skipped"] > 0.5

    def test_hot_cell_in_pieces(self, spark):
        """All rows in one cell, more than a block of them, repeated ids among them."""
        x = np.random.default_rng(6).normal(size=(60, 2)) / 1000
        rows = vecs(spark, x).withColumn("id", F.lit(7).cast("long"))
        found = pairwise.nearest(rows, vecs(spark, x), 2, 9).toPandas()
        assert len(found) == 120 and (found[found["rank"] == 1]["distance"] == 0).all()
        assert pairwise.kernel_mean(rows, rows, block=9) == pytest.approx(np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2).mean())

    def test_empty_and_missing_vectors(self, spark):
        x = vecs(spark, [[0.0, 1.0], [1.0, 1.0]])
        none = x.limit(0)
        assert pairwise.nearest(none, x, 2).count() == 0 and pairwise.nearest(x, none, 2).count() == 0
        assert pairwise.mmd_rbf(x, none)["mmd"] is None
        gap = x.withColumn("v", F.when(F.col("id") > 0, F.col("v")))
        assert [r["id"] for r in pairwise.nearest(gap, x, 1).collect()] == [1]

    def test_shuffled_rows_grow_with_the_rows(self, spark):
        """Four times the rows, in four times the pieces: not sixteen times the rows shuffled."""

        def shuffled():
            context = spark.sparkContext
            stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
            return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

        def added(n):
            x = np.random.default_rng(8).normal(size=(n, 3))
            before = shuffled()
            pairwise.kernel_mean(vecs(spark, x), vecs(spark, x + 0.1), block=25)
            return sum(v - before.get(k, 0) for k, v in shuffled().items())

        small, large = added(50), added(200)
        assert large < 6 * small, (small, large)

    def test_kernel_from_products(self, monkeypatch):
        """Ordinary vectors need no differences; where rounding would show, differences are taken."""
        rng = np.random.default_rng(9)
        x, y = rng.normal(size=(300, 16)), rng.normal(size=(500, 16))
        plain = lambda x, y, h: np.exp(-((x[:, None] - y[None]) ** 2).sum(axis=2) / (2 * h * h)).sum()
        far, squares = 1e9, pairwise._squares
        near = np.round(x * 2) / 2  # exact beside 1e9
        assert pairwise._kernel_sum(near + far, near + far, near[0], 1.0) == pytest.approx(plain(near, near, 1.0), rel=1e-13)
        monkeypatch.setattr(pairwise, "_squares", None)
        for h in (0.8, 1.0, 7.0):
            assert pairwise._kernel_sum(x, y, y[0], h) == pytest.approx(plain(x, y, h), rel=1e-12)
        assert pairwise._kernel_sum(near + far, near + far, near[0] + far, 1.0) == pytest.approx(plain(near, near, 1.0), rel=1e-12)
        assert pairwise._kernel_sum(x[:0], y, y[0], 1.0) == pairwise._kernel_sum(x, y[:0], y[0], 1.0) == 0
        monkeypatch.setattr(pairwise, "_squares", squares)
        assert np.isnan(pairwise._kernel_sum(np.append(x, [[np.nan] * 16], axis=0), y, y[0], 1.0))

    @pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e7, 1.0), (0.0, 1e-25), (0.0, 1e25), (3.0, 1e-6)])
    @pytest.mark.parametrize("k", [1, 6, 70])
    def test_pairs_that_may_be_near(self, shift, scale, k):
        """What is left out in single precision is no neighbour; distances are those of differences, to the last bit."""
        rng = np.random.default_rng(10)
        x, y = rng.normal(size=(90, 64)) * scale + shift, rng.normal(size=(60, 64)) * scale + shift
        x[:5], y[:20] = y[:5], y[0]  # copies, ties
        every = pairwise._squares(x, y)
        bound = np.where(np.arange(90) % 3 == 0, np.nan, np.sort(every, axis=1)[:, min(k, 60) - 1])
        i, j, d2 = pairwise._near_pairs(x, y, y[7], bound, k)
        assert (np.diff(i) >= 0).all() and d2 == pytest.approx(every[i, j], rel=1e-12, abs=0)
        assert (d2[every[i, j] == 0] == 0).all()
        for n in range(90):
            assert np.sort(d2[i == n])[:k] == pytest.approx(np.sort(every[n])[:k], rel=1e-12, abs=0)

    def test_few_pairs_are_worked_out_from_differences(self, monkeypatch):
        rng = np.random.default_rng(11)
        x, y = rng.normal(size=(400, 32)), rng.normal(size=(600, 32))
        want = np.sort(((x[:, None] - y[None]) ** 2).sum(axis=2), axis=1)[:, :3]
        monkeypatch.setattr(pairwise, "_squares", None)
        i, _, d2 = pairwise._near_pairs(x, y, y[0], np.full(400, np.nan), 3)
        assert len(i) < 2000 and np.array([np.sort(d2[i == n])[:3] for n in range(400)]) == pytest.approx(want)
        i, j, _ = pairwise._near_pairs(x, y, y[0], want[:, 0], 3)
        assert len(i) < 500 and set(range(400)) == set(i)

    def test_neighbours_beside_missing_and_infinite_places(self, spark):
        rng = np.random.default_rng(12)
        x, y = rng.normal(size=(80, 6)), rng.normal(size=(50, 6))
        x[3, 2], x[40, 0], y[7, 1] = np.nan, np.inf, np.nan
        with np.errstate(invalid="ignore"):
            want = np.sort(np.linalg.norm(y[:, None] - x[None], axis=2), axis=1)[:, :79]
        got = pairwise.nearest(vecs(spark, y), vecs(spark, x), 79).orderBy("id", "rank").toPandas()
        assert got["distance"].to_numpy().reshape(50, 79) == pytest.approx(want, nan_ok=True)

    def test_rows_without_ids_are_kept(self, spark):
        x = vecs(spark, [[0.0], [1.0], [5.0]])
        found = pairwise.nearest(x.withColumn("id", F.when(F.col("id") > 0, F.col("id"))), x.filter("id > 0"), 1).collect()
        assert sorted(((r["id"], r["distance"]) for r in found), key=str) == [(1, 0.0), (2, 0.0), (None, 1.0)]

    def test_copies_are_a_privacy_risk(self, spark):
        x = np.random.default_rng(4).normal(size=(50, 4))
        found = pairwise.nndr(vecs(spark, x), vecs(spark, x)).first()
        assert found["nndr"] == pytest.approx(1)
        dcr = pairwise.membership_risk(pairwise.closest_record(vecs(spark, x), vecs(spark, x))).first()
        assert dcr["min_dcr"] == 0 and dcr["membership_inference_risk"] == 1

    def test_one_neighbour_by_hand(self, spark):
        r = pairwise.nndr(vecs(spark, [[0.0], [1.0], [3.0]]), vecs(spark, [[0.0]]), 1).first()
        assert r["synthetic_to_real"] == 1 and r["real_to_real"] == pytest.approx(4 / 3)


class TestUtility:
    def test_metrics(self, spark):
        df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.4), (0, 0, 0.1)], "y int, prediction int, score double")
        assert utility.classification_metrics(df).first().asDict() == {"accuracy": 0.5, "f1": 0.5, "roc_auc": 0.75}
        one = spark.createDataFrame([(0, 0, 0.5)], "y int, prediction int, score double")
        assert utility.classification_metrics(one).first().asDict() == {"accuracy": 1.0, "f1": 0.0, "roc_auc": 0.5}

    def test_nothing_held_out(self, spark):
        df = spark.createDataFrame([(0, [1.0], 1)], "window_id long, x array<double>, y int")
        with pytest.raises(ValueError):
            utility.tstr_benchmark(df, df)

    def test_score(self):
        found = report.realism_score({"ks_tests": {"a": {"p_value": 0.5}, "b": {"p_value": 0.01}}, "mmd": 0.0, "privacy": {"nndr": {"nndr": 2.0}}, "tstr": {"gap": {"accuracy": -0.1}}})
        assert found == pytest.approx((0.5 + 1 + 1 + 0.8) / 4)
        assert report.realism_score({}) is None


def test_full_report(spark, tmp_path):
    names = ["Close", "Volume", "LogReturn"]
    a, b = (windows.create_windows(features.log_returns(bars(spark, 75, seed=s)), 6, names) for s in (1, 2))
    found = report.compute_all_metrics(a, b, names, output_dir=str(tmp_path))
    assert 0 <= found["realism_score"] <= 1 and set(found["tstr"]) == {"trtr", "tstr", "gap"}
    assert json.load(open(tmp_path / "evaluation_report.json"))["ks_tests"].keys() == set(names)


class TestGenerative:
    def test_schedules(self, spark):
        for s in (generative.linear_schedule(spark, 100), generative.cosine_schedule(spark, 100)):
            out = generative.schedule_constants(s).orderBy("t").toPandas()
            assert (out["beta"] > 0).all() and (out["beta"] < 1).all() and (np.diff(out["alpha_bar"]) < 0).all()
            assert out["alpha_bar"].to_numpy() == pytest.approx(np.cumprod(1 - out["beta"]))

    def test_samplers_under_silence(self, spark):
        s = generative.linear_schedule(spark, 50)
        for method in ("ddpm", "ddim"):
            out = generative.diffusion_sample(spark, s, lambda x, t: 0 * x, 5, 4, 3, method, 10).toPandas()
            assert len(out) == 5 and len(out["values"][0]) == 4 and len(out["values"][0][0]) == 3
        with pytest.raises(ValueError):
            generative.diffusion_sample(spark, s, lambda x, t: x, 1, 1, 1, "other")
        with pytest.raises(ValueError):
            generative.ddim_timesteps(10, 11)
        assert generative.ddim_timesteps(10, 3) == [9, 6, 3]

    def test_copulas(self, spark):
        z = np.random.default_rng(5).multivariate_normal([1, 2], [[1, 0.8], [0.8, 1]], 400)
        for kind in ("gaussian", "student_t"):
            made = generative.get_copula(kind, 2).fit(vecs(spark, z)).sample(spark, 2000).toPandas()
            x = np.array(made["v"].tolist())
            assert x.mean(0) == pytest.approx(z.mean(0), abs=0.15) and np.corrcoef(x.T)[0, 1] == pytest.approx(0.8, abs=0.1)
        with pytest.raises(RuntimeError):
            generative.get_copula("gaussian", 2).sample(spark, 1)
        with pytest.raises(ValueError):
            generative.get_copula("other", 2)

    def test_losses(self, spark):
        df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
        out = df.agg(losses.bce_with_logits(F.col("a"), F.lit(True)).alias("l"), losses.kl_divergence(F.col("a"), F.col("b")).alias("k")).first()
        assert out["l"] == pytest.approx(math.log(2)) and out["k"] == 0
        with pytest.raises(ValueError):
            losses.reconstruction(F.col("a"), F.col("b"), "other")

    @pytest.mark.parametrize("kind", ["gru", "lstm"])
    def test_networks(self, spark, kind):
        m = networks.AdversarialModel(5, hidden=6, noise=3, kind=kind)
        x = np.random.default_rng(6).normal(size=(4, 10, 5))
        h = m.embed(x)
        assert h.shape == (4, 10, 6) and (h > 0).all() and (h < 1).all() and m.recover(h).shape == x.shape and m.discriminate(h).shape == (4, 10, 1)
        assert m.generate(spark, 3, 7).count() == 3
        v = networks.VariationalModel(5, kind=kind)
        mu, log_var = v.encode(x)
        assert mu.shape == log_var.shape == (4, 8) and v.decode(mu, 10).shape == x.shape

    def test_reruns_agree(self, spark):
        make = lambda rng, n: rng.standard_normal((n, 2, 1))
        a, b = (sorted(map(str, generative.generate(spark, 10, make, 1, 4).collect())) for _ in range(2))
        assert a == b and len(a) == 10


class TestTraining:
    def test_stopping(self):
        stop = training.EarlyStopping(2)
        assert [stop(x) for x in (1.0, 0.5, 0.6, 0.7)] == [False, False, False, True] and stop.should_stop
        stop.reset()
        assert stop.best is None

    def test_trainer(self):
        saved = []
        best = training.BestCheckpoint(lambda e, m: saved.append(e), "train_loss")
        losses_of = iter([3.0, 2.0, 2.5, 2.6, 9.9])
        history = training.Trainer(lambda b: next(losses_of), callbacks=[best], stopping=training.EarlyStopping(2)).train([0], 5)
        assert history["train_loss"] == [3.0, 2.0, 2.5, 2.6] and saved == [1, 2]

    def test_plateau(self):
        rate = training.PlateauSchedule(1.0, patience=1)
        for e, x in enumerate([1.0, 2.0, 2.0]):
            rate(e, {"val_loss": x})
        assert rate.rate == 0.25


def test_streaming(spark, tmp_path):
    from tickforge.streaming import bars as streams

    rows = bars(spark, 12, tickers=("A", "B")).select("ticker", "Date", (F.col("Close") * F.when(F.dayofmonth("Date") % 3 == 0, 2).otherwise(1)).alias("Close"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_continuity(stream).writeStream.format("memory").queryName("fixed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("fixed").orderBy("ticker", "Date").toPandas()
    want = constraints.enforce_price_continuity(rows).orderBy("ticker", "Date").toPandas()
    assert got["Close"].tolist() == pytest.approx(want["Close"].tolist())


def test_streaming_sorts_across_chunks(spark, tmp_path):
    """More unordered rows of a ticker in a micro-batch than an Arrow chunk holds, then late ones."""
    from tickforge.streaming import bars as streams

    n = 25_000
    at = F.timestamp_seconds(1_600_000_000 + 60 * F.col("id"))
    rows = spark.range(n).select(F.lit("A").alias("ticker"), at.alias("Date"), (100 + 50 * F.sin(F.col("id") / 7.0) * F.pmod(F.col("id"), F.lit(3))).alias("Close"))
    rows.orderBy(F.xxhash64("Date")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(name, made):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name).orderBy("Date").toPandas()

    got = run("many", streams.stream_continuity(stream))
    assert got["Close"].tolist() == pytest.approx(constraints.enforce_price_continuity(rows).orderBy("Date").toPandas()["Close"].tolist())
    assert run("smooth", streams.stream_ema(stream, 0.1))["EMA"].tolist() == pytest.approx(rows.orderBy("Date").toPandas()["Close"].ewm(alpha=0.1, adjust=False).mean().tolist())
    late = rows.filter("Date = timestamp_seconds(1600000600)").union(rows.select("ticker", (F.col("Date") + F.expr("INTERVAL 100 DAYS")).alias("Date"), "Close").limit(1))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    again = run_again(spark, streams.stream_continuity(stream), "late", str(tmp_path / "many"))
    assert again["Close"].isna().tolist() == [True, False]


def run_again(spark, made, name, checkpoint):
    """The next batch of a query that goes on from its checkpoint."""
    out = []
    q = made.writeStream.foreachBatch(lambda df, _: out.append(df.orderBy("Date").toPandas())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out[-1]


@pytest.mark.parametrize("parts", [2, 4, 256])
def test_running_sums_and_percentiles(spark, parts):
    from tickforge.operators import ordered

    rng = np.random.default_rng(0)
    made = [(k, float(x)) for k in "ab" for x in np.round(rng.normal(size=300), 1)] + [("c", 1.0), ("d", None)]
    rows = spark.createDataFrame(made, "k string, x double").repartition(3)
    counts = rows.dropna().groupBy("k", "x").agg(F.count("*").alias("n"))
    got = {(r["k"], r["x"]): r["n_before"] for r in ordered.running(counts, ["k"], "x", ["n"], parts).collect()}
    assert got == {(k, x): sum(1 for j, y in made if j == k and y is not None and y < x) for k, x in set(made) if x is not None}
    found = {r["k"]: r["q"] for r in ordered.percentiles(rows, ["k"], "x", [0.0, 0.05, 0.5, 0.9, 1.0]).collect()}
    assert set(found) == set("abc")
    for k, q in found.items():
        assert q == pytest.approx(np.percentile([x for j, x in made if j == k], [0, 5, 50, 90, 100]).tolist())
    assert ordered.percentiles(rows.limit(0), [], "x", [0.5]).count() == 0


def test_tail_split(spark):
    made = [(w, t) for w in range(10) for t in "abc"]
    rows = spark.createDataFrame(made, "window_id long, ticker string").repartition(4)
    for ratio in (0.1, 0.2, 0.35, 0.9):
        train, test = (sorted(map(tuple, x.collect())) for x in utility.tail_split(rows, ratio))
        held = int(30 * ratio)
        assert train == sorted(made)[: 30 - held] and test == sorted(made)[30 - held :]
    with pytest.raises(ValueError):
        utility.tail_split(rows, 0.01)


def test_exact_ks_tail():
    """All orders of two samples, counted."""
    import itertools

    from tickforge.functions import special

    for n, m in ((3, 4), (5, 5), (1, 3), (6, 4)):
        distances = []
        for chosen in itertools.combinations(range(n + m), n):
            i = np.cumsum([k in chosen for k in range(n + m)])
            distances.append(np.abs(i / n - (np.arange(1, n + m + 1) - i) / m).max())
        for d in {0.0, *distances}:
            assert special.exact_ks_tail(d, n, m) == pytest.approx(np.mean(np.array(distances) >= d - 1e-9))
    assert special.exact_ks_tail(0.03, 5000, 4000) == pytest.approx(special.kolmogorov_tail(0.03 * (5000 * 4000 / 9000) ** 0.5), abs=0.003)


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers()), st.dictionaries(st.text(max_size=3), st.integers()))
def test_merge_prefers_the_right(a, b):
    assert files.merge_configs(a, b) == {**a, **b}


def test_strided_timesteps_are_the_sampler_s(spark):
    counts = [1, 2, 3, 7, 10, 33, 50, 99, 100]
    rows = spark.createDataFrame([(c,) for c in counts], "c int").select("c", generative.strided_timesteps(100, F.col("c")).alias("t")).collect()
    assert {r["c"]: r["t"] for r in rows} == {c: generative.ddim_timesteps(100, c) for c in counts}


@pytest.mark.parametrize("method, eta", [("ddpm", 0.0), ("ddim", 0.0), ("ddim", 0.7)])
def test_reverse_step_of_columns(spark, method, eta):
    rng = np.random.default_rng(8)
    made = [(t, *rng.normal(size=(3, 5)).tolist()) for t in range(20)]
    constants = generative.schedule_constants(generative.linear_schedule(spark, 20))
    table = {r["t"]: r for r in constants.collect()}
    rows = spark.createDataFrame(made, "t int, x array<double>, noise array<double>, z array<double>")
    got = {r["t"]: r["x_prev"] for r in generative.reverse_step(rows, constants, method, eta).collect()}
    for t, x, noise, z in made:
        c, (x, noise, z) = table[t], map(np.array, (x, noise, z))
        want = generative.ddpm_step(x, noise, c["beta"], c["alpha_bar"], c["posterior_variance"], z) if method == "ddpm" else generative.ddim_step(x, noise, c["alpha_bar"], c["alpha_bar_prev"], eta, z)
        assert got[t] == pytest.approx(want.tolist())


def test_normal_denoiser_gives_back_the_moments(spark):
    schedule = generative.linear_schedule(spark, 1000)
    bars = [r[0] for r in generative.schedule_constants(schedule).orderBy("t").select("alpha_bar").collect()]
    means, stds = np.array([-0.5, 1.0]), np.array([0.4, 1.5])
    out = generative.diffusion_sample(spark, schedule, generative.normal_denoiser(means, stds, bars), 2000, 1, 2).toPandas()
    x = np.array([[list(step) for step in v] for v in out["values"]])[:, 0]
    assert x.mean(axis=0) == pytest.approx(means, abs=0.1) and x.std(axis=0) == pytest.approx(stds, rel=0.1)
