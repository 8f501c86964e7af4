"""Shared passes give what one pass a statistic gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.operators import profiles, report, stats, windows


def table(spark, lengths=(137, 60), constant=False):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate(lengths):
        r = rng.normal(size=n) * np.repeat(rng.uniform(0.5, 2, n // 10 + 1), 10)[:n]
        for i in range(n):
            volume = None if i % 11 == 3 else float(rng.integers(1, 9))
            rows.append((f"s{k}", i, 4.25 if constant else 100 + float(rng.normal()), float(r[i]), volume, abs(float(r[i]))))
    return spark.createDataFrame(rows, "feature string, idx long, Volume2 double, r double, volume double, vol double")


@pytest.mark.parametrize("block", [25, 100_000])
def test_profile_equals_separate_statistics(spark, block):
    rows = table(spark)
    found = {x["feature"]: x.asDict() for x in profiles.profile(rows, ["Volume2", "r"], 20, 10, block=block).collect()}
    for place, c in enumerate(["Volume2", "r"]):
        for x in stats.acf(rows.select("feature", "idx", F.col(c).alias("x")), 20).collect():
            assert found[x["feature"]]["acf"][place][x["lag"]] == pytest.approx(x["acf"], abs=1e-12)
    series = rows.select("feature", "idx", F.col("r").alias("x"))
    parts = [stats.fat_tails(series), stats.volatility_clustering(series), stats.leverage_effect(rows)]
    for part in parts:
        for x in part.collect():
            for name, value in x.asDict().items():
                assert found[x["feature"]][name] == (pytest.approx(value, abs=1e-10) if not isinstance(value, (str, bool)) else value)
    for feature, x in found.items():
        one = rows.filter(F.col("feature") == feature)
        for cell in stats.correlations(one, ["Volume2", "r"]).collect():
            assert x["corr"][["Volume2", "r"].index(cell["i"])][["Volume2", "r"].index(cell["j"])] == pytest.approx(cell["corr"], abs=1e-12)
        assert x["pearson"] == pytest.approx(one.agg(stats.pearson("volume", "vol")).first()[0], abs=1e-12)


def test_constant_and_short_series(spark):
    constant = profiles.profile(table(spark, constant=True), ["Volume2"]).collect()
    assert all(x["corr"] == [[None]] and x["acf"][0][0] == 1.0 for x in constant)
    short = profiles.profile(table(spark, (4,)), ["r"]).first()
    assert short["acf"][0][4:] == [None] * 17 and short["acf"][0][3] is not None
    assert short["correlations"][3:] == [None] * 7
    flat = table(spark, (40,)).withColumns({"r": F.lit(0.1), "vol": F.lit(0.1)})
    assert profiles.profile(flat, []).first()["mean_leverage_corr"] is None
    assert profiles.profile(table(spark).limit(0), ["r"]).count() == 0


def test_report_equals_separate_statistics(spark):
    names = ["Close", "Volume", "LogReturn"]
    rng = np.random.default_rng(3)

    def made(shift, count):
        rows = [(t, w, s, float(rng.normal(shift)), float(rng.integers(1, 6)), float(rng.normal())) for t in "AB" for w in range(count) for s in range(5)]
        return spark.createDataFrame(rows, "ticker string, window_id long, step int, Close double, Volume double, LogReturn double")

    a, b = made(0, 14), made(0.5, 11)
    found = report.compute_all_metrics(a, b, names, run_tstr=False)
    lent = report.compute_all_metrics(a, b, names, run_tstr=False, synthetic_uses_real_volume=True)
    a, b = windows.number(a), windows.number(b)
    r, s = (stats.long_series(w, names, 5) for w in (a, b))
    assert found["ks_tests"] == {k: pytest.approx(v) for k, v in stats.ks_test(r, s).items()}
    for x in stats.acf_comparison(r, s).collect():
        assert found["acf"][x["feature"]]["real_acf"] == pytest.approx(x["real_acf"], abs=1e-12)
        assert found["acf"][x["feature"]]["mae"] == pytest.approx(x["mae"], abs=1e-12)
    assert found["cross_correlation"]["frobenius_norm"] == pytest.approx(stats.frobenius(stats.cross_correlation(a, b, names)).first()[0])
    at = (F.col("window_id") * 5 + F.col("step")).alias("idx")
    vol = F.abs("LogReturn").alias("vol")
    rows = [w.select(at, F.col("LogReturn").alias("r"), F.col("Volume").alias("volume"), vol) for w in (a, b)]
    for side, part in zip(("real", "synthetic"), rows):
        for fact, values in stats.stylized_facts(part).items():
            for name, value in values.items():
                assert found[f"stylized_facts_{side}"][fact][name] == (pytest.approx(value, abs=1e-10) if not isinstance(value, bool) else value)
    own = stats.stylized_facts(rows[1].select("idx", "r").join(rows[0].select("idx", "volume", "vol"), "idx"))
    for name in ("pearson", "spearman", "spearman_p"):
        assert lent["stylized_facts_synthetic"]["volume_volatility"][name] == pytest.approx(own["volume_volatility"][name])
    assert lent["stylized_facts_synthetic"]["leverage_effect"]["correlations"] == pytest.approx(own["leverage_effect"]["correlations"])
