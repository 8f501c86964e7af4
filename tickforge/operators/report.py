"""The whole comparison of two window sets, and the realism score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators import pairwise, profiles, stats, utility, windows
from tickforge.sources.files import save_report
from tickforge.sources.shared import stored


def realism_score(report: dict) -> float | None:
    """Mean of the terms present: KS pass rate, exp(-MMD), accuracy gap, neighbour ratio."""
    terms = []
    if tests := report.get("ks_tests"):
        terms.append(sum(t["p_value"] > 0.05 for t in tests.values()) / len(tests))
    if report.get("mmd") is not None:
        terms.append(math.exp(-report["mmd"]))
    if gap := report.get("tstr", {}).get("gap"):
        terms.append(max(0.0, 1 - 2 * abs(gap["accuracy"])))
    if (ratio := report.get("privacy", {}).get("nndr", {}).get("nndr")) is not None:
        terms.append(min(1.0, ratio))
    return sum(terms) / len(terms) if terms else None


_SIDES = ("real", "synthetic")
#: Neighbours of the distance ratio.
NEIGHBOURS = 5


def _series_metrics(real: DataFrame, synthetic: DataFrame, lengths: tuple[int, int], columns: list[str], returns: str, volume: str, real_volume: bool) -> tuple[dict, dict]:
    """(facts by side, tests, autocorrelations and correlations) of both sets of windows as two long series."""

    def side(w: DataFrame, name: str, length: int) -> DataFrame:
        r = F.col(returns).cast("double")
        values = [*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)], r.alias("_r"), F.col(volume).cast("double").alias("_volume"), F.abs(r).alias("_vol")]
        return w.select(F.lit(name).alias("feature"), (F.col("window_id") * length + F.col("step")).alias("idx"), *values)

    a, b = (side(w, name, k) for w, name, k in zip((real, synthetic), _SIDES, lengths, strict=True))
    if real_volume:
        lent = a.select("idx", "_volume", "_vol", F.lit(True).alias("_paired"))
        b = b.drop("_volume", "_vol").join(lent, "idx", "left").withColumn("_r", F.when(F.col("_paired"), F.col("_r"))).select(*a.columns)
    names = [f"x{k}" for k in range(len(columns))]
    rows = stored(a.unionByName(b), "report-series")

    # places of the columns are tested; -1 and -2 are volume and volatility of rows that have both, for ranks
    both = F.col("_volume").isNotNull() & F.col("_vol").isNotNull()
    each = [F.struct(F.lit(k).alias("k"), F.col(c).alias("x")) for k, c in enumerate(names)] + [F.struct(F.lit(k).alias("k"), F.when(both, F.col(c)).alias("x")) for k, c in ((-1, "_volume"), (-2, "_vol"))]
    tagged = rows.select((F.col("feature") == _SIDES[0]).cast("int").alias("r"), F.explode(F.array(*each)).alias("v")).select("r", F.col("v.k").alias("feature"), F.col("v.x").alias("x"))
    run = stored(stats.paired_counts(tagged, ["feature"]), "report-counts")
    report: dict = {"ks_tests": {columns[k]: v for k, v in sorted(stats.with_p_values(stats.largest_gap(run.filter("feature >= 0"))).items())}}

    ranks = F.explode(F.array(*[F.struct(F.lit(s).alias("feature"), F.col(c).alias("n"), (F.col(f"{c}_before") + (F.col(c) + 1) / 2).alias("_rank")) for s, c in zip(_SIDES, "rs", strict=True)]))
    named = F.when(F.col("feature") == -1, "_volume").otherwise("_vol")
    counts = run.filter("feature < 0").select(named.alias("_c"), F.col("x").alias("_x"), ranks.alias("k")).select("k.feature", "_c", "_x", "k._rank", "k.n").filter("n > 0").drop("n")
    ranked = stats.average_ranks(rows.select("feature", "_volume", "_vol"), {"_volume": "_a", "_vol": "_b"}, counts)
    spearman = ranked.groupBy("feature").agg(stats.pearson("_a", "_b").alias("spearman"), F.count("*").alias("n"))
    every = profiles.profile(rows, names, returns="_r", volume="_volume", volatility="_vol").join(spearman, "feature", "left")
    found = {row["feature"]: row.asDict() for row in every.collect()}  # a row a side
    if len(found) < 2:
        raise ValueError("both sets need windows")

    ours, theirs = (found[s] for s in _SIDES)
    gap = lambda x, y: None if x is None or y is None else x - y
    report["acf"] = {}
    for c, x, y in zip(columns, ours["acf"], theirs["acf"], strict=True):
        gaps = [abs(g) for g in map(gap, x, y) if g is not None]
        report["acf"][c] = {"real_acf": x, "synthetic_acf": y, "mae": sum(gaps) / len(gaps)}
    signed = [[gap(x, y) for x, y in zip(p, q, strict=True)] for p, q in zip(ours["corr"], theirs["corr"], strict=True)]
    report["cross_correlation"] = {
        "real_corr": ours["corr"],
        "synthetic_corr": theirs["corr"],
        "diff": [[None if g is None else abs(g) for g in row] for row in signed],
        "frobenius_norm": math.sqrt(sum((g or 0.0) ** 2 for row in signed for g in row)),
    }
    return found, report


def compute_all_metrics(
    real: DataFrame,
    synthetic: DataFrame,
    columns: list[str],
    returns: str = "LogReturn",
    volume: str = "Volume",
    output_dir: str | None = None,
    run_tstr: bool = True,
    synthetic_uses_real_volume: bool = False,
) -> dict:
    """Everything about windows (ticker, window_id, step, columns), series one after the other in order of ticker.

    Both inputs are written once. Tests, autocorrelations, correlations and facts come from three passes over one table
    of both series: counted values, moments, lagged products. Columns are found by name. With
    ``synthetic_uses_real_volume`` synthetic returns are paired with real volume and volatility
    by place, as far as both reach.
    """
    real, synthetic = (stored(windows.number(w), f"report-{k}") for k, w in enumerate((real, synthetic)))
    n, length, _ = windows.shape(real)
    m, length2, _ = windows.shape(synthetic)
    found, report = _series_metrics(real, synthetic, (length, length2), columns, returns, volume, synthetic_uses_real_volume)
    arrays = [windows.as_arrays(w, columns) for w in (real, synthetic)]
    v = [stored(windows.flat_vectors(a).select(F.col("window_id").alias("id"), "v"), "report-vectors") for a in arrays]
    # one set of cells for the kernel and both searches; the nearest of the searched ones is the closest record
    x, y = pairwise.in_cells(*v)
    report["mmd"] = pairwise.mmd_of_cells(x, y)["mmd"]
    report |= {f"stylized_facts_{side}": stats.facts_of(found.get(side, {})) for side in _SIDES}
    near = pairwise.neighbours(y, x, NEIGHBOURS + 1)[0]
    closest = near.filter("rank = 1").select("id", F.col("distance").alias("dcr"))
    report["privacy"] = {
        "nndr": pairwise.nndr_of_cells(x, near, NEIGHBOURS).first().asDict(),
        "membership_inference": pairwise.membership_risk(closest).first().asDict(),
    }
    if run_tstr and n > 50 and m > 50:
        at = columns.index(returns)
        report["tstr"] = utility.tstr_benchmark(*[windows.classification(a, at) for a in arrays])
    report["realism_score"] = realism_score(report)
    if output_dir:
        save_report(report, output_dir)
    return report
