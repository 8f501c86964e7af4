"""Quality rules by robust multivariate outliers: minimum covariance determinant (MCD).

Per document a vector of transformed text statistics is formed. Per (language, source)
group the location and scatter are those of the half of its documents with the least
covariance determinant. Four deterministic starts (medians with scaled median absolute
deviations, and these with the correlations of hyperbolic tangents, of signs and of spatial
signs) take concentration steps until their determinants no longer fall, and the least one
stays. Documents whose squared Mahalanobis distance exceeds the chi-square quantile with
``TAIL`` above it are rejected.

Scale: texts are read once, for the statistics; concentration steps run over the narrow
table of statistics, all starts of all groups at once, and only those that still fall. Every
quantile is the edge of a histogram bin (pre-aggregated before the shuffle), so that no task
gathers a group. What is joined to the rows is one row per group and start.

Defined results: null or empty text has no words and fails the base rule. Null language
or source is a group value of its own. Groups of fewer than ``min_group`` usable rows have
no estimate of their own: they are pooled by language, and then over all. Repeated rows
count as often as they occur. Extra columns are not looked at. Empty tables give empty
results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm.common import whole_row, written

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
MIN_GROUP = 40
#: Least standard deviation of each statistic: what no document is rejected for. That of
#: symbols is what one symbol adds to a text of 20 words, log1p(1 / 40).
FLOORS = (0.05, 0.025, 0.1, 0.06)
P = len(FLOORS)
STARTS = 4
#: Bins of an octave of distance, and how much a log-determinant must fall for a start to go on.
BINS = 256
LEAST_FALL = 1e-6
#: Half of a small group understates its scatter: of simulated normal groups of 300 the cut
#: for 1e-5 rejects about one document in ten thousand.
TAIL = 1e-5
#: Rows of group parameters up to which they are broadcast; beyond, an ordinary join.
BROADCAST_GROUPS = 50_000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def chi2_upper(tail: float) -> float:
    """The chi-square quantile of 4 degrees of freedom with ``tail`` above it."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.exp(-mid / 2) * (1 + mid / 2) > tail else (low, mid)
    return high


CUTOFF = chi2_upper(TAIL)
MEDIAN = chi2_upper(0.5)


def repeat_words(words: list[bytes]) -> int:
    """Words in 5-word windows that occur at least twice."""
    n = len(words)
    if n < 6:
        return 0
    v = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    h = v[: n - 4].copy()
    with np.errstate(over="ignore"):
        for k in range(1, 5):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += v[k : n - 4 + k]
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1).tolist()
    windows = [tuple(words[i : i + 5]) for i in at]  # equal hashes are only candidates
    times = Counter(windows)
    edge = np.zeros(n + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if times[w] > 1:
            edge[i] += 1
            edge[i + 5] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for texts in batches:
        yield pd.DataFrame([text_statistics(x) for x in texts], columns=names)


def statistics(text: Column) -> Column:
    """A struct of the base statistics of whole texts."""
    # not to be copied below a filter on its result, which would read each text twice
    return pandas_udf(_statistics, STATS).asNondeterministic()(text)


def features(s: str) -> list[Column]:
    """Transformed statistics, each drawn towards its usual value where the text is short."""
    n = F.col(f"{s}.n_words")
    return [
        F.log((F.col(f"{s}.word_chars") + 100) / (n + 20.0)),
        F.log1p(F.col(f"{s}.n_symbols") / (n + 20.0)),
        F.col(f"{s}.n_dup_lines") / (F.col(f"{s}.n_lines") + 3.0),
        F.col(f"{s}.n_repeat_words") / (n + 20.0),
    ]


def base_failed(s: str) -> Column:
    n = F.col(f"{s}.n_words")
    return (n < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * n)


def _few(params: DataFrame, times: int = 1) -> bool:
    """Whether ``times`` as many rows as there are may be broadcast."""
    return params.limit(BROADCAST_GROUPS + 1).count() * times <= BROADCAST_GROUPS


def _joined(rows: DataFrame, params: DataFrame, key: str | list[str], few: bool, how: str = "inner") -> DataFrame:
    """Rows with their group's parameters; broadcast only when counted to be few."""
    return rows.join(F.broadcast(params) if few else params, key, how)


def _key(lang: Column, source: Column) -> Column:
    mark = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    return F.concat_ws("\x01", mark(lang), mark(source))


def groups(counted: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Which estimate each (key) uses: its own, its language's small groups', or all small ones'."""
    small = F.when(F.col("_n") < min_group, F.col("_n"))
    pooled = counted.groupBy(F.col("_lang").alias("_pooled")).agg(F.sum(small).alias("_pool"))
    return counted.join(pooled, F.col("_lang").eqNullSafe(F.col("_pooled")), "left").select(
        "_key",
        F.when(F.col("_n") >= min_group, F.concat(F.lit("g"), "_key"))
        .when(F.col("_pool") >= min_group, F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("v"), "_lang"), F.lit("n"))))
        .otherwise(F.lit("all"))
        .alias("_grp"),
    )


def _half_bins(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the first bin at which half of the rows is reached."""
    w = Window.partitionBy(*keys)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    run = counts.select(*keys, "_bin", F.sum("_c").over(w.orderBy("_bin")).alias("_up"), F.sum("_c").over(w).alias("_all"))
    return run.filter(2 * F.col("_up") >= F.col("_all")).groupBy(*keys).agg(F.min("_bin").alias("_bin"))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Per group the medians of ``values`` to 1/512, as m0, m1, ..."""
    long = rows.select("_grp", F.posexplode(F.array(*[F.floor(v * 512) for v in values])).alias("_j", "_bin"))
    mid = _half_bins(long, ["_grp", "_j"])
    return mid.groupBy("_grp").agg(*[F.max(F.when(F.col("_j") == j, (F.col("_bin") + 0.5) / 512)).alias(f"m{j}") for j in range(P)])


def _start_moments(rows: DataFrame) -> DataFrame:
    """Per group what the starts' correlations are made of; ``rows`` have medians m0.. and deviations s0.. too."""
    z = [(F.col(f"f{j}") - F.col(f"m{j}")) / F.greatest(1.4826 * F.col(f"s{j}"), F.lit(FLOORS[j])) for j in range(P)]
    rows = rows.select("_grp", *[x.alias(f"z{j}") for j, x in enumerate(z)])
    z = [F.col(f"z{j}") for j in range(P)]
    norm, t, pairs = sum((x * x for x in z), F.lit(0.0)), [F.tanh(x) for x in z], [(i, j) for i in range(P) for j in range(P)]
    return rows.groupBy("_grp").agg(
        F.count("*").alias("_n"),
        F.array(*[F.sum(x) for x in t]).alias("_t"),
        F.array(*[F.sum(t[i] * t[j]) for i, j in pairs]).alias("_tt"),
        F.array(*[F.sum(F.signum(z[i]) * F.signum(z[j])) for i, j in pairs]).alias("_signs"),
        F.array(*[F.coalesce(F.sum(F.try_divide(z[i] * z[j], norm)), F.lit(0.0)) for i, j in pairs]).alias("_spatial"),
    )


PARAMS = "_grp string, _start int, _mean array<double>, _inv array<double>, _logdet double, _active boolean"


def _correlation(scatter: np.ndarray) -> np.ndarray:
    """Scaled to a diagonal of 1, and to no eigenvalue below 0.01."""
    size = np.sqrt(np.maximum(np.diag(scatter), 0.0))  # rounding may leave less than nothing
    r = scatter / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))
    np.fill_diagonal(r, 1.0)
    values, vectors = np.linalg.eigh(np.clip(np.nan_to_num((r + r.T) / 2), -1, 1))
    return (vectors * np.maximum(values, 0.01)) @ vectors.T


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The starts of each group."""
    for part in batches:
        out = []
        for r in part.to_dict("records"):
            n, square = r["_n"], lambda x: np.array(x, float).reshape(P, P)
            mean, scale = [r[f"m{j}"] for j in range(P)], np.array([1.4826 * r[f"s{j}"] for j in range(P)])
            t = np.array(r["_t"]) / n
            correlations = (np.eye(P), _correlation(square(r["_tt"]) / n - np.outer(t, t)), _correlation(np.sin(np.pi / 2 * square(r["_signs"]) / n)), _correlation(square(r["_spatial"])))
            for k, c in enumerate(correlations):
                scatter = c * np.outer(scale, scale) + np.diag(np.square(FLOORS))
                out.append((r["_grp"], k, mean, np.linalg.inv(scatter).ravel().tolist(), math.inf, True))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PARAMS.split(", ")])


def _concentrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean and inverse scatter (floors added) of each start's half, if its determinant is less than before."""
    for part in batches:
        out = []
        for r in part.to_dict("records"):
            s, ss = np.array(r["_s"]), np.array(r["_ss"]).reshape(P, P)
            mean = s / r["_n"]
            cov = ss / r["_n"] - np.outer(mean, mean)
            cov = (cov + cov.T) / 2 + np.diag(np.square(FLOORS))
            logdet = float(np.linalg.slogdet(cov)[1])
            if logdet < r["_logdet"] - LEAST_FALL:
                out.append((r["_grp"], r["_start"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(), logdet, True))
            else:
                out.append((r["_grp"], r["_start"], list(r["_mean"]), list(r["_inv"]), r["_logdet"], False))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PARAMS.split(", ")])


def distance(mean: str = "_mean", inverse: str = "_inv") -> Column:
    """Squared Mahalanobis distance of the vector f0, f1, ..."""
    d = [F.col(f"f{i}") - F.col(mean)[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + d[i] * d[j] * F.col(inverse)[i * P + j] * (1.0 if i == j else 2.0)
    return total


def _bin_of(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BINS)


def fit(narrow: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """Robust estimates from rows (_lang, _key, f0..): (key -> group) and (group -> mean, inverse, scale, log-determinant)."""
    counted = narrow.groupBy("_lang", "_key").agg(F.count("*").alias("_n"))
    of = written(groups(counted, min_group), "mcd-groups")
    few = _few(of, STARTS)
    f = [f"f{j}" for j in range(P)]
    rows = _joined(narrow, of, "_key", few).select("_grp", *f)
    center = written(_medians(rows, [F.col(x) for x in f]), "mcd-center")
    spread = _medians(_joined(rows, center, "_grp", few), [F.abs(F.col(f"f{j}") - F.col(f"m{j}")) for j in range(P)])
    spread = spread.select("_grp", *[F.col(f"m{j}").alias(f"s{j}") for j in range(P)])
    middle = written(center.join(spread, "_grp"), "mcd-spread")
    begun = _start_moments(_joined(rows, middle, "_grp", few)).join(middle, "_grp")
    params = written(begun.mapInPandas(_begin, PARAMS), "mcd-start")
    key = ["_grp", "_start"]
    while params.filter("_active").limit(1).count():
        mine = params.filter("_active").select(*key, "_mean", "_inv")
        far = _joined(rows, mine, "_grp", few).select(*key, *f, _bin_of(distance()).alias("_bin"))
        half = written(_half_bins(far.select(*key, "_bin"), key).withColumnRenamed("_bin", "_cut"), "mcd-half")
        near = _joined(far, half, key, few).filter(F.col("_bin") <= F.col("_cut"))
        moments = near.groupBy(*key).agg(
            F.count("*").alias("_n"),
            F.array(*[F.sum(x) for x in f]).alias("_s"),
            F.array(*[F.sum(F.col(x) * F.col(y)) for x in f for y in f]).alias("_ss"),
        )
        step = moments.join(params.filter("_active"), key).mapInPandas(_concentrate, PARAMS)
        params = written(params.filter("NOT _active").unionByName(step), "mcd-step")
    best = params.groupBy("_grp").agg(F.min(F.struct("_logdet", "_start", "_mean", "_inv")).alias("_b"))
    best = written(best.select("_grp", "_b._mean", "_b._inv", "_b._logdet"), "mcd-best")
    half = _half_bins(_joined(rows, best, "_grp", few).select("_grp", _bin_of(distance()).alias("_bin")), ["_grp"])
    # the half's radius against that of a normal distribution; never below 1, for the floors
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("_bin") + 1) / float(BINS)) / MEDIAN)
    return of, written(best.join(half, "_grp").select("_grp", "_mean", "_inv", scale.alias("_scale"), "_logdet"), "mcd")


def with_statistics(docs: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """``docs`` with _s (statistics), _lang, _key and the vector f0.."""
    out = docs.withColumns({"_s": statistics(text), "_lang": lang.cast("string"), "_key": _key(lang, source)})
    return out.withColumns({f"f{j}": f for j, f in enumerate(features("_s"))} | {"_failed": base_failed("_s")})


def judged(rows: DataFrame, of: DataFrame, params: DataFrame, tail: float = TAIL) -> DataFrame:
    """Rows of ``with_statistics`` with _d2 (null: no estimate) and _kept."""
    per_key = of.join(params, "_grp").select("_key", "_mean", "_inv", "_scale")
    out = _joined(rows, per_key, "_key", _few(of), "left").withColumn("_d2", distance() / F.col("_scale"))
    return out.withColumn("_kept", ~F.col("_failed") & F.coalesce(F.col("_d2") <= chi2_upper(tail), F.lit(True)))


def narrow_rows(docs: DataFrame, *ids: str) -> DataFrame:
    """The statistics without the texts, as a table: the only pass over texts that fitting takes."""
    lean = docs.select(*ids, "text", "lang", "source")
    lean = with_statistics(lean, F.col("text"), F.col("lang"), F.col("source")).drop("text", "lang", "source")
    return written(lean, "quality-statistics")


def assess(docs: DataFrame, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, kept and the squared distance."""
    narrow = narrow_rows(docs, "doc_id")
    of, params = fit(narrow.filter(~F.col("_failed")), min_group)
    return judged(narrow, of, params, tail).select(
        "doc_id",
        *[F.col(f"_s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_d2").alias("distance2"),
    )


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """``docs`` without the rejected ones, columns unchanged. Texts are read twice and never shuffled."""
    of, params = fit(narrow_rows(docs).filter(~F.col("_failed")), min_group)
    held = docs.select(whole_row(docs))
    rows = with_statistics(held, F.col("_doc.text"), F.col("_doc.lang"), F.col("_doc.source"))
    return judged(rows, of, params, tail).filter("_kept").select("_doc.*")
