"""Train on synthetic, test on real; binary classification metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators import ordered
from tickforge.sources.shared import new_path

#: Rows whose part of the Gram matrix is computed together.
_ROWS = 2048


def classification_metrics(rows: DataFrame) -> DataFrame:
    """(accuracy, f1, roc_auc) of rows (y, prediction, score).

    F1 is 0 where it isn't defined. The area is exact, by average ranks over distinct scores,
    and 0.5 if only one class is there.
    """

    def total(c: Column) -> Column:
        return F.sum(c.cast("long"))

    y, p = F.col("y") == 1, F.col("prediction") == 1
    hits = rows.agg(total(y & p).alias("tp"), total(p).alias("pp"), total(y).alias("pos"), F.count("*").alias("n"), F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("accuracy"))
    scores = rows.groupBy("score").agg(total(y).alias("pos"), F.count("*").alias("c"))
    ranked = ordered.running(scores, [], "score", ["c"])
    ranks = ranked.withColumn("rank", F.col("c_before") + (F.col("c") + 1) / 2).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    auc = F.coalesce(F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, pos * neg), F.lit(0.5))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("pp") + pos), F.lit(0.0))
    return hits.crossJoin(F.broadcast(ranks)).select("accuracy", f1.alias("f1"), auc.alias("roc_auc"))


def _normal_equations(weights: np.ndarray):
    """Per task: the rows of X'WX with X'(p - y) beside them, and the loss, at ``weights`` (the last one the intercept)."""
    width = len(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, gradient, loss = np.zeros((width, width)), np.zeros(width), 0.0
        for part in batches:
            for k in range(0, len(part), _ROWS):
                some = part.iloc[k : k + _ROWS]
                x = np.column_stack([np.stack(some["x"].to_numpy()), np.ones(len(some))])
                y = some["y"].to_numpy(float)
                z = x @ weights
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                gram += (x * (p * (1 - p))[:, None]).T @ x
                gradient += x.T @ (p - y)
                loss += float((np.logaddexp(0, z) - y * z).sum())
        rows = np.column_stack([gram, gradient])
        yield pd.DataFrame({"i": np.arange(width + 1), "v": [*rows, np.array([loss])]})

    return run


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [part["i"].iloc[0]], "v": [np.sum(np.stack(part["v"].to_numpy()), axis=0)]})


def fit_logistic(rows: DataFrame, strength: float = 1.0, tolerance: float = 1e-8, most: int = 100) -> tuple[np.ndarray, float, list[float]]:
    """(coefficients, intercept, gradient norms) of a logistic regression of y on arrays x, by Newton steps.

    The summed loss and ``strength`` / 2 times the squared coefficients are least there. Each step sums
    the Gram matrix over tasks; the driver solves a system as large as a row is wide. A step that doesn't
    lower the loss is halved. If all rows are of one class, the model says so and nothing else.
    """
    first = rows.select("x").limit(1).collect()
    if not first:
        raise ValueError("no training rows")
    width = len(first[0][0])
    n, ones = rows.agg(F.count("*"), F.sum(F.col("y").cast("long"))).first()
    if ones in (0, n):
        return np.zeros(width), np.inf if ones else -np.inf, [0.0]
    penalty = np.append(np.full(width, strength), 0.0)
    w, step, best, norms = np.zeros(width + 1), np.zeros(width + 1), np.inf, []
    for _ in range(most):
        found = rows.select("x", "y").mapInPandas(_normal_equations(w), "i int, v array<double>").groupBy("i").applyInPandas(_summed, "i int, v array<double>")
        parts = dict(map(tuple, found.collect()))  # as many rows as a row is wide
        loss = parts[width + 1][0] + float(penalty @ w**2) / 2
        if loss > best + 1e-9 * abs(best):
            step /= 2
            w = w - step
            continue
        best = loss
        system = np.array([parts[i] for i in range(width + 1)])
        gradient = system[:, -1] + penalty * w
        norms.append(float(np.linalg.norm(gradient)))
        if norms[-1] < tolerance:
            break
        step = -np.linalg.lstsq(system[:, :-1] + np.diag(penalty), gradient, rcond=None)[0]
        w = w + step
    return w[:-1], float(w[-1]), norms


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the shared folder, dealt to as many files as there are cores at least."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _fitted_metrics(train: DataFrame, test: DataFrame) -> dict[str, float]:
    """A logistic regression (L2, C = 1) on standardised features, judged on ``test``."""
    each = train.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = {r["k"]: (r["m"], r["s"] or 1.0) for r in each.collect()}  # one row a feature
    if not stats:
        raise ValueError("no training rows")
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    mean, dev = (numbers([stats[k][i] for k in sorted(stats)]) for i in (0, 1))

    def scaled(rows: DataFrame) -> DataFrame:
        z = F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), dev, lambda a, b: a / b)
        return rows.select(z.alias("x"), F.col("y").cast("double").alias("y"))

    weights, intercept, _ = fit_logistic(_written(scaled(train), "training-rows"))
    z = F.aggregate(F.zip_with("x", numbers(weights), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(intercept)
    out = scaled(test).select("y", z.alias("z"))
    return classification_metrics(out.select("y", (F.col("z") > 0).cast("double").alias("prediction"), F.col("z").alias("score"))).first().asDict()


def tail_split(rows: DataFrame, test_ratio: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(first rows, last rows) in order of window_id, then ticker: about ``test_ratio`` of them last.

    The cut is found by counting, not by a sort of the rows. Rows of one window_id and ticker stay together, in front.
    """
    keys = [c for c in ("window_id", "ticker") if c in rows.columns]
    per_id = rows.groupBy("window_id").agg(F.count("*").alias("n"))
    n = per_id.agg(F.sum("n")).first()[0] or 0
    first = n - int(n * test_ratio)
    if first == n:
        raise ValueError("too few windows to hold any out")
    placed = ordered.running(per_id, [], "window_id", ["n"]).filter(F.col("n_before") < first).orderBy(F.col("window_id").desc()).first()
    before, at = F.col("window_id") < placed["window_id"], F.col("window_id") == placed["window_id"]
    if len(keys) == 2:
        own = rows.filter(at).groupBy("ticker").agg(F.count("*").alias("n"))  # one row a ticker of one window_id
        upto = F.sum("n").over(Window.orderBy("ticker"))
        last = own.withColumn("_upto", upto).filter(F.col("_upto") - F.col("n") < first - placed["n_before"]).agg(F.max("ticker")).first()[0]
        at = at & (F.col("ticker") <= last)
    return rows.filter(before | at), rows.filter(~(before | at))


def tstr_benchmark(real: DataFrame, synthetic: DataFrame, test_ratio: float = 0.2) -> dict[str, dict[str, float]]:
    """Models trained on real and on synthetic rows (window_id, x, y), both tested on the last real ones.

    With a ticker, windows of one number are put in its order.
    """
    real, synthetic = _written(real, "real-rows"), _written(synthetic, "synthetic-rows")
    train, test = tail_split(real, test_ratio)
    trtr, tstr = _fitted_metrics(train, test), _fitted_metrics(synthetic, test)
    return {"trtr": trtr, "tstr": tstr, "gap": {k: trtr[k] - tstr[k] for k in trtr}}
