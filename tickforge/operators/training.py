"""Training-loop helpers that need no tensor library: stopping, best-so-far, schedules, a generic loop."""

from __future__ import annotations

import logging
import random
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.sources import files

log = logging.getLogger(__name__)


def seed_everything(seed: int) -> int:
    """Seeds of the driver's generators; expressions on executors take explicit seeds."""
    random.seed(seed)
    np.random.seed(seed)
    return seed


def better(value: float, best: float | None, mode: str = "min", delta: float = 0.0) -> bool:
    return best is None or (value < best - delta if mode == "min" else value > best + delta)


class EarlyStopping:
    """True from the call at which ``patience`` values in a row brought no gain."""

    def __init__(self, patience: int = 10, min_delta: float = 0.0, mode: str = "min"):
        self.patience, self.min_delta, self.mode = patience, min_delta, mode
        self.reset()

    def reset(self) -> None:
        self.best, self.count, self.should_stop = None, 0, False

    def __call__(self, value: float) -> bool:
        if better(value, self.best, self.mode, self.min_delta):
            self.best, self.count = value, 0
            return False
        self.count += 1
        self.should_stop = self.should_stop or self.count >= self.patience
        return self.count >= self.patience


class BestCheckpoint:
    """Calls ``save(epoch, metrics)`` whenever the metric is the best so far."""

    def __init__(self, save: Callable[[int, dict], None], metric: str = "val_loss", mode: str = "min"):
        self.save, self.metric, self.mode, self.best = save, metric, mode, None

    def __call__(self, epoch: int, metrics: dict[str, float]) -> None:
        if self.metric in metrics and better(metrics[self.metric], self.best, self.mode):
            self.best = metrics[self.metric]
            self.save(epoch, metrics)


class MetricLogger:
    """Logs every so many epochs, and appends the line to a text file where ``path`` names one."""

    def __init__(self, every: int = 1, path: str | None = None):
        self.every, self.path = every, path

    def __call__(self, epoch: int, metrics: dict[str, float]) -> None:
        if epoch % self.every == 0:
            line = f"epoch {epoch}: " + ", ".join(f"{k} {v:.4f}" for k, v in metrics.items())
            log.info("%s", line)
            if self.path:
                files.append_line(self.path, line)


class PlateauSchedule:
    """Halves a rate (by ``factor``) after ``patience`` epochs without gain."""

    def __init__(self, rate: float, metric: str = "val_loss", factor: float = 0.5, patience: int = 10, least: float = 1e-6):
        self.rate, self.metric, self.factor, self.least = rate, metric, factor, least
        self.stop = EarlyStopping(patience)

    def __call__(self, epoch: int, metrics: dict[str, float]) -> None:
        if self.metric in metrics and self.stop(metrics[self.metric]):
            self.rate = max(self.least, self.rate * self.factor)
            self.stop.count = 0


class Trainer:
    """Epochs over batches by a step that returns a loss; callbacks get (epoch, metrics)."""

    def __init__(self, step: Callable[[Any], float], validate: Callable[[Any], float] | None = None, callbacks: Iterable[Callable[[int, dict], None]] = (), stopping: EarlyStopping | None = None):
        self.step, self.validate, self.callbacks, self.stopping = step, validate, list(callbacks), stopping

    def train(self, batches: Iterable[Any], epochs: int, held_out: Iterable[Any] = ()) -> dict[str, list[float]]:
        history: dict[str, list[float]] = {}
        for epoch in range(1, epochs + 1):
            metrics = {"train_loss": float(np.mean([self.step(b) for b in batches]))}
            if self.validate and held_out:
                metrics["val_loss"] = float(np.mean([self.validate(b) for b in held_out]))
            for k, v in metrics.items():
                history.setdefault(k, []).append(v)
            for call in self.callbacks:
                call(epoch, metrics)
            if self.stopping and self.stopping(metrics.get("val_loss", metrics["train_loss"])):
                break
        return history


def epoch_means(batches: DataFrame) -> DataFrame:
    """(epoch, metric, value): unweighted means over the batches of a loss history."""
    return batches.groupBy("epoch", "metric").agg(F.avg("value").alias("value"))


def stopping_trace(history: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(metric, epoch, value, best, waited, stopped) of a history (metric, epoch, value), least is best.

    A fold over each metric's epochs: a value counts as a gain against the best accepted so far.
    """
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "value")))
    start = F.array().cast("array<struct<epoch:int,value:double,best:double,waited:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        gain = last.isNull() | (x["value"] < last["best"] - min_delta)
        new = F.struct(
            x["epoch"].cast("int").alias("epoch"),
            x["value"].cast("double").alias("value"),
            F.when(gain, x["value"]).otherwise(last["best"]).cast("double").alias("best"),
            F.when(gain, 0).otherwise(last["waited"] + 1).cast("int").alias("waited"),
        )
        return F.concat(done, F.array(new))

    series = history.groupBy("metric").agg(ordered.alias("o"))
    rows = series.select("metric", F.explode(F.aggregate("o", start, add)).alias("r"))
    out = rows.select("metric", "r.*")
    return out.withColumn("stopped", F.max(F.col("waited") >= patience).over(Window.partitionBy("metric").orderBy("epoch")))


def shuffled(windows: DataFrame, seed: int) -> DataFrame:
    """Rows in an order that the seed decides."""
    return windows.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in windows.columns]))
