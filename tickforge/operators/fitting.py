"""Gradient training of the generators over windows (id, values): one pass over the data an epoch.

Each partition starts an epoch from the same weights, takes Adam steps over its own batches,
and returns what it ended with; weights and moments are averaged by rows (local steps with
averaging), so that an epoch needs no shuffle of windows. Averages are made in slices on the
executors before they reach the driver, which holds a few copies of the model, whatever the
number of partitions. Windows are checkpointed first, in the folder that
``spark.checkpoint.dir`` names: epochs don't compute them again, and as batches and noise
follow from seed, epoch and partition, a task that runs again takes the same steps.

An ``Objective`` names the weights that it moves and its loss; several take turns on each
batch. Rows with null values take no part; without rows weights stay and losses are NaN.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators import networks
from tickforge.operators.gradients import Tensor, derivatives
from tickforge.sources import files
from tickforge.sources.shared import shared_folder

#: Sums that reach the driver.
SLICES = 8


@dataclass(frozen=True)
class Objective:
    name: str
    moves: tuple[str, ...]  # first parts of weights' names
    loss: Callable[[Any, np.ndarray, np.random.Generator, int], Tensor]  # model, batch, noise, epoch
    only_above: float = -np.inf  # no step where the loss is lower


def mean_square(a: np.ndarray, b: np.ndarray) -> Tensor:
    return np.square(a - b).mean()


def logistic(logit: Tensor, real: bool) -> Tensor:
    """Binary cross-entropy against one label for all."""
    return np.logaddexp(0.0, -logit if real else logit).mean()


def next_step(model: networks.AdversarialModel, h: np.ndarray) -> Tensor:
    return mean_square(h[:, 1:], model.supervisor(h)[:, :-1])


def autoencoding() -> list[Objective]:
    loss = lambda m, x, rng, epoch: 10 * np.sqrt(mean_square(m.recover(m.embed(x)), x))
    return [Objective("e_loss", ("embedder", "recovery"), loss)]


def supervising() -> list[Objective]:
    return [Objective("s_loss", ("supervisor",), lambda m, x, rng, epoch: next_step(m, m.embed(x)))]


def adversarial(gamma: float = 1.0, supervision: float = 100.0, least: float = 0.15) -> list[Objective]:
    """Generator, discriminator and embedder in turn; the discriminator rests where it is nearly right."""

    def noise(m: networks.AdversarialModel, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return rng.standard_normal((*x.shape[:2], m.noise))

    def moments(made: Tensor, true: np.ndarray) -> Tensor:
        spread = lambda v: np.sqrt(np.square(v - v.mean(0, keepdims=True)).sum(0) * (1 / max(len(v) - 1, 1)) + 1e-6)
        return np.absolute(spread(made) - spread(true)).mean() + np.absolute(made.mean(0) - true.mean(0)).mean()

    def generator(m: networks.AdversarialModel, x: np.ndarray, rng: np.random.Generator, epoch: int) -> Tensor:
        h, made = m.embed(x), m.latent(noise(m, x, rng))
        fooled = logistic(m.discriminate(made), True)
        return (1 + gamma) * fooled + supervision * np.sqrt(next_step(m, h)) + moments(made, h)

    def discriminator(m: networks.AdversarialModel, x: np.ndarray, rng: np.random.Generator, epoch: int) -> Tensor:
        return logistic(m.discriminate(m.embed(x)), True) + logistic(m.discriminate(m.latent(noise(m, x, rng))), False)

    def embedder(m: networks.AdversarialModel, x: np.ndarray, rng: np.random.Generator, epoch: int) -> Tensor:
        h = m.embed(x)
        return 10 * np.sqrt(mean_square(m.recover(h), x)) + 0.1 * next_step(m, h)

    return [
        Objective("g_loss", ("generator", "supervisor"), generator),
        Objective("d_loss", ("discriminator",), discriminator, least),
        Objective("e_loss", ("embedder", "recovery"), embedder),
    ]


def variational(weight: float = 1.0, warmup: int = 50) -> list[Objective]:
    """Reconstruction and divergence, whose weight grows from 0 over the first epochs."""

    def loss(m: networks.VariationalModel, x: np.ndarray, rng: np.random.Generator, epoch: int) -> Tensor:
        mu, log_var = m.encode(x)
        z = mu + np.exp(0.5 * log_var) * rng.standard_normal(mu.shape)
        divergence = -0.5 * (1 + log_var - np.square(mu) - np.exp(log_var)).mean()
        beta = weight * min(1.0, epoch / warmup) if warmup else weight
        return mean_square(m.decode(z, x.shape[1]), x) + beta * divergence

    return [Objective("loss", ("encoder", "decoder", "first"), loss)]


def denoising(alpha_bar: np.ndarray) -> list[Objective]:
    """Noise is predicted at a step drawn for each row; ``alpha_bar`` is the schedule's, in order."""
    bars = np.asarray(alpha_bar, np.float64)

    def loss(m: networks.Denoiser, x: np.ndarray, rng: np.random.Generator, epoch: int) -> Tensor:
        t, noise = rng.integers(0, len(bars), len(x)), rng.standard_normal(x.shape)
        bar = bars[t][:, None, None]
        return mean_square(m(np.sqrt(bar) * x + np.sqrt(1 - bar) * noise, t), noise)

    return [Objective("loss", ("net",), loss)]


class Adam:
    """Moments of gradients and steps by them; ``state`` is one vector of weights and both moments."""

    def __init__(self, weights: networks.Weights, rate: float, clip: float | None, count: dict[str, int]):
        self.weights, self.rate, self.clip, self.count = weights, rate, clip, count
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, part: str, gradients: networks.Weights) -> None:
        size = np.sqrt(sum(float(np.square(g).sum()) for g in gradients.values()))
        scale = self.clip / size if self.clip and size > self.clip else 1.0
        self.count[part] = n = self.count.get(part, 0) + 1
        for k, g in gradients.items():
            g = g * scale
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * np.square(g)
            self.weights[k] = self.weights[k] - self.rate * (self.first[k] / (1 - 0.9**n)) / (np.sqrt(self.second[k] / (1 - 0.999**n)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([x[k].ravel() for x in (self.weights, self.first, self.second) for k in sorted(x)])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for x in (self.weights, self.first, self.second):
            for k in sorted(x):
                x[k] = state[at : at + x[k].size].reshape(x[k].shape)
                at += x[k].size


def loss_and_gradients(model: networks.Parametrised, weights: networks.Weights, aim: Objective, x: np.ndarray, rng: np.random.Generator, epoch: int) -> tuple[float, networks.Weights]:
    """Dropout draws from ``rng`` as well."""
    leaves = {k: Tensor(v) if k.split(".")[0] in aim.moves else v for k, v in weights.items()}
    loss = aim.loss(model.with_parameters(leaves).training(rng), x, rng, epoch)
    found = derivatives(loss)
    return float(loss.value), {k: found[id(v)] for k, v in leaves.items() if id(v) in found}


def _epoch(model: networks.Parametrised, aims: list[Objective], adam: Adam, batch: int, seed: int, epoch: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, epoch, own])
        rows, losses, steps = 0, np.zeros(len(aims)), 0
        for part in parts:
            values = part["values"].tolist()
            order = rng.permutation(len(values))
            for a in range(0, len(order), batch):
                x = np.array([np.stack(values[i]) for i in order[a : a + batch]], np.float64)
                for j, aim in enumerate(aims):
                    loss, gradients = loss_and_gradients(model, adam.weights, aim, x, rng, epoch)
                    losses[j] += loss
                    if loss > aim.only_above:
                        adam.step(aim.name, gradients)
                rows, steps = rows + len(x), steps + 1
        if rows:
            yield pd.DataFrame({"slice": [own % SLICES], "rows": [rows], "steps": [steps], "losses": [losses.tobytes()], "state": [(adam.state() * rows).tobytes()], "count": [pickle.dumps(adam.count)]})

    return run


def _total(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["rows", "losses"])  # the same sum whatever the order of arrival
    losses = sum(np.frombuffer(x) for x in part["losses"])
    state = sum(np.frombuffer(x) for x in part["state"])
    counts = [pickle.loads(x) for x in part["count"]]
    most = {k: max(c.get(k, 0) for c in counts) for c in counts for k in c}
    return pd.DataFrame({"slice": part["slice"].iloc[:1], "rows": [part["rows"].sum()], "steps": [part["steps"].sum()], "losses": [losses.tobytes()], "state": [state.tobytes()], "count": [pickle.dumps(most)]})


STATE = "slice int, rows long, steps long, losses binary, state binary, count binary"


def _kept(rows: DataFrame) -> DataFrame:
    """Rows in the shared folder, dealt to at least as many partitions as there are cores."""
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows.sparkSession.sparkContext.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def _held_out_loss(rows: DataFrame, model: networks.Parametrised, aims: list[Objective], weights: networks.Weights, batch: int, seed: int, epoch: int) -> list[float]:
    """Mean losses by objective over rows that no step is taken on, without dropout: sums a partition, noise from the seed and the epoch."""
    judged = model.with_parameters(weights)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId(), 1])
        sums, n = np.zeros(len(aims)), 0
        for part in parts:
            values = part["values"].tolist()
            for a in range(0, len(values), batch):
                x = np.array([np.stack(v) for v in values[a : a + batch]], np.float64)
                sums += [len(x) * float(aim.loss(judged, x, rng, epoch)) for aim in aims]
                n += len(x)
        yield pd.DataFrame({"aim": np.arange(len(aims)), "s": sums, "n": n})

    total = rows.mapInPandas(run, "aim int, s double, n long").groupBy("aim").agg(F.sum("s"), F.sum("n"))
    found = {k: s / n if n else float("nan") for k, s, n in map(tuple, total.collect())}  # a row an objective
    return [found.get(k, float("nan")) for k in range(len(aims))]


def restored(path: str, model: networks.Parametrised) -> networks.Parametrised:
    """``model`` with the weights of a checkpoint that ``fit`` wrote (``best.npz`` or ``last.npz`` of its folder)."""
    adam = Adam({k: np.asarray(v, np.float64) for k, v in model.parameters().items()}, 0.0, None, {})
    adam.restore(files.load_checkpoint(path)[0]["state"])
    return model.with_parameters(adam.weights)


def fit(
    windows: DataFrame,
    model: networks.Parametrised,
    objectives: list[Objective],
    epochs: int,
    rate: float = 1e-3,
    batch: int = 64,
    seed: int = 42,
    clip: float | None = 1.0,
    callbacks: tuple[Callable[[int, dict], None], ...] = (),
    stop: Callable[[float], bool] | None = None,
    held_out: DataFrame | None = None,
    checkpoint: str | None = None,
    resume: bool = False,
) -> tuple[networks.Parametrised, dict[str, list[float]]]:
    """The trained model and its history of mean losses by objective.

    ``callbacks`` get (epoch, metrics); one with a ``rate`` sets the next epoch's. With
    ``held_out`` windows the first objective's loss on them is the metric ``val_loss``. ``stop``
    gets it, or else the first objective's loss. ``checkpoint`` names a folder (a local path or
    a URI) for ``last.npz``, written each epoch, and ``best.npz``, the epoch of the least such
    loss; ``resume`` goes on from ``last.npz`` where there is one, up to ``epochs`` in all.
    """
    rows = _kept(windows.filter(F.col("values").isNotNull()).select("values"))
    judge = None if held_out is None else _kept(held_out.filter(F.col("values").isNotNull()).select("values"))
    adam = Adam({k: np.asarray(v, np.float64) for k, v in model.parameters().items()}, rate, clip, {})
    history: dict[str, list[float]] = {o.name: [] for o in objectives} | ({} if judge is None else {"val_loss": []})
    begin, best = 0, None
    if resume and checkpoint and files.is_file(f"{checkpoint}/last.npz"):
        state, meta = files.load_checkpoint(f"{checkpoint}/last.npz")
        adam.restore(state["state"])
        begin, best, adam.count, adam.rate = meta["epoch"], meta["metrics"]["best"], meta["metrics"]["steps"], meta["metrics"]["rate"]
    for epoch in range(begin, epochs):
        parts = rows.mapInPandas(_epoch(model, objectives, adam, batch, seed, epoch), STATE)
        done = parts.groupBy("slice").applyInPandas(_total, STATE).orderBy("slice").toPandas()  # SLICES rows
        metrics = {o.name: float("nan") for o in objectives}
        if len(done):
            all_ = _total(done).iloc[0]
            adam.restore(np.frombuffer(all_["state"]) / all_["rows"])
            adam.count = pickle.loads(all_["count"])
            metrics = dict(zip(metrics, (np.frombuffer(all_["losses"]) / all_["steps"]).tolist(), strict=True))
        if judge is not None:
            metrics["val_loss"] = _held_out_loss(judge, model, objectives[:1], adam.weights, batch, seed, epoch)[0]
        for k, v in metrics.items():
            history[k].append(v)
        for call in callbacks:
            call(epoch + 1, metrics)
            adam.rate = getattr(call, "rate", adam.rate)
        watched = metrics.get("val_loss", metrics[objectives[0].name])
        if checkpoint:
            gained = not np.isnan(watched) and (best is None or watched < best)
            best = watched if gained else best
            kept = {**metrics, "best": best, "steps": adam.count, "rate": adam.rate}
            for name in ["last", "best"] if gained else ["last"]:
                files.save_checkpoint(f"{checkpoint}/{name}.npz", {"state": adam.state()}, epoch + 1, kept)
        if stop and stop(watched):
            break
    return model.with_parameters(adam.weights), history


def fit_adversarial(windows: DataFrame, model: networks.AdversarialModel, epochs: tuple[int, int, int] = (200, 200, 300), rates: tuple[float, float, float] | None = None, **options) -> tuple[networks.AdversarialModel, dict[str, list[float]]]:
    """The three phases in turn: autoencoder, supervisor, joint. ``rates`` are theirs; checkpoints lie in a folder a phase."""
    history: dict[str, list[float]] = {}
    aims = {"autoencoder": autoencoding(), "supervisor": supervising(), "joint": adversarial()}
    for k, phase in enumerate(aims):
        own = dict(options) | ({"rate": rates[k]} if rates else {}) | ({"checkpoint": f"{options['checkpoint']}/{phase}"} if options.get("checkpoint") else {})
        model, found = fit(windows, model, aims[phase], epochs[k], **own)
        history |= {f"{phase}.{k}": v for k, v in found.items()}
    return model, history


def build(kind: str, features: int, /, **options) -> networks.Parametrised:
    """A model by its kind: adversarial, variational or diffusion."""
    kinds = {"adversarial": networks.AdversarialModel, "variational": networks.VariationalModel, "diffusion": networks.Denoiser}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}")
    return kinds[kind](features, **options)
