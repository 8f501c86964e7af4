"""The generators in NumPy: recurrent cells, the adversarial and the variational model, and the convolutional denoiser.

Forward passes take arrays or ``gradients.Tensor`` weights, so that ``fitting`` trains them as
they stand. Sampling runs in Arrow batches on the executors, weights travelling with the
task: they are of fixed size. ``parameters`` names a model's weights; ``with_parameters``
gives a model of other ones, ``training`` one whose dropout is at work.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tickforge.operators.generative import GaussianCopula, generate

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def init(rng: np.random.Generator, shapes: dict[str, tuple[int, ...]]) -> Weights:
    return {k: rng.uniform(-1, 1, s) / np.sqrt(s[-1]) for k, s in shapes.items()}


def dropped(x: np.ndarray, rate: float, rng: np.random.Generator | None) -> np.ndarray:
    """Without a share of the values, the others scaled to the same mean; without ``rng`` all of them."""
    return x * ((rng.uniform(size=x.shape) >= rate) / (1 - rate)) if rate and rng else x


@dataclass
class Recurrent:
    """Stacked GRU or LSTM layers and a linear head, with sigmoid or plain output.

    Gates stand side by side in the matrices: r, z, n of a GRU; i, f, g, o of an LSTM. Dropout
    works between layers, while there is a generator for it.
    """

    inputs: int
    hidden: int
    outputs: int
    layers: int = 1
    kind: str = "gru"
    squash: bool = True
    weights: Weights = field(default_factory=dict)
    dropout: float = 0.0
    drops: np.random.Generator | None = None

    def shapes(self) -> dict[str, tuple[int, ...]]:
        g = 3 if self.kind == "gru" else 4
        out: dict[str, tuple[int, ...]] = {"head": (self.outputs, self.hidden), "head_bias": (self.outputs,)}
        for k in range(self.layers):
            out |= {f"in{k}": (g * self.hidden, self.hidden if k else self.inputs), f"rec{k}": (g * self.hidden, self.hidden), f"in_bias{k}": (g * self.hidden,), f"rec_bias{k}": (g * self.hidden,)}
        return out

    def seeded(self, seed: int) -> Recurrent:
        self.weights = init(np.random.default_rng(seed), self.shapes())
        return self

    def states(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The last layer's states (n, length, hidden)."""
        h = self.hidden
        for k in range(self.layers):
            x = dropped(x, self.dropout, self.drops) if k else x
            w, u, b, c = (self.weights[f"{name}{k}"] for name in ("in", "rec", "in_bias", "rec_bias"))
            given = x @ w.T + b
            state = np.zeros((len(x), h)) if start is None else start
            cell, out = np.zeros((len(x), h)), []
            for t in range(x.shape[1]):
                a, r = given[:, t], state @ u.T + c
                if self.kind == "gru":
                    reset, keep = sigmoid(a[:, :h] + r[:, :h]), sigmoid(a[:, h : 2 * h] + r[:, h : 2 * h])
                    state = (1 - keep) * np.tanh(a[:, 2 * h :] + reset * r[:, 2 * h :]) + keep * state
                else:
                    i, f, g, o = ((a + r)[:, k * h : (k + 1) * h] for k in range(4))
                    cell = sigmoid(f) * cell + sigmoid(i) * np.tanh(g)
                    state = sigmoid(o) * np.tanh(cell)
                out.append(state)
            x = np.stack(out, 1)
        return x

    def __call__(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        y = self.states(x, start) @ self.weights["head"].T + self.weights["head_bias"]
        return sigmoid(y) if self.squash else y


class Parametrised:
    """A model whose parts hold weights by name; a weight's full name is ``part.weight``."""

    parts: tuple[str, ...] = ()
    drops = None

    def _held(self, part: str) -> Weights:
        found = getattr(self, part)
        return found.weights if isinstance(found, Recurrent) else found

    def parameters(self) -> Weights:
        return {f"{p}.{k}": v for p in self.parts for k, v in self._held(p).items()}

    def with_parameters(self, weights: Weights):
        out = copy.copy(self)
        for p in self.parts:
            mine = {k: weights[f"{p}.{k}"] for k in self._held(p)}
            found = getattr(self, p)
            setattr(out, p, replace(found, weights=mine) if isinstance(found, Recurrent) else mine)
        return out

    def training(self, drops: np.random.Generator):
        """The model with dropout as ``drops`` decides."""
        out = copy.copy(self)
        out.drops = drops
        for p in self.parts:
            if isinstance(found := getattr(self, p), Recurrent):
                setattr(out, p, replace(found, drops=drops))
        return out


@dataclass
class AdversarialModel(Parametrised):
    """Embedder, recovery, generator, supervisor and discriminator over a shared latent space."""

    parts = ("embedder", "recovery", "generator", "supervisor", "discriminator")

    features: int
    hidden: int = 24
    noise: int = 8
    layers: int = 2
    kind: str = "gru"
    dropout: float = 0.0

    def __post_init__(self) -> None:
        part = lambda i, o, s, squash: Recurrent(i, self.hidden, o, self.layers, self.kind, squash, dropout=self.dropout).seeded(s)
        self.embedder = part(self.features, self.hidden, 1, True)
        self.recovery = part(self.hidden, self.features, 2, False)
        self.generator = part(self.noise, self.hidden, 3, True)
        self.supervisor = part(self.hidden, self.hidden, 4, True)
        self.discriminator = part(self.hidden, 1, 5, False)

    def embed(self, x: np.ndarray) -> np.ndarray:
        return self.embedder(x)

    def recover(self, h: np.ndarray) -> np.ndarray:
        return self.recovery(h)

    def latent(self, z: np.ndarray) -> np.ndarray:
        return self.supervisor(self.generator(z))

    def discriminate(self, h: np.ndarray) -> np.ndarray:
        return self.discriminator(h)

    def generate(self, spark: SparkSession, count: int, length: int, seed: int = 42) -> DataFrame:
        return generate(spark, count, lambda rng, n: self.recover(self.latent(rng.standard_normal((n, length, self.noise)))), seed)


@dataclass
class VariationalModel(Parametrised):
    """Encoder to mean and log variance; decoder from a latent repeated over time."""

    parts = ("encoder", "decoder", "first")

    features: int
    hidden: int = 32
    latent: int = 8
    kind: str = "gru"
    seed: int = 1
    layers: int = 2
    dropout: float = 0.1

    def __post_init__(self) -> None:
        part = lambda i, o, s: Recurrent(i, self.hidden, o, self.layers, self.kind, False, dropout=self.dropout).seeded(s)
        self.encoder = part(self.features, 2 * self.latent, self.seed)
        self.decoder = part(self.latent, self.features, self.seed + 1)
        self.first = init(np.random.default_rng(self.seed + 2), {"w": (self.hidden, self.latent), "b": (self.hidden,)})

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.encoder(x)[:, -1]
        return both[:, : self.latent], both[:, self.latent :]

    def decode(self, z: np.ndarray, length: int) -> np.ndarray:
        start = np.tanh(z @ self.first["w"].T + self.first["b"])
        return self.decoder(z[:, None, :] + np.zeros((1, length, 1)), start)

    def generate(self, spark: SparkSession, count: int, length: int, temperature: float = 1.0, copula: GaussianCopula | None = None, seed: int = 42) -> DataFrame:
        """Latents from the prior, or from a fitted copula."""
        if copula is not None and not copula.fitted:
            raise RuntimeError("fit the copula first")
        draw = (lambda rng, n: rng.standard_normal((n, self.latent)) * temperature) if copula is None else copula.latents
        return generate(spark, count, lambda rng, n: self.decode(draw(rng, n), length), seed)


def silu(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(x)


def time_embedding(t: np.ndarray, dim: int) -> np.ndarray:
    """Sines and cosines of steps at geometric frequencies, (n, dim)."""
    half = dim // 2
    angle = np.asarray(t, np.float64)[:, None] * np.exp(-np.log(10000.0) * np.arange(half) / max(half - 1, 1))
    return np.concatenate([np.sin(angle), np.cos(angle)], 1)


@dataclass
class Denoiser(Parametrised):
    """A U-net over time without down-sampling: residual blocks widen up to the middle level and narrow again.

    The state before each widening is kept and joined to the input of the mirrored level: one
    skip a level. Channels stand last. ``denoiser(x, t)`` predicts the noise in x.
    """

    features: int = 8
    widths: tuple[int, ...] = (64, 128, 256, 128, 64)
    embedding: int = 128
    blocks: int = 2
    groups: int = 8
    seed: int = 3
    dropout: float = 0.1

    parts = ("net",)

    def __post_init__(self) -> None:
        middle = len(self.widths) // 2
        self.plan: list[tuple[str, int, int, bool]] = []  # name, channels in and out, joins a skip
        self.keeps: set[str] = set()  # blocks after which a skip is kept
        at, skips = self.widths[0], [self.widths[0]]
        for level, width in enumerate(self.widths):
            for k in range(self.blocks):
                joins = level > middle and k == 0
                self.plan.append((f"b{level}_{k}", at + (skips.pop() if joins else 0), width, joins))
                at = width
            if level < middle:
                skips.append(at)
                self.keeps.add(self.plan[-1][0])
        shapes: dict[str, tuple[int, ...]] = {"into": (self.widths[0], self.features), "out": (self.features, at)}
        plain = {"into_bias": self.widths[0], "out_bias": self.features, "norm_bias": at}
        scales = {"norm": at}
        for name, a, b, _ in self.plan:
            shapes |= {f"{name}.one": (b, 3 * a), f"{name}.two": (b, 3 * b), f"{name}.time": (b, self.embedding)}
            plain |= {f"{name}.{k}_bias": b for k in ("one", "two", "time")} | {f"{name}.n1_bias": a, f"{name}.n2_bias": b}
            scales |= {f"{name}.n1": a, f"{name}.n2": b}
            if a != b:
                shapes[f"{name}.skip"] = (b, a)
                plain[f"{name}.skip_bias"] = b
        self.net = init(np.random.default_rng(self.seed), shapes)
        self.net |= {k: np.zeros(n) for k, n in plain.items()} | {k: np.ones(n) for k, n in scales.items()}

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.net[name].T + self.net[name + "_bias"]

    def _wide(self, x: np.ndarray, name: str) -> np.ndarray:
        """A convolution over three steps: each step beside its neighbours, and one product."""
        edge = np.zeros((x.shape[0], 1, x.shape[2]))
        return self._linear(np.concatenate([np.concatenate([edge, x[:, :-1]], 1), x, np.concatenate([x[:, 1:], edge], 1)], 2), name)

    def _normed(self, x: np.ndarray, name: str) -> np.ndarray:
        n, length, channels = x.shape
        groups = min(self.groups, channels)
        if channels % groups:
            raise ValueError(f"{channels} channels don't divide into {groups} groups")
        x = x.reshape(n, length, groups, channels // groups)
        off = x - x.mean((1, 3), keepdims=True)
        x = off / np.sqrt(np.square(off).mean((1, 3), keepdims=True) + 1e-5)
        return x.reshape(n, length, channels) * self.net[name] + self.net[name + "_bias"]

    def __call__(self, x: np.ndarray, t: np.ndarray | int) -> np.ndarray:
        when = silu(time_embedding(np.broadcast_to(np.asarray(t), (len(x),)), self.embedding))
        h = self._linear(x, "into")
        skips = [h]
        for name, a, b, joins in self.plan:
            if joins:
                h = np.concatenate([h, skips.pop()], 2)
            y = self._wide(silu(self._normed(h, f"{name}.n1")), f"{name}.one")
            y = y + self._linear(when, f"{name}.time")[:, None, :]
            y = self._wide(dropped(silu(self._normed(y, f"{name}.n2")), self.dropout, self.drops), f"{name}.two")
            h = y + (h if a == b else self._linear(h, f"{name}.skip"))
            if name in self.keeps:
                skips.append(h)
        return self._linear(silu(self._normed(h, "norm")), "out")
