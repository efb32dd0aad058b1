"""Multi-layer perceptrons trained data-parallel.

Each step, tasks compute the sums of their rows (numpy, Arrow batches), Spark
adds them up, and the driver, which holds the weights alone, updates them.
Hidden units are ReLU, the output is a softmax.  Options: mini-batches by hash,
SGD or Adam, L2, inverted dropout, batch normalisation over the whole batch (both
as in ``layers``: the fit does not depend on the partitioning), rate schedules,
early stopping on a validation part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layers import Stack, Step, Training, alone, distributed, flattened, summed, unflattened
from .metrics import labels_of


@dataclass(frozen=True)
class Options:
    hidden: tuple[int, ...] = (32,)
    rate: float = 0.1
    epochs: int = 20
    batches: int = 1  # mini-batches an epoch
    optimiser: str = "sgd"
    schedule: str = "constant"
    l2: float = 0.0
    dropout: float = 0.0
    batch_norm: bool = False
    patience: int | None = None
    seed: int = 42


@dataclass
class Network:
    classes: tuple
    hidden: Stack
    out_weight: np.ndarray
    out_bias: np.ndarray
    history: list[tuple[int, str, float]] = field(default_factory=list)

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.hidden.weights, self.out_weight]

    @property
    def biases(self) -> list[np.ndarray]:
        return [*self.hidden.biases, self.out_bias]

    @property
    def betas(self) -> list[np.ndarray]:
        return self.hidden.betas

    @property
    def gammas(self) -> list[np.ndarray]:
        return self.hidden.gammas

    def params(self) -> list[np.ndarray]:
        return [*self.weights, *self.biases, *self.gammas, *self.betas]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.hidden.predict(x) @ self.out_weight + self.out_bias)


def learning_rate(rate: float, epoch: int, epochs: int, schedule: str) -> float:
    """constant; linear: rate / (1 + e / E); exponential: rate * exp(-0.1 e / E)."""
    if schedule == "linear":
        return rate / (1 + epoch / epochs)
    if schedule == "exponential":
        return rate * math.exp(-0.1 * epoch / epochs)
    return rate


def adam_step(w: float, g: float, m: float, v: float, t: int, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
    """(w, m, v) after one Adam update; works on arrays as well."""
    m = b1 * m + (1 - b1) * g
    v = b2 * v + (1 - b2) * g * g
    return w - rate * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + eps), m, v


def early_stop(losses: Sequence[float], patience: int) -> tuple[int, int]:
    """(best epoch, last epoch run) from 0: stops after ``patience`` epochs without a gain."""
    best, at, wait = math.inf, -1, 0
    for epoch, loss in enumerate(losses):
        if loss < best:
            best, at, wait = loss, epoch, 0
        else:
            wait += 1
            if wait >= patience:
                return at, epoch
    return at, len(losses) - 1


def initialise(sizes: Sequence[int], classes: Sequence, options: Options) -> Network:
    """He-normal weights and zero biases."""
    rng = np.random.default_rng(options.seed)
    hidden = Stack.new(sizes[:-1], rng, 2, options.batch_norm)
    return Network(tuple(classes), hidden, rng.standard_normal((sizes[-2], sizes[-1])) * math.sqrt(2 / sizes[-2]), np.zeros(sizes[-1]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit_of(p: np.ndarray, y: np.ndarray) -> tuple[float, int, int]:
    """Summed loss, hits and rows."""
    return float(-np.log(np.clip(p[np.arange(len(y)), y], 1e-10, 1)).sum()), int((p.argmax(axis=1) == y).sum()), len(y)


def _step(net: Network, x: np.ndarray, y: np.ndarray, training: Training) -> Step:
    """Summed gradients in the order of ``params``, then summed loss, hits and rows."""
    a, kept = yield from net.hidden.forward(x, training)
    p = _softmax(a @ net.out_weight + net.out_bias)
    delta = p.copy()
    delta[np.arange(len(y)), y] -= 1
    _, g = yield from net.hidden.backward(delta @ net.out_weight.T, kept)
    k = len(net.hidden.weights)
    return flattened([*g[:k], a.T @ delta, *g[k : 2 * k], delta.sum(axis=0), *g[2 * k :]], *_fit_of(p, y))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, int]:
    """Summed gradients in the order of ``params``, summed loss and hits of rows that are a batch."""
    flat = alone(_step(net, x, y, Training(np.arange(len(x)))))
    return unflattened(flat[:-3], net.params()), float(flat[-3]), int(flat[-2])


def _rows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(frame["x"].to_numpy()), frame["y"].to_numpy()


def _train(data: DataFrame, net: Network, options: Options, epoch: int) -> tuple[list[np.ndarray] | None, float, int]:
    """Mean gradients, mean loss and rows of one batch (x, y, h); running moments follow it."""
    def step(frame: pd.DataFrame) -> Step:
        return _step(net, *_rows(frame), Training(frame["h"].to_numpy(), options.dropout, options.seed, epoch))

    known, flat = distributed(data, step, 2 * len(net.gammas))
    if not len(flat):
        return None, 0.0, 0
    n = flat[-1]
    net.hidden.follow(known[: len(net.gammas)])
    return [g / n for g in unflattened(flat[:-3], net.params())], flat[-3] / n, int(n)


def evaluate(data: DataFrame, net: Network) -> tuple[float, float]:
    """Mean loss and accuracy over (x, y); zeros without rows."""
    def values(frame: pd.DataFrame) -> np.ndarray:
        x, y = _rows(frame)
        return np.array(_fit_of(net.probabilities(x), y), float)

    found = summed(data, values)
    return (found[0] / found[2], found[1] / found[2]) if len(found) else (0.0, 0.0)


def fit(df: DataFrame, vector: str, label: str, row_id: str, options: Options | None = None, validation: DataFrame | None = None) -> Network:
    """Train; with patience, the weights of the best epoch return once it fires."""
    options = options or Options()
    classes = labels_of(df, label, label)
    width = df.select(F.size(vector)).first()[0]
    levels = F.array(*[F.lit(c) for c in classes])

    def prepared(d: DataFrame) -> DataFrame:
        return d.select(F.transform(vector, lambda v: v.cast("double")).alias("x"), (F.array_position(levels, F.col(label)) - 1).cast("int").alias("y"), F.xxhash64(row_id).alias("h"))

    data = prepared(df).cache()
    held = prepared(validation).cache() if validation is not None else None
    net = initialise([width, *options.hidden, len(classes)], classes, options)
    m, v, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    losses, best = [], None
    try:
        for epoch in range(options.epochs):
            rate, seen, total = learning_rate(options.rate, epoch, options.epochs, options.schedule), 0, 0.0
            for batch in range(options.batches):
                part = data if options.batches == 1 else data.filter(F.pmod(F.xxhash64("h", F.lit(epoch)), F.lit(options.batches)) == batch)
                grads, loss, n = _train(part, net, options, epoch)
                if grads is None:
                    continue
                t, seen, total = t + 1, seen + n, total + loss * n
                for i, (p, g) in enumerate(zip(net.params(), grads, strict=True)):
                    if i < len(net.weights) and options.l2:
                        g = g + options.l2 / n * p
                    if options.optimiser == "adam":
                        p[...], m[i], v[i] = adam_step(p, g, m[i], v[i], t, rate)
                    else:
                        p -= rate * g
            net.history.append((epoch, "train_loss", total / max(seen, 1)))
            if held is not None:
                loss, acc = evaluate(held, net)
                net.history += [(epoch, "validation_loss", loss), (epoch, "validation_accuracy", acc)]
                losses.append(loss)
                if loss <= min(losses):
                    best = [p.copy() for p in net.params()], list(net.hidden.running)
                if options.patience and early_stop(losses, options.patience)[0] + options.patience <= epoch:
                    for p, b in zip(net.params(), best[0], strict=True):
                        p[...] = b
                    net.hidden.running = best[1]
                    break
        return net
    finally:
        data.unpersist()
        if held is not None:
            held.unpersist()


def predict(df: DataFrame, net: Network, vector: str) -> DataFrame:
    """``df`` with probabilities (in the order of the classes) and prediction."""
    kind = "string" if isinstance(net.classes[0], str) else "int"
    schema = df.select("*", F.array().cast("array<double>").alias("probabilities"), F.lit(None).cast(kind).alias("prediction")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                p = net.probabilities(np.stack(frame[vector].to_numpy()).astype(float))
                yield frame.assign(probabilities=list(p), prediction=[net.classes[i] for i in p.argmax(axis=1)])

    return df.mapInPandas(run, schema)


def run_experiments(df: DataFrame, vector: str, label: str, row_id: str, configs: dict[str, Options], validation: DataFrame) -> list[tuple[str, int, str, float]]:
    """(run, epoch, metric, value) of every configuration."""
    return [(name, *h) for name, o in configs.items() for h in fit(df, vector, label, row_id, o, validation).history]


def tune_in_turn(df: DataFrame, vector: str, label: str, row_id: str, base: Options, grid: dict[str, Sequence], validation: DataFrame) -> Options:
    """One option after the other, each kept at its best validation loss."""
    for name, values in grid.items():
        scored = []
        for value in values:
            net = fit(df, vector, label, row_id, replace(base, **{name: value}), validation)
            scored.append((min(h[2] for h in net.history if h[1] == "validation_loss"), value))
        base = replace(base, **{name: min(scored, key=lambda s: s[0])[1]})
    return base
