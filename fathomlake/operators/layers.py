"""Hidden layers whose statistics are those of the whole batch.

A step over a batch is written as a generator over some of its rows: where batch
normalisation needs a sum over all rows it yields the sum over its own and is
sent that of the batch, forwards (n, sum, sum of squares of each unit) and
backwards (sums of the gradient, and of it times the normalised value).  In
Spark each such sum is one job that replays the step with the sums known so far,
so a batch is one batch however many tasks hold its rows.

Dropout masks and noise are functions of (seed, epoch, row, layer, unit), not of
a generator's state, so they do not depend on where a row lies either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8
MOMENTUM = 0.9

#: Yields sums over some rows, is sent those over the batch, and returns its last sums.
Step = Generator[np.ndarray, np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(rows: np.ndarray, units: int, *keys: int) -> np.ndarray:
    """Numbers in [0, 1), one for each row (a 64-bit hash) and unit; ``keys`` name the draw."""
    with np.errstate(over="ignore"):
        start = np.zeros(1, np.uint64)
        for k in keys:
            start = _mixed(start + np.uint64(0x9E3779B97F4A7C15) + np.uint64(k & (2**64 - 1)))
        own = _mixed(rows.astype(np.int64).view(np.uint64) ^ start)
        steps = np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (_mixed(own[:, None] + steps[None]) >> np.uint64(11)) * 2.0**-53


def normals(rows: np.ndarray, units: int, *keys: int) -> np.ndarray:
    """Standard normal numbers, likewise."""
    u = uniforms(rows, 2 * units, *keys)
    return np.sqrt(-2 * np.log(1 - u[:, :units])) * np.cos(2 * math.pi * u[:, units:])


@dataclass(frozen=True)
class Training:
    """What a training step needs beside the rows: their hashes, dropout, and the draw."""

    rows: np.ndarray
    dropout: float = 0.0
    seed: int = 42
    epoch: int = 0


@dataclass
class Stack:
    """Layers of weights, batch normalisation (if ``gammas``), ReLU and dropout."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    gammas: list[np.ndarray] = field(default_factory=list)
    betas: list[np.ndarray] = field(default_factory=list)
    running: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    name: int = 0  # tells the draws of two stacks apart

    @classmethod
    def new(cls, sizes: Sequence[int], rng: np.random.Generator, gain: float, batch_norm: bool, name: int = 0) -> Stack:
        weights = [rng.standard_normal((a, b)) * math.sqrt(gain / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        out = cls(weights, [np.zeros(b) for b in sizes[1:]], name=name)
        if batch_norm:
            out.gammas, out.betas = [np.ones(b) for b in sizes[1:]], [np.zeros(b) for b in sizes[1:]]
            out.running = [(np.zeros(b), np.ones(b)) for b in sizes[1:]]
        return out

    def params(self) -> list[np.ndarray]:
        return [*self.weights, *self.biases, *self.gammas, *self.betas]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The outputs with running moments and without dropout."""
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = x @ w + b
            if self.gammas:
                mean, var = self.running[i]
                z = self.gammas[i] * (z - mean) / np.sqrt(var + EPSILON) + self.betas[i]
            x = np.maximum(z, 0)
        return x

    def forward(self, x: np.ndarray, training: Training) -> Generator:
        """Returns the outputs and what ``backward`` needs."""
        kept = []
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z, norm = x @ w + b, None
            if self.gammas:
                n, mean, var = batch_moments((yield np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])))
                inv = 1 / np.sqrt(var + EPSILON)
                norm = ((z - mean) * inv, inv, n)
                z = self.gammas[i] * norm[0] + self.betas[i]
            out, mask = np.maximum(z, 0), None
            if training.dropout:
                drawn = uniforms(training.rows, z.shape[1], training.seed, training.epoch, self.name, i)
                mask = (drawn >= training.dropout) / (1 - training.dropout)
                out = out * mask
            kept.append((x, z > 0, mask, norm))
            x = out
        return x, kept

    def backward(self, delta: np.ndarray, kept: list) -> Generator:
        """Returns the gradient of the inputs, and the summed ones in the order of ``params``."""
        gw, gb, gg, gt = ([None] * len(p) for p in (self.weights, self.biases, self.gammas, self.betas))
        for i in range(len(self.weights) - 1, -1, -1):
            x, above, mask, norm = kept[i]
            delta = (delta if mask is None else delta * mask) * above
            if norm is not None:
                value, inv, n = norm
                gg[i], gt[i] = (delta * value).sum(axis=0), delta.sum(axis=0)
                sums = yield np.concatenate([gt[i], gg[i]])
                width = len(gt[i])
                delta = self.gammas[i] * inv * (delta - sums[:width] / n - value * sums[width:] / n)
            gw[i], gb[i] = x.T @ delta, delta.sum(axis=0)
            delta = delta @ self.weights[i].T
        return delta, [*gw, *gb, *gg, *gt]

    def follow(self, sums: Sequence[np.ndarray]) -> None:
        """Move the running moments towards those of a batch, from the sums that ``forward`` was sent."""
        for i, s in enumerate(sums):
            _, mean, var = batch_moments(s)
            old = self.running[i]
            self.running[i] = (MOMENTUM * old[0] + (1 - MOMENTUM) * mean, MOMENTUM * old[1] + (1 - MOMENTUM) * var)


def batch_moments(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and variances of (n, sums, sums of squares)."""
    n, width = max(sums[0], 1.0), (len(sums) - 1) // 2
    mean = sums[1 : 1 + width] / n
    return n, mean, np.maximum(sums[1 + width :] / n - mean**2, 0)


def replayed(step: Step, known: Sequence[np.ndarray]) -> np.ndarray:
    """The sums that ``step`` yields, or in the end returns, once it was sent ``known``."""
    try:
        out = next(step)
        for sums in known:
            out = step.send(sums)
        return out
    except StopIteration as end:
        return end.value


def alone(step: Step) -> np.ndarray:
    """What ``step`` returns if its rows are the whole batch."""
    try:
        out = next(step)
        while True:
            out = step.send(out)
    except StopIteration as end:
        return end.value


def summed(data: DataFrame, values: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """``values`` of every frame, added up in Spark; empty if there are no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                own = values(frame)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total), dtype=np.int32), "v": total})

    rows = data.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect()  # a row a parameter
    out = np.zeros(len(rows))
    for at, v in rows:
        out[at] = v
    return out


def distributed(data: DataFrame, step: Callable[[pd.DataFrame], Step], sums: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All sums that the step of the whole of ``data`` is sent, ``sums`` of them, and what it returns."""
    known: list[np.ndarray] = []
    for _ in range(sums + 1):
        found = summed(data, lambda frame: replayed(step(frame), known))
        if not len(found):
            return [], found
        known.append(found)
    return known[:-1], known[-1]


def unflattened(flat: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def flattened(arrays: Sequence[np.ndarray], *more: float) -> np.ndarray:
    return np.concatenate([*(a.ravel() for a in arrays), np.array(more, float)])
