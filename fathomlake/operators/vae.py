"""A variational autoencoder of any depth, trained data-parallel.

Encoder and decoder are stacks of ``layers``: batch normalisation over the whole
batch and dropout as in the perceptrons, noise as a function of seed, epoch and
row.  Gradients are summed in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layers import Stack, Step, Training, alone, distributed, flattened, normals, unflattened
from .mlp import adam_step


@dataclass
class Vae:
    encoder: Stack
    heads: list[np.ndarray]  # weights and biases of the mean, and of the log variance
    decoder: Stack
    out: list[np.ndarray]
    losses: list[float] = field(default_factory=list)

    def params(self) -> list[np.ndarray]:
        return [*self.encoder.params(), *self.heads, *self.decoder.params(), *self.out]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and log variance of each row's latent."""
        return self._latent(self.encoder.predict(x))

    def decode(self, z: np.ndarray) -> np.ndarray:
        return self._output(self.decoder.predict(z))

    def _latent(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wm, bm, wv, bv = self.heads
        return h @ wm + bm, np.clip(h @ wv + bv, -10, 10)

    def _output(self, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(h @ self.out[0] + self.out[1], -30, 30)))


def new(width: int, latent: int, hidden: Sequence[int], seed: int, batch_norm: bool = False) -> Vae:
    rng = np.random.default_rng(seed)

    def linear(a: int, b: int) -> list[np.ndarray]:
        return [rng.standard_normal((a, b)) * np.sqrt(1 / a), np.zeros(b)]

    encoder = Stack.new([width, *hidden], rng, 1, batch_norm)
    heads = [*linear(hidden[-1], latent), *linear(hidden[-1], latent)]
    decoder = Stack.new([latent, *reversed(hidden)], rng, 1, batch_norm, name=1)
    return Vae(encoder, heads, decoder, linear(hidden[0], width))


def _step(net: Vae, x: np.ndarray, beta: float, noise: np.ndarray, training: Training) -> Step:
    """Summed gradients in the order of ``params``, then summed loss (binary cross-entropy plus beta times KL) and rows."""
    h, below = yield from net.encoder.forward(x, training)
    mean, logvar = net._latent(h)
    std = np.exp(logvar / 2)
    z = mean + std * noise
    h2, above = yield from net.decoder.forward(z, training)
    out = net._output(h2)
    loss = -(x * np.log(out + 1e-12) + (1 - x) * np.log(1 - out + 1e-12)).sum() - beta * 0.5 * (1 + logvar - mean**2 - np.exp(logvar)).sum()
    d_out = out - x
    dz, decoder = yield from net.decoder.backward(d_out @ net.out[0].T, above)
    dm = dz + beta * mean
    dv = dz * noise * std / 2 + beta * 0.5 * (np.exp(logvar) - 1)
    _, encoder = yield from net.encoder.backward(dm @ net.heads[0].T + dv @ net.heads[2].T, below)
    heads = [h.T @ dm, dm.sum(axis=0), h.T @ dv, dv.sum(axis=0)]
    return flattened([*encoder, *heads, *decoder, h2.T @ d_out, d_out.sum(axis=0)], loss, len(x))


def gradients(net: Vae, x: np.ndarray, beta: float, noise: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Summed gradients and loss of rows that are a batch."""
    flat = alone(_step(net, x, beta, noise, Training(np.arange(len(x)))))
    return unflattened(flat[:-2], net.params()), float(flat[-2])


def fit(df: DataFrame, vector: str, row_id: str, latent: int = 2, hidden: int | Sequence[int] = 16, epochs: int = 10, rate: float = 1e-2, beta: float = 1.0,
        seed: int = 42, batch_norm: bool = False, dropout: float = 0.0) -> Vae:
    """Inputs lie in [0, 1]; ``hidden`` are the encoder's layers, the decoder has them in reverse.  A full-batch Adam step an epoch."""
    sizes = (hidden,) if isinstance(hidden, int) else tuple(hidden)
    net = new(df.select(F.size(vector)).first()[0], latent, sizes, seed, batch_norm)
    data = df.select(F.transform(vector, lambda v: v.cast("double")).alias("x"), F.xxhash64(row_id).alias("h")).cache()
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    norms = len(net.encoder.gammas)
    try:
        for epoch in range(epochs):

            def step(frame: pd.DataFrame, epoch: int = epoch) -> Step:
                rows = frame["h"].to_numpy()
                return _step(net, np.stack(frame["x"].to_numpy()), beta, normals(rows, latent, seed, epoch, 2), Training(rows, dropout, seed, epoch))

            known, flat = distributed(data, step, 4 * norms)
            n = flat[-1]
            net.encoder.follow(known[:norms])
            net.decoder.follow(known[norms : 2 * norms])
            for i, (p, g) in enumerate(zip(net.params(), unflattened(flat[:-2], net.params()), strict=True)):
                p[...], m[i], v[i] = adam_step(p, g / n, m[i], v[i], epoch + 1, rate)
            net.losses.append(flat[-2] / n)
        return net
    finally:
        data.unpersist()


def latents(df: DataFrame, net: Vae, vector: str, row_id: str) -> DataFrame:
    """row_id and the latent mean of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "latent": list(net.encode(np.stack(f["x"].to_numpy()))[0])})

    data = df.select(F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    return data.mapInPandas(run, "id bigint, latent array<double>").withColumnRenamed("id", row_id)
