"""Networks whose layers share the statistics of a batch over all tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.operators import layers, mlp, vae


def differences(loss, params, found):
    for p, g in zip(params, found, strict=True):
        for at in list(np.ndindex(p.shape))[:5]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=2e-4)


@pytest.mark.parametrize("batch_norm", [False, True])
def test_gradients_of_a_deep_autoencoder_equal_differences(batch_norm):
    draw = np.random.default_rng(3)
    net = vae.new(5, 2, (6, 4), 1, batch_norm)
    for p in net.params():
        p += 0.1 * draw.normal(size=p.shape)  # off the kinks
    x, noise = draw.random((11, 5)), draw.normal(size=(11, 2))
    differences(lambda: vae.gradients(net, x, 0.7, noise)[1], net.params(), vae.gradients(net, x, 0.7, noise)[0])


def test_a_batch_in_parts_has_the_gradients_of_the_whole():
    draw = np.random.default_rng(5)
    net = mlp.initialise([3, 6, 5, 3], [0, 1, 2], mlp.Options(hidden=(6, 5), batch_norm=True))
    x, y, rows = draw.normal(size=(40, 3)), draw.integers(0, 3, 40), draw.integers(0, 2**60, 40)

    def step(part):
        return mlp._step(net, x[part], y[part], layers.Training(rows[part], 0.3, 7, 2))

    parts, known = np.array_split(draw.permutation(40), 4), []
    for _ in range(5):  # two sums forwards, two backwards, and what is returned
        known.append(sum(layers.replayed(step(p), known) for p in parts))
    assert known[-1] == pytest.approx(layers.alone(step(np.arange(40))))
    assert known[-1][-1] == 40


def test_draws_belong_to_rows_and_are_uniform():
    rows = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    u = layers.uniforms(rows, 7, 42, 1, 0)
    assert (layers.uniforms(rows[::-1], 7, 42, 1, 0)[::-1] == u).all()
    assert (layers.uniforms(rows, 7, 42, 2, 0) != u).all()
    assert abs(u.mean() - 0.5) < 0.01 and u.min() >= 0 and u.max() < 1
    assert abs(np.corrcoef(u.T) - np.eye(7)).max() < 0.08
    z = layers.normals(rows, 3, 9)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(6)
    x = draw.random((60, 4))
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y int")


def test_fits_do_not_depend_on_the_partitioning(rows):
    options = mlp.Options(hidden=(5,), rate=0.05, epochs=3, optimiser="adam", dropout=0.3, batch_norm=True)
    one, many = (mlp.fit(rows.repartition(p), "v", "y", "id", options) for p in (1, 8))
    for a, b in zip(one.params(), many.params(), strict=True):
        assert a == pytest.approx(b, rel=1e-7, abs=1e-8)  # a bias before a normalisation has no gradient but rounding
    guessed = [dict(mlp.predict(rows, net, "v").select("id", F.col("probabilities")[1]).collect()) for net in (one, many)]
    assert guessed[0] == pytest.approx(guessed[1])


def test_a_deep_autoencoder_learns_and_does_not_depend_on_the_partitioning(rows):
    one, many = (vae.fit(rows.repartition(p), "v", "id", 2, (6, 4), 3, batch_norm=True, dropout=0.1) for p in (1, 6))
    for a, b in zip(one.params(), many.params(), strict=True):
        assert a == pytest.approx(b, rel=1e-7, abs=1e-8)
    plain = vae.fit(rows, "v", "id", 2, 6, 15, rate=0.05)
    assert plain.losses[-1] < plain.losses[0]
    z = vae.latents(rows, plain, "v", "id").collect()
    assert len(z) == 60 and len(z[0]["latent"]) == 2
    assert plain.decode(np.zeros((2, 2))).shape == (2, 4)
