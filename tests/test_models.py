"""Window models against plain NumPy: windows one by one, whole grids at once, finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import convolution, training
from cellweave.plans import models

SIZE, CHANNELS = 11, ["a", "b"]


@pytest.fixture(scope="module")
def grids(spark):
    """Three grids (the last one for tests) as a table and as arrays."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3, 2, SIZE, SIZE)).astype(np.float32), rng.uniform(0, 1, (3, SIZE, SIZE)).astype(np.float32)
    y[y < 0.3] = 0
    rows = [(g, "test" if g == 2 else "train", r, c, float(x[g, 0, r, c]), float(x[g, 1, r, c]), float(y[g, r, c])) for g in range(3) for r in range(SIZE) for c in range(SIZE)]
    return spark.createDataFrame(rows, "g int, split string, r int, c int, a double, b double, y double"), x.astype(float), y.astype(float)


def one_by_one(x, layers, window):
    """The model over each cell's own window of the reflected grid, as sums over all places of a layer."""
    half = window // 2
    padded = np.pad(x, ((0, 0), (half, half), (half, half)), mode="reflect")
    out = np.zeros(x.shape[1:])
    for r, c in np.ndindex(out.shape):
        v = padded[:, r : r + window, c : c + window]
        for k, (w, b) in enumerate(layers):
            n, width = v.shape[1] - w.shape[2] + 1, w.shape[2]
            v = np.array([[[(w[o] * v[:, i : i + width, j : j + width]).sum() + b[o] for j in range(n)] for i in range(n)] for o in range(len(w))])
            v = v if k + 1 == len(layers) else np.maximum(v, 0)
        out[r, c] = v[0, 0, 0]
    return out


def collected(df, value, n=3):
    out = np.full((n, SIZE, SIZE), np.nan)
    for r in df.collect():
        out[r.g, r.r, r.c] = r[value]
    return out


@pytest.mark.parametrize(("window", "tile"), [(9, 4), (9, 11), (12, 3), (12, 64), (7, 1)])
def test_tiles_equal_windows(grids, window, tile):
    cells, x, _ = grids
    layers = convolution.new_layers(window, 2, (3, 2, 3), 4)
    tiles = convolution.halo_tiles(cells, CHANNELS, SIZE, tile, window, ["g"])
    got = collected(convolution.predicted(tiles, layers, SIZE, tile, window, ["g"]), "value")
    assert tiles.count() == 3 * (-(-SIZE // tile)) ** 2
    np.testing.assert_allclose(got[0], one_by_one(x[0], layers, window), atol=1e-5)
    half = window // 2
    for g in range(3):
        whole, _ = convolution.forward(np.pad(x[g], ((0, 0), (half, half), (half, half)), mode="reflect"), layers)
        np.testing.assert_allclose(got[g], whole[:SIZE, :SIZE], atol=1e-5)


def test_a_grid_too_small_to_reflect(grids):
    with pytest.raises(ValueError, match="reflected"):
        convolution.halo_tiles(grids[0], CHANNELS, SIZE, 4, 2 * SIZE, ["g"])
    with pytest.raises(ValueError, match="window of 7"):
        convolution.new_layers(5, 2)


def test_batch_norm_folds_in():
    rng = np.random.default_rng(0)
    layer, x = (rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)), rng.normal(size=(2, 5, 5))
    gamma, beta, mean, var = rng.normal(size=3), rng.normal(size=3), rng.normal(size=3), rng.uniform(0.5, 2, 3)
    plain = convolution._convolved(x, layer[0]) + layer[1][:, None, None]
    want = (plain - mean[:, None, None]) / np.sqrt(var + 1e-5)[:, None, None] * gamma[:, None, None] + beta[:, None, None]
    w, b = convolution.with_norm(layer, gamma, beta, mean, var)
    np.testing.assert_allclose(convolution._convolved(x, w) + b[:, None, None], want)


@pytest.mark.parametrize("window", [9, 12, 15, 18, 21])
def test_number_of_parameters(window):
    """Without the norms' 2 x 224: three layers, a dense one over what is left of the window, one number out."""
    want = 14 * 9 * 32 + 32 + 32 * 9 * 64 + 64 + 64 * 9 * 128 + 128 + 128 * (window - 6) ** 2 * 256 + 256 + 257
    assert convolution.n_parameters(convolution.new_layers(window, 14)) == want


@pytest.mark.parametrize("target", ["time", "burn"])
def test_gradient_by_finite_differences(target):
    rng = np.random.default_rng(1)
    layers = convolution.new_layers(8, 2, (2, 3, 2), 3, seed=4)
    x, y = rng.normal(size=(2, 12, 12)), (rng.uniform(size=(5, 5)) > 0.5) * rng.uniform(size=(5, 5))
    y = y if target == "time" else (y > 0).astype(float)

    def loss(flat):
        out, _ = convolution.forward(x, training._shaped(flat, layers))
        return training.losses(out, y, target, 3.0)[0][1]

    flat = training._flat(layers)
    out, inputs = convolution.forward(x, layers)
    got = training._flat(convolution.backward(training.losses(out, y, target, 3.0)[1], inputs, layers))
    for k in rng.choice(len(flat), 40, replace=False):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert got[k] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("target", ["time", "burn"])
def test_training_against_whole_grids(grids, target):
    """Two epochs of one step: tiles of any make give what whole training grids give, and test grids do not train."""
    cells, x, y = grids
    params = {"widths": (2, 3, 2), "dense": 3, "epochs": 2, "steps": 1, "rate": 1e-2}
    model = training.train(cells, CHANNELS, "y", SIZE, ["g"], window=9, target=target, tile=4, **params)
    flat_x = x[:2].transpose(1, 0, 2, 3).reshape(2, -1)
    mean, std = flat_x.mean(1), flat_x.std(1, ddof=1)
    np.testing.assert_allclose(model.mean, mean, atol=1e-6)
    np.testing.assert_allclose(model.std, std, atol=1e-6)
    goal = y if target == "time" else (y > 0).astype(float)
    weight = 1.0 if target == "time" else (goal[:2] == 0).sum() / (goal[:2] > 0).sum()
    padded = np.pad((x - mean[:, None, None]) / std[:, None, None], ((0, 0), (0, 0), (4, 4), (4, 4)), mode="reflect")
    layers = convolution.new_layers(9, 2, (2, 3, 2), 3)
    flat, m, v = training._flat(layers), 0.0, 0.0
    for t in (1, 2):
        total, loss = 0.0, 0.0
        own = training._shaped(flat, layers)
        for g in (0, 1):
            out, inputs = convolution.forward(padded[g], own)
            sums, slope = training.losses(out, goal[g], target, weight)
            total, loss = total + training._flat(convolution.backward(slope, inputs, own)), loss + sums[1]
        assert model.history[t - 1][1] == pytest.approx(loss / (2 * SIZE * SIZE), rel=1e-5)
        gradient = total / (2 * SIZE * SIZE) + 1e-4 * flat
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        flat = flat - 1e-2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        out, _ = convolution.forward(padded[2], training._shaped(flat, layers))
        assert model.history[t - 1][2] == pytest.approx(training.losses(out, goal[2], target, weight)[0][1] / SIZE**2, rel=1e-4)
    assert [h[0] for h in model.history] == [1, 2] and min(h[2] for h in model.history) == model.history[-1][2]
    np.testing.assert_allclose(training._flat(model.layers), flat, atol=1e-5)


def test_prediction_save_and_load(spark, grids, tmp_path):
    cells, x, _ = grids
    model = training.train(cells, CHANNELS, "y", SIZE, ["g"], window=8, widths=(2, 2, 2), dense=3, epochs=1, tile=5)
    model.save(spark, str(tmp_path / "model"))
    again = training.WindowModel.load(spark, str(tmp_path / "model"))
    assert (again.window, again.channels, again.target) == (8, CHANNELS, "time")
    first, second = (collected(m.predict(cells, SIZE, ["g"], tile, 100.0), "load") for m, tile in ((model, 5), (again, 11)))
    np.testing.assert_allclose(first, second, atol=1e-4)
    normed = (x[1] - np.array(model.mean)[:, None, None]) / np.array(model.std)[:, None, None]
    np.testing.assert_allclose(first[1], 100 * np.maximum(one_by_one(normed, model.layers, 8), 0), atol=1e-3)


def test_stops_early_and_keeps_the_best(grids):
    model = training.train(grids[0], CHANNELS, "y", SIZE, ["g"], window=7, widths=(2, 2, 2), dense=2, epochs=30, rate=3.0, patience=2, tile=11)
    losses = [h[2] for h in model.history]
    assert len(losses) < 30 and losses.index(min(losses)) == len(losses) - 3


def test_rate_falls_on_plateaus():
    plateau, rate, seen = training.Plateau(patience=2), 1.0, []
    for loss in (5.0, 4.0, 4.0, 4.1, 4.2, 4.0, 3.0, 3.0):
        rate = plateau.rate(rate, loss)
        seen.append(rate)
    assert seen == [1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5]


def test_no_grid_to_train_on(grids):
    with pytest.raises(ValueError, match="no training grid"):
        training.train(grids[0].where("split = 'test'"), CHANNELS, "y", SIZE, ["g"], window=7)


def test_queries(spark, medium):
    history = models.load_model_history(spark, medium).orderBy("epoch").collect()
    assert [r.epoch for r in history] == list(range(1, 7)) and history[-1].test_loss < history[0].test_loss
    cells = models._cells(spark, medium).count()
    for name, column, top in (("predicted_load", "load", 1e6), ("burn_probability", "probability", 1)):
        row = getattr(models, name)(spark, medium).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_distinct("scenario", "r", "c").alias("d")).first()
        assert row.n == row.d == cells and 0 <= row.lo <= row.hi <= top
    assert {r.atomic_size for r in models.load_model_sweep(spark, medium).collect()} == {9, 12, 15, 18, 21}
