"""Training of window models: gradients summed by partition, Adam on the driver, a rate that falls on plateaus.

The driver holds the weights alone. A step sends them to the tasks, each of which adds up loss and gradients over its
tiles; pieces of the gradient are summed across tasks by their number, so that the driver gets one gradient a step
whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .convolution import Layer, backward, forward, halo_tiles, n_parameters, new_layers, predicted, unpacked

PIECE = 1 << 14  # numbers of a gradient that travel together


@dataclass
class WindowModel:
    """A trained model with all that prediction needs; history: a row for each epoch."""

    window: int
    channels: list[str]
    mean: list[float]
    std: list[float]
    layers: list[Layer]
    target: str = "time"
    history: list[tuple] = field(default_factory=list)

    def normed(self, cells: DataFrame) -> DataFrame:
        """Channels less their mean over their deviation, both of the training grids."""
        return cells.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.channels, self.mean, self.std, strict=True)})

    def predict(self, cells: DataFrame, size: int, by: list[str], tile: int = 64, scale: float = 1.0, value: str = "load") -> DataFrame:
        """(by, r, c, value) of every cell: a time is no less than 0, times scale; a logit becomes a probability."""
        tiles = halo_tiles(self.normed(cells), self.channels, size, tile, self.window, by)
        out = predicted(tiles, self.layers, size, tile, self.window, by, value)
        x = F.col(value)
        return out.withColumn(value, F.greatest(x, F.lit(0.0)) * scale if self.target == "time" else 1 / (1 + F.exp(-x)))

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = [(f"{k}{part}", list(a.shape), a.ravel().tolist()) for k, pair in enumerate(self.layers) for part, a in zip("wb", pair, strict=True)]
        rows = [*arrays, ("mean", [len(self.mean)], self.mean), ("std", [len(self.std)], self.std)]
        table = spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>")
        table.withColumns({"window": F.lit(self.window), "channels": F.lit(",".join(self.channels)), "target": F.lit(self.target)}).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WindowModel:
        rows = {r.name: r for r in spark.read.parquet(path).collect()}
        array = lambda name: np.array(rows[name].numbers).reshape(rows[name]["shape"])
        layers = [(array(f"{k}w"), array(f"{k}b")) for k in range((len(rows) - 2) // 2)]
        any_row = rows["mean"]
        return cls(any_row.window, any_row.channels.split(","), list(rows["mean"].numbers), list(rows["std"].numbers), layers, any_row.target)


def _flat(layers: list[Layer]) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in layers for a in pair])


def _shaped(flat: np.ndarray, like: list[Layer]) -> list[Layer]:
    out, at = [], 0
    for pair in like:
        own = []
        for a in pair:
            own.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        out.append((own[0], own[1]))
    return out


def losses(out: np.ndarray, y: np.ndarray, target: str, pos_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile: its sums (cells, loss, and over burned cells: cells and loss, or hits, said, true), the slope of the loss
    sum at each cell."""
    if target == "time":
        error, burned = out - y, y > 0
        return np.array([y.size, (error**2).sum(), burned.sum(), (error[burned] ** 2).sum(), 0.0]), 2 * error
    true, said = y > 0.5, out > 0
    weight = np.where(true, pos_weight, 1.0)
    p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
    loss = weight * (np.maximum(out, 0) - out * true + np.log1p(np.exp(-np.abs(out))))
    return np.array([y.size, loss.sum(), (true & said).sum(), said.sum(), true.sum()]), np.where(true, pos_weight * (p - 1), p)


def summed(tiles: DataFrame, layers: list[Layer], size: int, tile: int, window: int, target: str, pos_weight: float, gradients: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the losses over all tiles, and of the gradients if asked for."""
    spark = tiles.sparkSession
    shared = spark.sparkContext.broadcast(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = shared.value
        sums, total = np.zeros(5), np.zeros(n_parameters(layers) if gradients else 0)
        for b in batches:
            for k in range(b.num_rows):
                r0, c0 = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                y = unpacked(b.column(3)[k], 1, r0, c0, size, tile, 1)[0]
                out, inputs = forward(unpacked(b.column(2)[k], layers[0][0].shape[1], r0, c0, size, tile, window), layers)
                own, slope = losses(out, y, target, pos_weight)
                sums += own
                if gradients:
                    total += _flat(backward(slope, inputs, layers))
        pieces = [sums, *(total[k : k + PIECE] for k in range(0, len(total), PIECE))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.astype("<f8").tobytes() for p in pieces], pa.binary())], ["piece", "numbers"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in table.column("numbers"))
        return pa.table({"piece": table.column("piece").slice(0, 1), "numbers": pa.array([total.tobytes()], pa.binary())})

    parts = tiles.select("r0", "c0", "data", "target").mapInArrow(run, "piece int, numbers binary")
    found = {r.piece: np.frombuffer(bytes(r.numbers), "<f8") for r in parts.groupBy("piece").applyInArrow(added, "piece int, numbers binary").collect()}
    shared.destroy()
    rest = [found[k] for k in sorted(found) if k]
    return found.get(0, np.zeros(5)), np.concatenate(rest) if rest else np.zeros(0)


class Adam:
    def __init__(self, n: int, rate: float, decay: float):
        self.m, self.v, self.t, self.rate, self.decay = np.zeros(n), np.zeros(n), 0, rate, decay

    def step(self, x: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        gradient = gradient + self.decay * x
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Plateau:
    """Halves a rate when a loss has not fallen by a ten-thousandth of itself for more than `patience` epochs."""

    def __init__(self, patience: int = 5, factor: float = 0.5):
        self.patience, self.factor, self.best, self.bad = patience, factor, np.inf, 0

    def rate(self, rate: float, loss: float) -> float:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
            return rate
        self.bad += 1
        if self.bad > self.patience:
            self.bad = 0
            return rate * self.factor
        return rate


def channel_norm(cells: DataFrame, channels: list[str]) -> tuple[list[float], list[float]]:
    row = cells.agg(*[F.avg(c).cast("double").alias(f"m{k}") for k, c in enumerate(channels)], *[F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(1e-6)).alias(f"s{k}") for k, c in enumerate(channels)]).first()
    return [row[f"m{k}"] or 0.0 for k in range(len(channels))], [row[f"s{k}"] for k in range(len(channels))]


def train(
    cells: DataFrame,
    channels: list[str],
    label: str,
    size: int,
    by: list[str],
    window: int = 21,
    target: str = "time",
    widths: tuple[int, int, int] = (32, 64, 128),
    dense: int = 256,
    epochs: int = 50,
    steps: int = 4,
    rate: float = 1e-3,
    decay: float = 1e-4,
    patience: int = 10,
    tile: int = 64,
    seed: int = 7,
) -> WindowModel:
    """The model of the epoch with the least test loss. cells: dense grids (by, split, r, c, channels, label), of which those
    with split 'train' train and give the norm, those with 'test' test; without test grids the training loss decides.

    target 'time' fits the label by squares, 'burn' fits whether it is above 0 by weighted cross entropy. An epoch takes
    `steps` steps, each over the tiles that a hash deals to it. history: (epoch, train_loss, test_loss, a, b, rate), where a
    and b are the mean square over burned cells and its root, or recall and precision.
    """
    training = cells.where("split = 'train'")
    mean, std = channel_norm(training, channels)
    model = WindowModel(window, list(channels), mean, std, new_layers(window, len(channels), widths, dense, seed), target)
    y = F.col(label).cast("double") if target == "time" else (F.col(label) > 0).cast("double")
    tiles = checkpointed(halo_tiles(model.normed(cells).withColumn("_y", y), channels, size, tile, window, [*by, "split"], "_y"))
    mine, others = tiles.where("split = 'train'"), tiles.where("split = 'test'")
    if mine.isEmpty():
        raise ValueError("there is no training grid")
    pos_weight = 1.0
    if target == "burn":
        counts = training.agg(F.count_if(F.col(label) > 0).alias("pos"), F.count("*").alias("n")).first()
        pos_weight = (counts.n - counts.pos) / max(counts.pos, 1)
    of = (size, tile, window, target, pos_weight)
    x, adam, plateau, best, waited = _flat(model.layers), Adam(n_parameters(model.layers), rate, decay), Plateau(), (np.inf, model.layers), 0
    tested = not others.isEmpty()
    for epoch in range(1, epochs + 1):
        loss, cells_seen = 0.0, 0.0
        for k in range(steps):
            dealt = mine.where(F.pmod(F.xxhash64(*by, "r0", "c0", F.lit(epoch + 1000 * seed)), F.lit(steps)) == k) if steps > 1 else mine
            sums, gradient = summed(dealt, _shaped(x, model.layers), *of, True)
            if sums[0]:
                x = adam.step(x, gradient / sums[0])
                loss, cells_seen = loss + sums[1], cells_seen + sums[0]
        layers = _shaped(x, model.layers)
        train_loss = loss / cells_seen
        sums, _ = summed(others if tested else mine, layers, *of, False)
        test_loss = sums[1] / sums[0]
        burned = sums[3] / max(sums[2], 1)
        second = (burned, burned**0.5) if target == "time" else (sums[2] / max(sums[4], 1), sums[2] / max(sums[3], 1))
        model.history.append((epoch, float(train_loss), float(test_loss), *map(float, second), float(adam.rate)))
        adam.rate = plateau.rate(adam.rate, test_loss)
        waited = 0 if test_loss < best[0] else waited + 1
        best = (test_loss, layers) if test_loss < best[0] else best
        if waited >= patience:
            break
    model.layers = best[1]
    return model


def sweep(cells: DataFrame, windows: tuple[int, ...] = (9, 12, 15, 18, 21), **params) -> list[tuple]:
    """(window, best test loss, parameters, epochs) of a model for each window."""
    out = []
    for window in windows:
        model = train(cells, window=window, **params)
        out.append((window, min(h[2] for h in model.history), n_parameters(model.layers), len(model.history)))
    return out
