"""Convolution of whole grids by tiles with a halo, and what a window model needs of it: layers, gradients, prediction.

A model that looks at the A x A window around each cell is a stack of convolutions without padding: three of 3 x 3, one
as wide as what is left of the window, one of 1 x 1, with rectifiers between. Over a tile with A - 1 more rows and columns
it gives all the tile's cells at once, as windows that overlap share their work. Grids are reflected at their borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Layer = tuple[np.ndarray, np.ndarray]  # weights (out, in, k, k) and biases (out)


def new_layers(window: int, channels: int, widths: tuple[int, int, int] = (32, 64, 128), dense: int = 256, seed: int = 7) -> list[Layer]:
    """Weights drawn from +-sqrt(1 / inputs), the last bias 0."""
    rng, out = np.random.default_rng(seed), []
    if window < 7:
        raise ValueError("three layers of 3 x 3 need a window of 7 at least")
    for n_in, n_out, k in zip((channels, *widths, dense), (*widths, dense, 1), (3, 3, 3, window - 6, 1), strict=True):
        bound = (n_in * k * k) ** -0.5
        out.append((rng.uniform(-bound, bound, (n_out, n_in, k, k)), np.zeros(n_out)))
    return out


def with_norm(layer: Layer, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray, var: np.ndarray, eps: float = 1e-5) -> Layer:
    """A layer that a batch norm follows, as one layer."""
    scale = gamma / np.sqrt(var + eps)
    return layer[0] * scale[:, None, None, None], (layer[1] - mean) * scale + beta


def n_parameters(layers: list[Layer]) -> int:
    return sum(w.size + b.size for w, b in layers)


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))  # (in, rows, columns, k, k)


def _convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.tensordot(w, _windows(x, w.shape[2]), ([1, 2, 3], [0, 3, 4]))


def forward(x: np.ndarray, layers: list[Layer]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The last layer's map, and each layer's input."""
    inputs = []
    for k, (w, b) in enumerate(layers):
        inputs.append(x)
        x = _convolved(x, w) + b[:, None, None]
        if k + 1 < len(layers):
            x = np.maximum(x, 0)
    return x[0], inputs


def backward(slope: np.ndarray, inputs: list[np.ndarray], layers: list[Layer]) -> list[Layer]:
    """Gradients of all weights and biases from the slope of the loss at each place of the last map."""
    out, slope = [], slope[None]
    for k in reversed(range(len(layers))):
        w, x = layers[k][0], inputs[k]
        out.append((np.tensordot(slope, _windows(x, w.shape[2]), ([1, 2], [1, 2])), slope.sum((1, 2))))
        if k:
            edge = w.shape[2] - 1
            padded = np.pad(slope, ((0, 0), (edge, edge), (edge, edge)))
            slope = _convolved(padded, w[:, :, ::-1, ::-1].transpose(1, 0, 2, 3)) * (x > 0)
    return out[::-1]


def _places(x: Column, size: int, tile: int, window: int) -> Column:
    """Where a line of the grid is needed: (t, at) of each tile, as itself and as a reflection beyond the borders."""
    half = window // 2
    mirrored = F.array(x + half, F.when((x >= 1) & (x <= half), half - x), F.when((x >= size - 1 - half) & (x <= size - 2), half + 2 * (size - 1) - x))

    def tiles(p: Column) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil((p - window + 2) / tile).cast("int") - 1), F.least(F.lit((size - 1) // tile), F.floor(p / tile).cast("int"))
        found = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(found, lambda t: F.struct(t.alias("t"), (p - t * tile).cast("int").alias("at")))

    return F.flatten(F.transform(F.filter(mirrored, lambda p: p.isNotNull()), tiles))


def halo_tiles(cells: DataFrame, channels: list[str], size: int, tile: int, window: int, by: list[str], target: str | None = None) -> DataFrame:
    """(by, r0, c0, data, target): a row for each tile of dense grids of size x size cells (by, r, c, channels).

    data: the channels' values over the tile and its halo, target: the tile's own, both packed 32-bit floats. Each cell is
    sent to the tiles that need it, reflections included, in one shuffle; a group holds one tile.
    """
    if window // 2 >= size:
        raise ValueError("a grid can't be reflected over more lines than it has less one")
    values = [F.col(c).cast("float").alias(c) for c in dict.fromkeys([*channels, *([target] if target else [])])]
    rows = cells.select(*by, "r", "c", *values)
    spread = rows.select(*by, *values, "c", F.inline(_places(F.col("r"), size, tile, window))).withColumnsRenamed({"t": "tr", "at": "i"})
    spread = spread.select("*", F.inline(_places(F.col("c"), size, tile, window))).withColumnsRenamed({"t": "tc", "at": "j"}).drop("c")
    half = window // 2
    schema = T.StructType([*(cells.schema[c] for c in by), *(T.StructField(c, T.IntegerType()) for c in ("r0", "c0")), *(T.StructField(c, T.BinaryType()) for c in ("data", "target"))])

    def packed(table: pa.Table) -> pa.Table:
        r0, c0 = table.column("tr")[0].as_py() * tile, table.column("tc")[0].as_py() * tile
        height, width = min(tile, size - r0), min(tile, size - c0)
        i, j = np.asarray(table.column("i")), np.asarray(table.column("j"))
        inside = (i < height + window - 1) & (j < width + window - 1)
        data = np.zeros((len(channels), height + window - 1, width + window - 1), "<f4")
        for k, c in enumerate(channels):
            data[k, i[inside], j[inside]] = np.asarray(table.column(c))[inside]
        own = b""
        if target:
            y = np.zeros((height, width), "<f4")
            mine = (i >= half) & (i < half + height) & (j >= half) & (j < half + width)
            y[i[mine] - half, j[mine] - half] = np.asarray(table.column(target))[mine]
            own = y.tobytes()
        keys = {c: table.column(c).slice(0, 1) for c in by}
        return pa.table(keys | {"r0": pa.array([r0], pa.int32()), "c0": pa.array([c0], pa.int32()), "data": pa.array([data.tobytes()], pa.binary()), "target": pa.array([own], pa.binary())})

    return spread.groupBy(*by, "tr", "tc").applyInArrow(packed, schema)


def unpacked(data: pa.Scalar, n_channels: int, r0: int, c0: int, size: int, tile: int, window: int) -> np.ndarray:
    """The channels of a tile with its halo; with a window of 1 and one channel, its target."""
    height, width = min(tile, size - r0), min(tile, size - c0)
    return np.frombuffer(data.as_buffer(), "<f4").reshape(n_channels, height + window - 1, width + window - 1).astype(np.float64)


def predicted(tiles: DataFrame, layers: list[Layer], size: int, tile: int, window: int, by: list[str], value: str = "value") -> DataFrame:
    """(by, r, c, value) of every cell, the last map's values; a batch for each tile, the weights broadcast."""
    shared = tiles.sparkSession.sparkContext.broadcast(layers)
    schema = T.StructType([*(tiles.schema[c] for c in by), *(T.StructField(c, T.IntegerType()) for c in ("r", "c")), T.StructField(value, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = shared.value
        n = layers[0][0].shape[1]
        for b in batches:
            for k in range(b.num_rows):
                r0, c0 = b.column("r0")[k].as_py(), b.column("c0")[k].as_py()
                out, _ = forward(unpacked(b.column("data")[k], n, r0, c0, size, tile, window), layers)
                r, c = np.divmod(np.arange(out.size), out.shape[1])
                keys = [b.column(x).slice(k, 1).take(pa.array(np.zeros(out.size, np.int32))) for x in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((r + r0).astype(np.int32)), pa.array((c + c0).astype(np.int32)), pa.array(out.ravel())], schema.names)

    return tiles.select(*by, "r0", "c0", "data").mapInArrow(run, schema)
