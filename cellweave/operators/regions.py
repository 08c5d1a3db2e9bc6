"""Regions of grids: flood fill, patches, rectangle sums and resampling, as joins of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed


class _Joined:
    """Sets of numbers that grow together, each named by its least number."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while self.above.get(top, top) != top:
            top = self.above[top]
        while self.above.get(x, x) != top:
            self.above[x], x = top, self.above[x]
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)


def _label_tile(table: pa.Table, width: int) -> np.ndarray:
    """For each cell (r, c) of a tile the least r * width + c of those it touches, step by step: runs of a row, joined to
    those they touch in the row before."""
    at = np.asarray(table.column("r")).astype(np.int64) * width + np.asarray(table.column("c"))
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(sorted_) > 1) | (sorted_[1:] // width != sorted_[:-1] // width)
    run = np.cumsum(fresh) - 1  # a cell met twice is in its run twice
    first = sorted_[fresh]
    up = np.searchsorted(sorted_, sorted_ - width)
    touches = (up < len(at)) & (sorted_[np.minimum(up, len(at) - 1)] == sorted_ - width)
    sets = _Joined()
    for x, y in np.unique(np.stack((run[touches], run[up[touches]]), 1), axis=0).tolist():
        sets.join(x, y)
    least = first[[sets.find(k) for k in range(len(first))]] if len(first) else first
    out = np.empty(len(at), np.int64)
    out[order] = least[run]
    return out


def components(mask: DataFrame, by: list[str], tile: int = 64, width: int = 1 << 20) -> DataFrame:
    """Cells (by, r, c) of mask with label, the same for cells that steps along rows and columns inside it connect: the
    least r * width + c of them. No column may be as large as width; equal cells count once.

    Tiles are labelled one by one, each in one task. Labels that face each other across a border between tiles are links
    of a graph of tiles' labels, which is settled grid by grid: it has as many links as the grid has cells along such
    borders at most. So cells move twice, however far a region winds.
    """
    cells = mask.select(*by, "r", "c").distinct()
    tiled = cells.withColumns({"_tr": F.floor(F.col("r") / tile), "_tc": F.floor(F.col("c") / tile)})
    kinds = T.StructType([*(cells.schema[c] for c in (*by, "r", "c")), T.StructField("label", T.LongType())])

    def label(table: pa.Table) -> pa.Table:
        return table.select([*by, "r", "c"]).append_column("label", pa.array(_label_tile(table, width)))

    labelled = checkpointed(tiled.groupBy(*by, "_tr", "_tc").applyInArrow(label, kinds))
    sides = []
    for x in ("r", "c"):
        near = labelled.where(F.pmod(F.col(x), F.lit(tile)) == tile - 1).select(*by, "r", "c", F.col("label").alias("a"))
        far = labelled.where(F.pmod(F.col(x), F.lit(tile)) == 0).withColumn(x, (F.col(x) - 1).cast(labelled.schema[x].dataType)).select(*by, "r", "c", F.col("label").alias("b"))
        sides.append(near.join(far, [*by, "r", "c"]).select(*by, "a", "b"))
    links = sides[0].unionByName(sides[1]).distinct()

    def settle(table: pa.Table) -> pa.Table:
        sets = _Joined()
        pairs = list(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True))
        for x, y in pairs:
            sets.join(x, y)
        names = sorted({x for pair in pairs for x in pair})
        keys = {c: table.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(names))) for c in by}
        return pa.table(keys | {"label": pa.array(names, pa.int64()), "least": pa.array([sets.find(x) for x in names], pa.int64())})

    settled = links.groupBy(*by).applyInArrow(settle, T.StructType([*(cells.schema[c] for c in by), *(T.StructField(c, T.LongType()) for c in ("label", "least"))]))
    return labelled.join(settled, [*by, "label"], "left").select(*by, "r", "c", F.coalesce("least", "label").alias("label"))


def flood_fill(mask: DataFrame, seeds: DataFrame, by: list[str], tile: int = 64) -> DataFrame:
    """Cells (by, r, c) of mask that a seed reaches by steps along rows and columns inside it; all of mask where a grid has
    no seed inside it."""
    cells = components(mask, by, tile)
    hit = checkpointed(cells.join(seeds.select(*by, "r", "c").distinct(), [*by, "r", "c"], "left_semi").select(*by, "label").distinct())
    filled = cells.join(hit, [*by, "label"], "left_semi")
    empty = cells.join(hit.select(*by).distinct(), by, "left_anti")
    return filled.unionByName(empty).select(*by, "r", "c")


def reflected(x: Column, size: int) -> Column:
    """The index of a line beyond the border, reflected without repeating the border."""
    return F.when(x < 0, -x).when(x >= size, 2 * (size - 1) - x).otherwise(x)


def patches(cells: DataFrame, width: int, size: int, by: list[str], value: str) -> DataFrame:
    """(by, r, c, patch): the values of the width x width cells around each cell, row by row.

    The cells of a row are gathered over their neighbours by a window first, then those rows by a join of 2 * half + 1
    rows, so that width values a cell are shuffled and not width squared.
    """
    half = width // 2
    off = F.sequence(F.lit(-half), F.lit(half))
    line = cells.groupBy(*by, "r").agg(F.array_sort(F.collect_list(F.struct("c", F.col(value).alias("v")))).alias("line"))
    values = line.select(*by, "r", F.transform("line", lambda x: x["v"]).alias("v"))
    rows = values.select(*by, "r", F.explode(off).alias("dr")).withColumn("from", reflected(F.col("r") + F.col("dr"), size))
    met = rows.join(values.withColumnRenamed("r", "from"), [*by, "from"]).groupBy(*by, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("dr", "v"))), lambda x: x["v"]).alias("lines"))
    one = met.select(*by, "r", "lines", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("c"))
    return one.select(*by, "r", "c", F.flatten(F.transform("lines", lambda v: F.transform(off, lambda d: F.element_at(v, (reflected(F.col("c") + d, size) + 1).cast("int"))))).alias("patch"))


def rectangle_sums(prefix: DataFrame, rectangles: DataFrame, by: list[str]) -> DataFrame:
    """rectangles (by, r0, r1, c0, c1; half open) with total, from four corners of prefix sums (by, r, c, total)."""
    corners = F.array(*[F.struct((F.col(r) - 1).alias("r"), (F.col(c) - 1).alias("c"), F.lit(s).alias("sign")) for r, c, s in (("r1", "c1", 1), ("r0", "c1", -1), ("r1", "c0", -1), ("r0", "c0", 1))])
    keys = [c for c in rectangles.columns]
    met = rectangles.select(*keys, F.inline(corners)).join(prefix.withColumnRenamed("total", "_t"), [*by, "r", "c"], "left")
    return met.groupBy(*keys).agg(F.sum(F.col("sign") * F.coalesce("_t", F.lit(0))).alias("total"))


def resampled(cells: DataFrame, size: int, to: int, by: list[str], value: str) -> DataFrame:
    """(by, r, c, value) of a grid of `to` lines: each of its centres weighs the four centres around it, at the border two
    of them are one. Weights are small tables; a cell is met by the centres that use it."""
    at = lambda k: (F.col(k) + 0.5) * size / to - 0.5
    line = cells.sparkSession.range(to).select(F.col("id").cast("int").alias("k")).withColumn("x", at("k"))
    low = F.floor("x").cast("int")
    clip = lambda x: F.least(F.lit(size - 1), F.greatest(F.lit(0), x))
    weights = line.select("k", F.inline(F.array(F.struct(clip(low).alias("i"), (1 - (F.col("x") - low)).alias("w")), F.struct(clip(low + 1).alias("i"), (F.col("x") - low).alias("w"))))).groupBy("k", "i").agg(F.sum("w").alias("w"))
    name = lambda a, b, c: weights.select(F.col("i").alias(a), F.col("k").alias(b), F.col("w").alias(c))
    met = cells.join(F.broadcast(name("r", "to_r", "wr")), "r").join(F.broadcast(name("c", "to_c", "wc")), "c")  # 2 * to rows each
    return met.groupBy(*by, F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum(F.col("wr") * F.col("wc") * F.col(value)).alias(value))
