"""Range joins of points and rectangles as equi-joins on buckets of both axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ("x0", "x1", "y0", "y1")


def _level(lo: str, hi: str) -> Column:
    """The least power of two that is no less than the extent."""
    return F.ceil(F.log2((F.col(hi) - F.col(lo)).cast("double"))).cast("int")


def _bucket(x: Column, level: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(2.0), level)).cast("long")


def range_join(points: DataFrame, rectangles: DataFrame, x: str, y: str, by: tuple[str, ...] = (), bounds: tuple[str, str, str, str] = BOUNDS) -> DataFrame:
    """Each point (by, x, y, ...) with each rectangle (by, bounds, ...) that holds it: x0 <= x < x1 and y0 <= y < y1.

    A rectangle lies in at most two buckets of an axis as wide as the next power of two of its extent, so in four cells at
    most; a point lies in one cell of each pair of widths that some rectangle has. These pairs, as many as there are shapes
    up to a factor of two, go through the driver. No pair of a point and a rectangle is met twice. Rectangles without
    extent, and nulls, meet nothing. Columns of both sides but `by` must differ in name.
    """
    x0, x1, y0, y1 = bounds
    shaped = rectangles.where((F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0))).withColumns({"_lx": _level(x0, x1), "_ly": _level(y0, y1)})
    across = F.sequence(_bucket(F.col(x0), F.col("_lx")), _bucket(F.col(x1), F.col("_lx")))
    down = F.sequence(_bucket(F.col(y0), F.col("_ly")), _bucket(F.col(y1), F.col("_ly")))
    spread = shaped.withColumn("_bx", F.explode(across)).withColumn("_by", F.explode(down))
    widths = [(r["_lx"], r["_ly"]) for r in shaped.select("_lx", "_ly").distinct().collect()]
    pairs = F.array(*[F.struct(F.lit(a).alias("_lx"), F.lit(b).alias("_ly")) for a, b in sorted(widths)]) if widths else F.lit(None).cast("array<struct<_lx:int,_ly:int>>")
    placed = points.select("*", F.inline(pairs)).withColumns({"_bx": _bucket(F.col(x), F.col("_lx")), "_by": _bucket(F.col(y), F.col("_ly"))})
    met = placed.join(spread, [*by, "_lx", "_ly", "_bx", "_by"])
    inside = (F.col(x) >= F.col(x0)) & (F.col(x) < F.col(x1)) & (F.col(y) >= F.col(y0)) & (F.col(y) < F.col(y1))
    return met.where(inside).drop("_lx", "_ly", "_bx", "_by")
