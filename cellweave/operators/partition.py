"""Balanced rectangles and strips of a grid: a k-d split level by level over prefix sums, without a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kd_rectangles(loads: DataFrame, n: int | str, size: int, by: list[str]) -> DataFrame:
    """(by, leaf, path, r0, r1, c0, c1, load) of balanced rectangles of dense grids of loads (by, r, c, load); n: how many
    at most, or the column of `by` that says how many; leaf: their number in preorder.

    Rows are cut at even depths, columns at odd ones, after the first line at which twice the running load reaches the
    rectangle's load; in the middle where no line but the last does. A rectangle for one part, or one line thin, stays.

    A grid's prefix sums, as many as it has cells, stand in one row. Any rectangle's load is four of them, so all levels
    are one expression on that row, and no level reads cells again or moves anything.
    """
    parts, most = (str(n), n) if isinstance(n, int) else (f"`{n}`", 32)
    total = F.sum("line").over(W.partitionBy(*by, "c").orderBy("r"))
    lines = loads.withColumn("line", F.sum("load").over(W.partitionBy(*by, "r").orderBy("c")))
    grids = lines.select(*by, F.struct("r", "c", total.alias("sum")).alias("at")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["sum"]).alias("sums"))
    # As SQL text: the same expression of columns takes thousands of calls from Python to build.
    ends = ("r0", "r1", "c0", "c1")

    def corner(r: str, c: str) -> str:
        return f"IF({r} > 0 AND {c} > 0, get(sums, ({r} - 1) * {size} + {c} - 1), 0)"

    def load(r0: str, r1: str, c0: str, c1: str) -> str:
        return f"({corner(r1, c1)} - {corner(r0, c1)} - {corner(r1, c0)} + {corner(r0, c0)})"

    def box(path: str, parts: str, **other: str) -> str:
        return f"named_struct('path', {path}, 'parts', {parts}, " + ", ".join(f"'{e}', {other.get(e, f'b.{e}')}" for e in ends) + ")"

    def next_level(boxes: str, lo: str, hi: str) -> str:
        running = lambda end: load(*[end if e == hi else f"b.{e}" for e in ends])
        reached = f"filter(sequence(b.{lo}, b.{hi} - 2), line -> 2 * {running('(line + 1)')} >= {running(f'b.{hi}')})"
        cut = f"coalesce(get({reached}, 0) + 1, CAST(floor((b.{lo} + b.{hi}) / 2) AS INT))"
        half = "CAST(floor(b.parts / 2) AS INT)"
        halves = f"array({box('concat(b.path, ' + repr('0') + ')', half, **{hi: 'k'})}, {box('concat(b.path, ' + repr('1') + ')', f'b.parts - {half}', **{lo: 'k'})})"
        split = f"get(transform(array({cut}), k -> {halves}), 0)"
        return f"flatten(transform({boxes}, b -> IF(b.parts <= 1 OR b.r1 - b.r0 <= 1 OR b.c1 - b.c0 <= 1, array({box('b.path', '1')}), {split})))"

    boxes, depth = f"array(named_struct('path', '', 'parts', CAST({parts} AS INT), 'r0', 0, 'r1', {size}, 'c0', 0, 'c1', {size}))", 0
    while 2**depth < 2 * most:
        boxes = next_level(boxes, *(ends[:2] if depth % 2 == 0 else ends[2:]))
        depth += 1
    loaded = f"transform({boxes}, b -> named_struct('path', b.path, 'r0', b.r0, 'r1', b.r1, 'c0', b.c0, 'c1', b.c1, 'load', CAST({load('b.r0', 'b.r1', 'b.c0', 'b.c1')} AS BIGINT)))"
    one = grids.select(*by, F.posexplode(F.expr(loaded)).alias("leaf", "b"))
    return one.select(*by, "leaf", "b.path", "b.r0", "b.r1", "b.c0", "b.c1", "b.load")


def kd_split(loads: DataFrame, n: int | str, size: int, by: list[str]) -> DataFrame:
    """loads with leaf, path, r0, r1, c0, c1 of the rectangle of each cell, met line by line."""
    lines = kd_rectangles(loads, n, size, by).drop("load").withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)))
    met = loads.join(lines, [*by, "r"]).where((F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1")))
    return met.select(*loads.columns, "leaf", "path", "r0", "r1", "c0", "c1")


def strip_edges(loads: DataFrame, n: int, by: list[str], axis: str = "r", size: int = 64) -> DataFrame:
    """(by, part, edge): strips along an axis, cut before the first line at which the running load reaches part / n of all;
    equal strips where there is no load."""
    rows = loads.groupBy(*by, axis).agg(F.sum("load").alias("load"))
    rows = rows.withColumn("_run", F.sum("load").over(W.partitionBy(*by).orderBy(axis))).withColumn("_all", F.sum("load").over(W.partitionBy(*by)))
    cuts = rows.select(*by, "_run", "_all", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("part"))
    edge = F.when(F.max("_all") <= 0, F.floor(F.col("part") * size / n)).otherwise(F.count_if(n * F.col("_run") < F.col("_all") * F.col("part")))
    return cuts.groupBy(*by, "part").agg(edge.cast("int").alias("edge"))


def strips(loads: DataFrame, n: int, by: list[str], axis: str = "r", size: int = 64) -> DataFrame:
    """(by, leaf, lo, hi): n strips between the distinct edges, the border standing in for those that fall together."""
    edges = strip_edges(loads, n, by, axis, size).groupBy(*by).agg(F.collect_set("edge").alias("e"))
    whole = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), "e", F.array(F.lit(size)))))
    padded = F.concat(whole, F.array_repeat(F.lit(size), F.greatest(F.lit(0), F.lit(n + 1) - F.size(whole))))
    rows = edges.select(*by, padded.alias("e")).select(*by, "e", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("leaf"))
    lo, hi = F.get("e", F.col("leaf")), F.get("e", F.col("leaf") + 1)
    return rows.select(*by, "leaf", lo.alias("lo"), F.when(hi <= lo, F.least(lo + 1, F.lit(size))).otherwise(hi).alias("hi"))


def relative_time(parts: DataFrame, by: list[str], load: str = "load") -> DataFrame:
    """The largest part's share of all load; null without load."""
    total = F.sum(load).cast("double")
    return parts.groupBy(*by).agg(F.round(F.max(load) / F.when(total > 0, total), 8).alias("relative_time"))


def sql_kd(n: int, size: int, source: str) -> str:
    """The CTEs of the same split over `source` (scenario, r, c, load); the last is kd."""
    depth, before, out = 0, f"(SELECT *, '' AS path, {n} AS parts, 0 AS r0, {size} AS r1, 0 AS c0, {size} AS c1 FROM {source})", []
    while 2**depth < 2 * n:
        x, lo, hi = ("r", "r0", "r1") if depth % 2 == 0 else ("c", "c0", "c1")
        out.append(f"a{depth} AS (SELECT *, sum(load) OVER (PARTITION BY scenario, path ORDER BY {x} RANGE UNBOUNDED PRECEDING) AS run, sum(load) OVER (PARTITION BY scenario, path) AS tot FROM {before})")
        out.append(f"b{depth} AS (SELECT *, coalesce(min(CASE WHEN 2 * run >= tot AND {x} < {hi} - 1 THEN {x} + 1 END) OVER (PARTITION BY scenario, path), ({lo} + {hi}) // 2) AS cut, parts <= 1 OR r1 - r0 <= 1 OR c1 - c0 <= 1 AS leaf FROM a{depth})")
        bounds = ", ".join(f"CASE WHEN NOT leaf AND {x} >= cut THEN cut ELSE {e} END AS {e}" if e == lo else f"CASE WHEN NOT leaf AND {x} < cut THEN cut ELSE {e} END AS {e}" if e == hi else e for e in ("r0", "r1", "c0", "c1"))
        out.append(f"k{depth} AS (SELECT scenario, r, c, load, CASE WHEN leaf THEN path WHEN {x} >= cut THEN path || '1' ELSE path || '0' END AS path, CASE WHEN leaf THEN 1 WHEN {x} >= cut THEN parts - parts // 2 ELSE parts // 2 END AS parts, {bounds} FROM b{depth})")
        before = f"k{depth}"
        depth += 1
    return ", ".join(out) + f", kd AS (SELECT * FROM {before})"
