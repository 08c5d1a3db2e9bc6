"""Golden cases of splits, codes and rates, and relaxation against a heap."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import rates
from cellweave.grid import cells, fuels
from cellweave.operators import partition, spread
from cellweave.plans import core

LEAVES = [
    (lambda r, c: 1, 4, [(0, 2, 0, 2, 4), (0, 2, 2, 4, 4), (2, 4, 0, 2, 4), (2, 4, 2, 4, 4)]),
    (lambda r, c: 0, 4, [(0, 1, 0, 4, 0), (1, 4, 0, 1, 0), (1, 4, 1, 4, 0)]),
    (lambda r, c: int(r == 3), 2, [(0, 2, 0, 4, 0), (2, 4, 0, 4, 4)]),
    (lambda r, c: 8 * (r == 0 and c == 0), 4, [(0, 1, 0, 4, 8), (1, 4, 0, 1, 0), (1, 4, 1, 4, 0)]),
    (lambda r, c: c + 1, 3, [(0, 2, 0, 4, 20), (2, 4, 0, 3, 12), (2, 4, 3, 4, 8)]),
]


@pytest.mark.parametrize("load, n, want", LEAVES)
def test_golden_leaves(spark, load, n, want):
    grid = spark.createDataFrame([(1, r, c, load(r, c)) for r in range(4) for c in range(4)], "scenario int, r int, c int, load long")
    got = partition.kd_rectangles(grid, n, 4, ["scenario"]).orderBy("leaf").collect()
    assert [(x.r0, x.r1, x.c0, x.c1, x.load) for x in got] == want


def test_decode(spark):
    values = [(0.4, 0), (0.5, 1), (13.4, 13), (13.5, 0), (91.0, 0), (-0.6, 0)]
    rows = spark.createDataFrame(values, "x double, want int").withColumn("got", rates.decode_fuel(F.col("x")))
    assert all(r.got == r.want for r in rows.collect())


def test_rates(spark):
    want = {1: (20.5433, 37.125), 4: (8.20748, 19.319), 9: (11505, 1242.11), 13: (36.5959, 33.9766)}
    rows = fuels(spark).select("fuel", rates.full_rate(F.lit(5.0), F.lit(0.0), F.lit(0.05)).alias("full"), rates.reduced_rate(F.lit(5.0), F.lit(0.0)).alias("reduced"))
    got = {r.fuel: (r.full, r.reduced) for r in rows.collect()}
    for fuel, pair in want.items():
        assert got[fuel] == pytest.approx(pair, rel=1e-4)


def test_relaxation_is_dijkstra(spark, small):
    rows = core._rated(spark, small).where("scenario = 1").persist()
    edge = spread.edges(rows).persist()
    out = {}
    for e in edge.collect():
        out.setdefault((e.r, e.c), []).append((e.seconds, (e.to_r, e.to_c)))
    start = core._ignition(rows)
    first = start.first()
    best, heap = {}, [(0.0, (first.r, first.c))]
    while heap:
        t, cell = heapq.heappop(heap)
        if cell in best:
            continue
        best[cell] = t
        for s, to in out.get(cell, ()):
            heapq.heappush(heap, (t + s, to))
    got = {(r.r, r.c): r.toa for r in spread.relax(edge, start).collect()}
    assert got.keys() == best.keys()
    assert all(got[k] == pytest.approx(best[k], abs=1e-6) for k in got)


def test_grid_is_dense(spark, small):
    n = cells(spark, small).groupBy("scenario").count().collect()
    assert len(n) == 7 and all(r["count"] == 64 * 64 for r in n)


def by_recursion(load, n, r0, r1, c0, c1, depth=0):
    """Rectangles in preorder, cut where the running load of lines first reaches half."""
    if n <= 1 or r1 - r0 <= 1 or c1 - c0 <= 1:
        return [(r0, r1, c0, c1, int(load[r0:r1, c0:c1].sum()))]
    lines = load[r0:r1, c0:c1].sum(1 - depth % 2)
    lo, hi = (r0, r1) if depth % 2 == 0 else (c0, c1)
    run, cut = 0, (lo + hi) // 2
    for k in range(lo, hi - 1):
        run += lines[k - lo]
        if 2 * run >= lines.sum():
            cut = k + 1
            break
    low, high = ((r0, cut, c0, c1), (cut, r1, c0, c1)) if depth % 2 == 0 else ((r0, r1, c0, cut), (r0, r1, cut, c1))
    return by_recursion(load, n // 2, *low, depth + 1) + by_recursion(load, n - n // 2, *high, depth + 1)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 32])
def test_rectangles_by_recursion(spark, n):
    rng = np.random.default_rng(n)
    grids = {0: rng.integers(0, 9, (12, 12)), 1: np.zeros((12, 12), int), 2: (rng.uniform(size=(12, 12)) < 0.03) * 50, 3: np.eye(12, dtype=int)}
    rows = [(g, r, c, int(v)) for g, grid in grids.items() for (r, c), v in np.ndenumerate(grid)]
    loads = spark.createDataFrame(rows, "g int, r int, c int, load long")
    got = partition.kd_rectangles(loads, n, 12, ["g"]).collect()
    split = partition.kd_split(loads, n, 12, ["g"])
    for g, grid in grids.items():
        own = sorted((r for r in got if r.g == g), key=lambda r: r.leaf)
        assert [(r.r0, r.r1, r.c0, r.c1, r.load) for r in own] == by_recursion(grid, n, 0, 12, 0, 12)
    assert split.count() == len(rows) and split.where("r < r0 or r >= r1 or c < c0 or c >= c1").isEmpty()


def test_levels_move_nothing(spark):
    plan = partition.kd_rectangles(spark.createDataFrame([(0, 0, 0, 1)], "g int, r int, c int, load long"), 32, 64, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
