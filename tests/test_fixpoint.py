"""Reports on arrival times at the fixpoint, against Dijkstra's algorithm on a fire of more steps than the round caps."""

import heapq
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellweave import registry
from cellweave.operators import spread
from cellweave.plans import core


@pytest.fixture(scope="module")
def strip(spark, medium, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("strip"))
    c = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 64
    spark.read.parquet(f"{medium}/lineitem.parquet").where((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 64).between(28, 36) & c.between(16, 46)).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def dijkstra(spark, folder, edges_of):
    rows = core._rated(spark, folder)
    out = defaultdict(list)
    for e in edges_of(rows, size=64).collect():
        out[e.r, e.c].append((e.to_r, e.to_c, e.seconds))
    (start,) = spread.nearest_burnable(rows).collect()
    times, heap = {}, [(0.0, start.r, start.c)]
    while heap:
        t, r, c = heapq.heappop(heap)
        if (r, c) not in times:
            times[r, c] = t
            for to_r, to_c, s in out[r, c]:
                heapq.heappush(heap, (t + s, to_r, to_c))
    assert max(max(abs(r - start.r), abs(c - start.c)) for r, c in times) > 6
    return times


def test_reports(spark, strip):
    times = dijkstra(spark, strip, spread.edges)
    run = lambda name: registry.QUERIES[name](spark, strip).collect()
    (r,) = run("reached_at_t_fixpoint")
    assert r.reached == len(times)
    assert math.isclose(r.pct_at_30_s, 100 * sum(t <= 30 for t in times.values()) / 4096, abs_tol=1e-6)
    assert math.isclose(r.last, max(times.values()), abs_tol=1e-4)
    (r,) = run("downwind_shift_fixpoint")
    assert math.isclose(r["shift"], sum(r - 32 for r, _ in times) / len(times), abs_tol=1e-5)
    bands = defaultdict(int)
    for t in times.values():
        bands[math.floor(t / 60)] += 1
    assert {r.band: r.n for r in run("isochrones_fixpoint")} == bands


def test_pull(spark, strip):
    times = dijkstra(spark, strip, spread.pull_edges)
    got = {(r.r, r.c): r.toa for r in registry.QUERIES["toa_pull_fixpoint"](spark, strip).collect()}
    assert got.keys() == times.keys()
    assert all(math.isclose(got[k], t, abs_tol=1e-4) for k, t in times.items())
