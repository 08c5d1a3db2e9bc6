"""Connected cells by tiles against a search cell by cell, and seeded numbers."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import seeded
from cellweave.operators import regions


def searched(cells):
    """The least (r, c) of each cell's region."""
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        todo = [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in out or (r, c) not in cells:
                continue
            out[r, c] = start
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def shapes():
    rng = random.Random(11)
    spiral, r, c, step = set(), 0, 0, 19
    for k in range(38):
        dr, dc = ((0, 1), (1, 0), (0, -1), (-1, 0))[k % 4]
        for _ in range(step):
            spiral.add((r, c))
            r, c = r + dr, c + dc
        step -= k % 2
        if step <= 0:
            break
    return {
        "noise": {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.6},
        "thin": {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.4},
        "spiral": spiral,
        "comb": {(r, c) for r in range(20) for c in range(20) if c % 2 == 0 or r == 19},
        "full": {(r, c) for r in range(9) for c in range(23)},
        "one": {(7, 13)},
    }


@pytest.mark.parametrize("tile", [1, 4, 7, 64])
def test_components(spark, tile):
    grids = shapes()
    rows = [(g, r, c) for g, cells in grids.items() for r, c in cells]
    got = regions.components(spark.createDataFrame(rows + rows[:50], "g string, r int, c int"), ["g"], tile).collect()
    assert len(got) == len(rows)
    found = {(x.g, x.r, x.c): divmod(x.label, 1 << 20) for x in got}
    assert found == {(g, r, c): least for g, cells in grids.items() for (r, c), least in searched(cells).items()}


@pytest.mark.parametrize("tile", [5, 64])
def test_fill(spark, tile):
    grids = shapes()
    seeds = {"noise": {(3, 3), (19, 19)}, "thin": {(99, 0)}, "spiral": {(0, 0)}, "comb": {(0, 4)}}
    frame = lambda sets: spark.createDataFrame([(g, r, c) for g, cells in sets.items() for r, c in cells], "g string, r int, c int")
    got = {(x.g, x.r, x.c) for x in regions.flood_fill(frame(grids), frame(seeds), ["g"], tile).collect()}
    want = set()
    for g, cells in grids.items():
        names = searched(cells)
        hit = {names[s] for s in seeds.get(g, ()) if s in names}
        want |= {(g, *cell) for cell, name in names.items() if name in hit or not hit}
    assert got == want


def test_nothing_to_fill(spark):
    none = spark.createDataFrame([], "g string, r int, c int")
    assert regions.flood_fill(none, none, ["g"]).count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    draw = lambda df: sorted(tuple(r) for r in df.select("id", seeded.drawn(3, F.col("id"), F.lit("x")).alias("n"), seeded.uniform(3, F.col("id"), F.lit("x"), F.lit(5.0), F.lit(9.0)).alias("u")).collect())
    one = draw(spark.range(2000).repartition(1))
    assert one == draw(spark.range(2000).repartition(13)) and one != draw(spark.range(2000).withColumn("id", F.col("id") + 1))
    assert all(5 <= u < 9 for _, _, u in one)


def test_numbers_are_uniform(spark):
    """Twenty bins of 20,000 numbers, by chi squared; two streams of a key don't follow each other."""
    rows = spark.range(20_000).select(*[(seeded.drawn(7, F.col("id"), F.lit(s)) / 2**32).alias(s) for s in "ab"])
    for s in "ab":
        n = [r["count"] for r in rows.groupBy(F.floor(F.col(s) * 20)).count().collect()]
        assert len(n) == 20 and sum((x - 1000) ** 2 / 1000 for x in n) < 45
    assert abs(rows.select(F.corr("a", "b")).first()[0]) < 0.03
