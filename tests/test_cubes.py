"""Cubes, cell lines and scenario tables from files, flood fill against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import partition, regions
from cellweave.sources import cubes


def test_cube(spark, tmp_path):
    values = np.arange(2 * 3 * 4, dtype="<f4").reshape(2, 3, 4)
    (tmp_path / "a.bin").write_bytes(np.array([2, 3, 4], "<i4").tobytes() + values.tobytes())
    got = {(r.r, r.c): r.layers for r in cubes.read_cubes(spark, f"file://{tmp_path}/a.bin", 4).collect()}
    assert got == {(r, c): values[r, c].tolist() for r in range(2) for c in range(3)}
    (tmp_path / "b.bin").write_bytes(np.array([2, 3, 4], "<i4").tobytes() + values.tobytes()[:-4])
    with pytest.raises(Exception, match="no cube"):
        cubes.read_cubes(spark, f"file://{tmp_path}/b.bin", 4).collect()


def test_cell_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2.5,,bad\n-3e1,4m\n\n0.5\n")
    got = [(r.r, r.c, r.layers) for r in cubes.read_cell_lines(spark, f"file://{tmp_path}/x.csv", 2).orderBy("r", "c").collect()]
    assert got == [(0, 0, [1, 2.5, 0]), (0, 1, [-30, 4]), (1, 0, []), (1, 1, [0.5])]


def test_scenarios(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,split\nS001,train\nS002,test\n")
    read = lambda **k: [r.id for r in cubes.read_scenarios(spark, f"file://{tmp_path}/s.csv", "id string, split string", **k).collect()]
    assert read() == ["S001", "S002"] and read(split="test") == ["S002"] and read(ids=["S001"]) == ["S001"]
    with pytest.raises(LookupError):
        read(ids=["S009"])


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 0, 1 / 3)], "scenario int, r int, c int, load double")
    cubes.write_load_map(cells, f"file://{tmp_path}/loads")
    assert [r.load for r in spark.read.csv(f"file://{tmp_path}/loads", header=True).orderBy("c").collect()] == ["0.3333", "2.0000"]
    cubes.write_cube(cells, f"file://{tmp_path}/cube", ["scenario"])
    cubes.write_cube(cells.limit(0), f"file://{tmp_path}/cube", ["scenario"], mode="ignore")
    assert spark.read.parquet(f"file://{tmp_path}/cube").count() == 2


def test_flood_fill(spark):
    rng = random.Random(2)
    mask = {(g, r, c) for g in range(3) for r in range(20) for c in range(20) if rng.random() < 0.6}
    seeds = [x for x in mask if x[0] < 2 and rng.random() < 0.02]
    want, stack = set(seeds), list(seeds)
    while stack:
        g, r, c = stack.pop()
        for x in ((g, r - 1, c), (g, r + 1, c), (g, r, c - 1), (g, r, c + 1)):
            if x in mask and x not in want:
                want.add(x)
                stack.append(x)
    want |= {x for x in mask if x[0] not in {s[0] for s in seeds}}
    frame = lambda x: spark.createDataFrame(list(x), "g int, r int, c int")
    got = regions.flood_fill(frame(mask), frame(seeds), ["g"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_strips_without_load(spark):
    loads = spark.range(64).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(0).alias("load"))
    got = [(r.lo, r.hi) for r in partition.strips(loads, 5, ["g"]).orderBy("leaf").collect()]
    assert got == [(0, 12), (12, 25), (25, 38), (38, 51), (51, 64)]
    one = loads.withColumn("load", F.when(F.col("r") == 10, 5).otherwise(0))
    assert [(r.lo, r.hi) for r in partition.strips(one, 4, ["g"]).orderBy("leaf").collect()] == [(0, 10), (10, 64), (64, 64), (64, 64)]
