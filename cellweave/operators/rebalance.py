"""Online rebalancing: loads of time steps under layouts, by policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partition import kd_split


def fronts(arrivals: DataFrame, steps: int) -> DataFrame:
    """arrivals (scenario, r, c, toa) with the step in whose half-open bin of the last arrival's time they fall."""
    last = arrivals.where("toa > 0").groupBy("scenario").agg(F.max("toa").alias("tmax"))
    step = F.floor(F.col("toa") * steps / F.col("tmax")).cast("int")
    return arrivals.join(last, "scenario").withColumn("step", step).where(F.col("step").between(0, steps - 1)).drop("tmax")


def step_loads(front: DataFrame, layout: DataFrame) -> DataFrame:
    """(scenario, step, path, load): cells of each front in each rectangle."""
    return front.join(layout.select("scenario", "r", "c", "path"), ["scenario", "r", "c"]).groupBy("scenario", "step", "path").agg(F.count("*").alias("load"))


def static_makespan(front: DataFrame, lattice: DataFrame, n: int, size: int) -> DataFrame:
    """(scenario, relative_time): the sum of each step's largest load over all work, under one even layout."""
    layout = kd_split(lattice.select("scenario", "r", "c", F.lit(1).cast("long").alias("load")), n, size, ["scenario"])
    loads = step_loads(front, layout).groupBy("scenario", "step").agg(F.max("load").alias("most"), F.sum("load").alias("work"))
    return loads.groupBy("scenario").agg(F.round(F.sum("most") / F.greatest(F.sum("work"), F.lit(1)), 8).alias("relative_time"))


def lagged_makespan(front: DataFrame, n: int, size: int) -> DataFrame:
    """As static_makespan, with a new layout after every step that has cells: each step runs under the layout of the last
    step before it that has any, the first under the even layout. Counts the changes of layout."""
    busy = front.select("scenario", "step").distinct()
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    lattice = busy.select("scenario", "step", F.explode(axis).alias("r")).select("scenario", "step", "r", F.explode(axis).alias("c"))
    loads = lattice.join(front.select("scenario", "step", "r", "c", F.lit(1).cast("long").alias("load")), ["scenario", "step", "r", "c"], "left").withColumn("load", F.coalesce("load", F.lit(0)))
    layouts = kd_split(loads, n, size, ["scenario", "step"]).select("scenario", F.col("step").alias("of"), "r", "c", "path")
    even = kd_split(lattice.select("scenario", "r", "c").distinct().withColumn("load", F.lit(1).cast("long")), n, size, ["scenario"]).select("scenario", F.lit(-1).alias("of"), "r", "c", "path")
    from pyspark.sql import Window as W

    before = busy.withColumn("of", F.coalesce(F.lag("step").over(W.partitionBy("scenario").orderBy("step")), F.lit(-1)))
    placed = front.join(before, ["scenario", "step"]).join(layouts.unionByName(even), ["scenario", "of", "r", "c"])
    steps = placed.groupBy("scenario", "step", "path").agg(F.count("*").alias("load")).groupBy("scenario", "step").agg(F.max("load").alias("most"), F.sum("load").alias("work"))
    return steps.groupBy("scenario").agg(F.round(F.sum("most") / F.greatest(F.sum("work"), F.lit(1)), 8).alias("relative_time"), F.count("*").alias("layouts"))
