"""Arrival times by relaxation: rounds of joins over the cells that got earlier, until none does or a round cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import NEIGHBOURS, burnable
from ..session import checkpointed


def edges(cells: DataFrame, rate: str = "rate", wind_to: float = 180.0, share: float = 0.5, floor: float = 0.01, size: int = 64, blocked: bool = False) -> DataFrame:
    """(scenario, r, c, to_r, to_c, seconds) from each burnable cell to its neighbours, by the rate of the source.

    blocked: cells that don't burn aren't reached either; else they are, but pass nothing on.
    """
    near = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(d).alias("dist"), F.lit(g).alias("bearing")) for a, b, d, g in NEIGHBOURS])
    out = cells.where(burnable(F.col("fuel")) & (F.col(rate) >= 1e-6)).select("scenario", "r", "c", rate, F.inline(near))
    out = out.select("scenario", "r", "c", (F.col("r") + F.col("dr")).alias("to_r"), (F.col("c") + F.col("dc")).alias("to_c"), "dist", "bearing", rate).where(F.col("to_r").between(0, size - 1) & F.col("to_c").between(0, size - 1))
    speed = F.greatest(F.lit(floor), F.col(rate) * (1 + share * F.cos(F.radians(F.lit(wind_to) - F.col("bearing")))) / (1 + share))
    out = out.select("scenario", "r", "c", "to_r", "to_c", (F.col("dist") / speed).alias("seconds"))
    if blocked:
        ok = cells.where(burnable(F.col("fuel"))).select("scenario", F.col("r").alias("to_r"), F.col("c").alias("to_c"))
        out = out.join(ok, ["scenario", "to_r", "to_c"], "left_semi")
    return out


def pull_edges(cells: DataFrame, rate: str = "rate", wind_to: float = 180.0, floor: float = 0.001, size: int = 64) -> DataFrame:
    """(scenario, r, c, to_r, to_c, seconds) into each burnable cell from its neighbours, by the rate of the cell reached
    and the bearing towards it."""
    near = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(d).alias("dist"), F.lit(g).alias("bearing")) for a, b, d, g in NEIGHBOURS])
    out = cells.where(burnable(F.col("fuel")) & (F.col(rate) >= 1e-6)).select("scenario", F.col("r").alias("to_r"), F.col("c").alias("to_c"), rate, F.inline(near))
    out = out.withColumn("r", F.col("to_r") + F.col("dr")).withColumn("c", F.col("to_c") + F.col("dc")).where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1))
    speed = F.greatest(F.lit(floor), F.col(rate) * (0.5 + 0.5 * F.cos(F.radians(F.lit(wind_to) - (F.col("bearing") + 180)))))
    return out.select("scenario", "r", "c", "to_r", "to_c", (F.col("dist") / speed).alias("seconds"))


def relax(edge: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(scenario, r, c, toa): least sums of seconds from the sources (scenario, r, c, toa).

    Semi-naive: a round starts from the cells that the last one improved. The table of times goes through checkpoint()
    each round, which keeps plans from doubling and outlives executors.
    """
    times = sources.select("scenario", "r", "c", "toa", F.lit(True).alias("fresh"))
    done = 0
    while rounds is None or done < rounds:
        step = times.where("fresh").join(edge, ["scenario", "r", "c"]).select("scenario", F.col("to_r").alias("r"), F.col("to_c").alias("c"), (F.col("toa") + F.col("seconds")).alias("toa"), F.lit(True).alias("new"))
        both = times.select("scenario", "r", "c", "toa", F.lit(False).alias("new")).unionByName(step)
        least = both.groupBy("scenario", "r", "c").agg(F.min("toa").alias("toa"), F.min(F.when(~F.col("new"), F.col("toa"))).alias("before"))
        times = least.select("scenario", "r", "c", "toa", (F.col("before").isNull() | (F.col("toa") < F.col("before") - 1e-9)).alias("fresh"))
        times = checkpointed(times)
        done += 1
        if times.where("fresh").isEmpty():
            break
    return times.select("scenario", "r", "c", "toa")


def nearest_burnable(cells: DataFrame, at: int = 32) -> DataFrame:
    """The burnable cell nearest to the middle of each scenario, by rings, then by row and column."""
    ring = F.greatest(F.abs(F.col("r") - at), F.abs(F.col("c") - at))
    best = cells.where(burnable(F.col("fuel"))).groupBy("scenario").agg(F.min(F.struct(ring.alias("ring"), "r", "c")).alias("m"))
    return best.select("scenario", F.col("m.r").alias("r"), F.col("m.c").alias("c"), F.col("m.ring").cast("int").alias("ring"))
