"""Queries of the whole grid give every cell."""

from pyspark.sql import functions as F

from cellweave import registry
from cellweave.grid import cells
from cellweave.plans import core


def test_directional_rates_of_every_cell(spark, small):
    got = registry.QUERIES["directional_rate_all"](spark, small)
    assert got.count() == 8 * cells(spark, small).count()
    assert got.select("scenario", "r", "c", "bearing").distinct().count() == got.count()


def test_slopes_of_every_cell(spark, small):
    got = registry.QUERIES["slope_aspect_all"](spark, small)
    assert got.count() == cells(spark, small).count()
    assert got.where("octant is null or slope_pct is null or (octant = -1) <> (slope_pct = 0)").isEmpty()
    # Where the gradient runs along no border, the octant is that of the angle.
    angle = F.floor((F.degrees(F.atan2("dy", -F.col("dx"))) + 360) / 45).cast("int") % 8
    by_angle = core._gradients(spark, small).where("dx <> 0 and dy <> 0 and abs(dx) <> abs(dy)").select("scenario", "r", "c", angle.alias("by_angle"))
    both = got.join(by_angle, ["scenario", "r", "c"])
    assert both.count() > 0 and both.where(F.col("octant") != F.col("by_angle")).isEmpty()
