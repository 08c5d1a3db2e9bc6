"""The order in which a search in rings from a cell meets the cells of an open grid, without the search.

A first-in first-out search meets cells by distance, and those of one distance by their parents' turn and then by the
order of steps: that is the order of the least sequences of steps that lead to them. Such a sequence repeats one step and
then another, so a distance, two steps and a number say where a cell stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of the steps up, down, left, right; then up-left, up-right, down-left, down-right.
UP, DOWN, LEFT, RIGHT, UP_LEFT, UP_RIGHT, DOWN_LEFT, DOWN_RIGHT = range(8)


def turn_of_8(dr: Column, dc: Column) -> Column:
    """Sorts cells at (dr, dc) from the start as eight neighbours, straight ones first, are taken."""
    far = F.greatest(F.abs(dr), F.abs(dc))
    straight_steps = far - F.least(F.abs(dr), F.abs(dc))
    upright = F.abs(dr) >= F.abs(dc)
    straight = F.when(upright & (dr < 0), UP).when(upright, DOWN).when(dc < 0, LEFT).otherwise(RIGHT)
    slanted = F.when((dr < 0) & (dc < 0), UP_LEFT).when(dr < 0, UP_RIGHT).when(dc < 0, DOWN_LEFT).otherwise(DOWN_RIGHT)
    return F.struct(far.alias("far"), F.when(straight_steps > 0, straight).otherwise(slanted).alias("first"), (-straight_steps).alias("fewer"), slanted.alias("then"))


def turn_of_4(dr: Column, dc: Column) -> Column:
    """As turn_of_8 for the four straight neighbours: up, down, left, right."""
    upright, level = F.when(dr < 0, UP).otherwise(DOWN), F.when(dc < 0, LEFT).otherwise(RIGHT)
    return F.struct((F.abs(dr) + F.abs(dc)).alias("far"), F.when(dr != 0, upright).otherwise(level).alias("first"), (-F.abs(dr)).alias("fewer"), level.alias("then"))


#: The same in SQL, as a sort key of {r} and {c}.
SQL_8 = """greatest(abs({r}), abs({c})), CASE WHEN abs({r}) = abs({c}) THEN CASE WHEN {r} < 0 AND {c} < 0 THEN 4 WHEN {r} < 0 THEN 5 WHEN {c} < 0 THEN 6 ELSE 7 END
  WHEN abs({r}) > abs({c}) THEN CASE WHEN {r} < 0 THEN 0 ELSE 1 END WHEN {c} < 0 THEN 2 ELSE 3 END,
  least(abs({r}), abs({c})) - greatest(abs({r}), abs({c})), CASE WHEN {r} < 0 AND {c} < 0 THEN 4 WHEN {r} < 0 THEN 5 WHEN {c} < 0 THEN 6 ELSE 7 END"""
SQL_4 = "abs({r}) + abs({c}), CASE WHEN {r} < 0 THEN 0 WHEN {r} > 0 THEN 1 WHEN {c} < 0 THEN 2 ELSE 3 END, -abs({r}), CASE WHEN {c} < 0 THEN 2 ELSE 3 END"
