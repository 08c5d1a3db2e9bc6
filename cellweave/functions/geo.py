"""Codes of land cover and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fuel of each land-cover class, all others 99; canopy (cover, height, base height, bulk density), else zeros.
LANDCOVER = {1: 98, 2: 8, 4: 98, 5: 1, 7: 91, 8: 99, 9: 92, 10: 99, 11: 3}
CANOPY = {2: (60, 200, 30, 12), 5: (5, 10, 1, 2), 11: (10, 20, 2, 3)}
EARTH = 6378137.0


def landcover_fuel(code: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in LANDCOVER.items() for v in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(99))


def canopy(code: Column) -> Column:
    """A struct of cc, ch, cbh and cbd."""
    names = ("cc", "ch", "cbh", "cbd")
    row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    table = F.create_map(*[x for k, v in CANOPY.items() for x in (F.lit(k), row(v))])
    return F.coalesce(F.try_element_at(table, code), row((0, 0, 0, 0)))


def utm_code(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone of a place."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return EARTH * F.radians(lon), EARTH * F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2))
