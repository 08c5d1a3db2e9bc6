"""Numbers that a seed and a key give, alike on any number of tasks and in any order: a counter hashed by MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A scenario's weather, with least and largest values.
WEATHER = (("temperature", 50.0, 120.0), ("humidity", 5.0, 95.0), ("cloud_cover", 0.0, 100.0), ("precipitation", 0.0, 0.5), ("wind_direction", 0.0, 360.0), ("wind_speed", 0.0, 30.0))


def drawn(seed: int, key: Column, stream: Column) -> Column:
    """An integer from 0 to 2^32 - 1 of a stream of numbers of a key; a null key is an empty one."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), stream)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int, key: Column, stream: Column, lo: Column, hi: Column) -> Column:
    """From lo to less than hi."""
    return lo + (hi - lo) * (drawn(seed, key, stream) / F.lit(4294967296.0))
