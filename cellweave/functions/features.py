"""Clean-up of feature properties, dates, boxes and parsed text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACRE, DEGREE = 4046.86, 111_320.0
DAY_MILLIS = 86_400_000


def area_acres(aliases: list[tuple[Column, bool]]) -> Column:
    """The first alias that is a number; those of square metres (the flag) above 1e5 are turned into acres; 0 if none is."""
    numbers = [F.when(F.lit(metres) & (x > 1e5), x / ACRE).otherwise(x) for x, metres in ((text.try_cast("double"), metres) for text, metres in aliases)]
    return F.coalesce(*numbers, F.lit(0.0))


def scaled_round(x: Column, digits: int) -> Column:
    """x to so many decimals by its multiple of their power, as DuckDB does. round() goes by the decimal digits that x
    prints as, and puts values just below a half up."""
    return F.round(x * 10.0**digits) / 10.0**digits


def clean_name(aliases: list[Column], key: Column) -> Column:
    """The first alias that isn't blank, trimmed, spaces as underscores, in capitals; else FIRE_ and a number of the key."""
    named = F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in aliases])
    return F.coalesce(F.upper(F.replace(named, F.lit(" "), F.lit("_"))), F.concat(F.lit("FIRE_"), (key % 100_000).cast("string")))


def iso_date(text: Column) -> Column:
    """Epoch milliseconds as a UTC day; of other texts the first ten characters; without text a fixed day."""
    millis = text.try_cast("long")
    days = ((millis - F.pmod(millis, F.lit(DAY_MILLIS))) / DAY_MILLIS).cast("int")
    # Spark writes years from 10000 with a plus and pads those below 0; DuckDB does neither.
    day = F.regexp_replace(F.date_from_unix_date(days).cast("string"), r"^\+|(?<=^-)0+", "")
    return F.when(text.isNull() | (text == ""), "2016-07-01").when(millis.isNotNull(), day).otherwise(F.substring(text, 1, 10))


def degrees_of(metres: Column, lat: Column) -> tuple[Column, Column]:
    return metres / (DEGREE * F.cos(F.radians(lat))), metres / DEGREE


# Rates of 13 fuels of a map layer scaled to 0..1.
TABLE_RATES = [0.02, 0.05, 0.15, 0.12, 0.08, 0.10, 0.08, 0.03, 0.04, 0.06, 0.05, 0.10, 0.20]


def table_rate(layer: Column, slope: Column, wind: Column) -> Column:
    fuel = F.greatest(F.lit(1), F.least(F.lit(13), (layer * 12).cast("int") + 1))
    rate = F.element_at(F.array(*map(F.lit, TABLE_RATES)), fuel) * (1 + 0.4 * (wind / 10) + 0.1 * (slope / 100))
    return F.when(layer < 0.001, 0.0).otherwise(rate)


def leading_number(token: Column) -> Column:
    """The number that a text begins with, 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(token, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def line_numbers(line: Column, most: int = 14) -> Column:
    """The numbers of a line of comma-separated values: empty fields collapse, of bad ones the leading number counts."""
    return F.transform(F.slice(F.filter(F.split(line, ","), lambda x: x != ""), 1, most), leading_number)


def reported_number(text: Column) -> Column:
    """The first number on the first line that speaks of an average; null without one."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains("average") | F.lower(x).contains("médio")), 0)
    return F.regexp_extract(line, r"(\d+\.\d+)", 1).try_cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
