"""The grid that the queries work on: 64 x 64 cells a scenario, made of line items; and small dimension tables.

Cells are (scenario, r, c, q, fuel, slope, elevation). q sums the quantities that fall on a cell, 0 where none does, as
a raster's missing value is filled. Fuel 0 and 98 don't burn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 64

# Fuel models (id, 1 h, 10 h, 100 h and herb load, surface to volume, depth, extinction moisture).
FUELS = [
    (1, 0.166, 0.0, 0.0, 0.0, 11483.0, 0.305, 0.12),
    (2, 0.898, 0.449, 0.0, 0.449, 11483.0, 0.305, 0.15),
    (3, 0.675, 0.0, 0.0, 0.0, 11483.0, 0.762, 0.25),
    (4, 2.246, 1.123, 0.561, 0.0, 6562.0, 1.829, 0.20),
    (5, 0.225, 0.0, 0.0, 0.449, 6562.0, 0.610, 0.20),
    (6, 0.785, 0.674, 0.337, 0.0, 6562.0, 0.762, 0.25),
    (7, 0.561, 0.449, 0.337, 0.0, 6562.0, 0.762, 0.40),
    (8, 0.336, 0.561, 1.123, 0.0, 11483.0, 0.061, 0.30),
    (9, 0.336, 0.112, 0.112, 0.0, 13123.0, 0.061, 0.25),
    (10, 0.561, 1.123, 1.123, 0.0, 8202.0, 0.305, 0.25),
    (11, 0.785, 1.123, 1.571, 0.0, 6562.0, 0.305, 0.15),
    (12, 3.370, 2.809, 2.246, 0.0, 6562.0, 0.762, 0.20),
    (13, 7.415, 3.370, 2.246, 0.0, 6562.0, 0.914, 0.25),
]
FUEL_COLUMNS = "fuel int, w1 double, w10 double, w100 double, wherb double, sv double, delta double, mx double"
HEAT = 18622.0
# The eight neighbours as (dr, dc, distance, bearing).
NEIGHBOURS = [(-1, -1, 42.426, 315.0), (-1, 0, 30.0, 0.0), (-1, 1, 42.426, 45.0), (0, -1, 30.0, 270.0), (0, 1, 30.0, 90.0), (1, -1, 42.426, 225.0), (1, 0, 30.0, 180.0), (1, 1, 42.426, 135.0)]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_orderkey", "l_partkey", "l_quantity")
    key = [F.col("l_linenumber").alias("scenario"), (F.col("l_orderkey") % SIZE).cast("int").alias("r"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % SIZE).cast("int").alias("c")]
    met = items.groupBy(*key).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    # The lattice is made of the scenarios that occur, without a cross join.
    axis = F.sequence(F.lit(0), F.lit(SIZE - 1))
    lattice = items.select(F.col("l_linenumber").alias("scenario")).distinct().select("scenario", F.explode(axis).alias("r")).select("scenario", "r", F.explode(axis).alias("c"))
    full = lattice.join(met, ["scenario", "r", "c"], "left").withColumn("q", F.coalesce("q", F.lit(0)))
    q = F.col("q")
    fuel = F.when(q == 0, 0).when(q % 10 == 9, 98).otherwise(1 + q % 13).cast("int")
    return full.select("scenario", "r", "c", "q", fuel.alias("fuel"), ((q * 3) % 60).cast("int").alias("slope"), ((q * 17) % 900).cast("int").alias("elevation"))


def fuels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FUELS, FUEL_COLUMNS)


def burnable(code: Column) -> Column:
    return code.between(1, 13)


#: The same tables in SQL, as the beginning of a WITH clause.
SQL_CELLS = f"""WITH agg AS (SELECT l_linenumber AS scenario, CAST(l_orderkey % {SIZE} AS INTEGER) AS r, CAST((l_partkey * 7 + l_linenumber) % {SIZE} AS INTEGER) AS c,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
lattice AS (SELECT scenario, CAST(a.range AS INTEGER) AS r, CAST(b.range AS INTEGER) AS c FROM (SELECT DISTINCT l_linenumber AS scenario FROM lineitem), range({SIZE}) a, range({SIZE}) b),
filled AS (SELECT scenario, r, c, coalesce(q, 0) AS q FROM lattice LEFT JOIN agg USING (scenario, r, c)),
cells AS (SELECT scenario, r, c, q, CAST(CASE WHEN q = 0 THEN 0 WHEN q % 10 = 9 THEN 98 ELSE 1 + q % 13 END AS INTEGER) AS fuel,
  CAST((q * 3) % 60 AS INTEGER) AS slope, CAST((q * 17) % 900 AS INTEGER) AS elevation FROM filled)"""
SQL_FUELS = "fuels(fuel, w1, w10, w100, wherb, sv, delta, mx) AS (SELECT CAST(a AS INTEGER), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE), CAST(e AS DOUBLE), CAST(f AS DOUBLE), CAST(g AS DOUBLE), CAST(h AS DOUBLE) FROM (VALUES " + ", ".join(map(str, FUELS)) + ") v(a, b, c, d, e, f, g, h))"
