"""Files of cells, arrival times and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARRIVALS = "scenario int, r int, c int, toa double"


def write_arrivals(arrivals: DataFrame, path: str, mode: str = "error") -> None:
    """Reached cells as CSV with two decimals, in order of scenario, row and column over the files; mode as of Spark's writers."""
    rows = arrivals.where("toa is not null").select("scenario", "r", "c", F.format_string("%.2f", "toa").alias("toa"))
    rows.orderBy("scenario", "r", "c").write.mode(mode).csv(path, header=True)


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ARRIVALS, header=True)


def dense(arrivals: DataFrame, lattice: DataFrame, unreached: float | None = None) -> DataFrame:
    """A row per cell of the lattice (scenario, r, c), with its arrival time or `unreached`."""
    return lattice.select("scenario", "r", "c").join(arrivals, ["scenario", "r", "c"], "left").withColumn("toa", F.coalesce("toa", F.lit(unreached).cast("double")))


def number(text: Column) -> Column:
    """The text as a number, 0 where it is none or a missing value's code of -9990 or less."""
    value = text.try_cast("double")
    return F.when(value > -9990, value).otherwise(0.0)


def read_cells(spark: SparkSession, path: str, layers: list[str]) -> DataFrame:
    """A cell CSV of r, c and named layers; bad numbers are 0."""
    names = ["r", "c", *layers]
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), header=True)
    return rows.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[number(F.col(n)).alias(n) for n in layers])


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row per feature of GeoJSON files: the named properties (a DDL list), and lon and lat, the means of the vertices of
    the first polygon's outer ring; null where there is no ring."""
    rows = spark.read.json(path, multiLine=True, schema=f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>")
    one = rows.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.*")
    polygon = F.from_json("coordinates", "array<array<array<double>>>")[0]
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")[0][0]
    ring = F.when(F.col("type") == "Polygon", polygon).when(F.col("type") == "MultiPolygon", many)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.when(F.size(ring) > 0, F.size(ring))
    return one.select("*", mean(0).alias("lon"), mean(1).alias("lat")).drop("type", "coordinates")
