"""Queries through files: what is written on the growing grid, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lattice import SIDE, SQL_LATTICE, document_cells
from ..operators import partition
from ..sources import cubes, files
from .core import query
from .surfaces import _documents, _folder

_SPLIT = "CASE WHEN scenario % 4 = 3 THEN 'test' ELSE 'train' END"


@query("arrivals_as_load", f"{SQL_LATTICE} SELECT scenario, r, c, CASE WHEN q > 0 THEN round(q * 1000 / 8e0, 2) ELSE 1e-1 END AS load FROM lattice")
def arrivals_as_load(spark, sf_dir: str) -> DataFrame:
    """Arrival times through a CSV of reached cells; a cell that isn't reached has the least load of 0.1."""
    path, rows = _folder(spark, "arrivals"), document_cells(spark, sf_dir)
    files.write_arrivals(rows.select(F.col("scenario").cast("int").alias("scenario"), "r", "c", F.when(F.col("q") > 0, F.col("q") * 1000 / 8.0).alias("toa")), path)
    loaded = files.dense(files.read_arrivals(spark, path), rows, 0.1)
    return loaded.select("scenario", "r", "c", F.col("toa").alias("load"))


@query("load_map_file", f"{SQL_LATTICE} SELECT scenario, r, c, round(q / 8e0, 4) AS load FROM lattice")
def load_map_file(spark, sf_dir: str) -> DataFrame:
    """A load map through its CSV of four decimals."""
    path = _folder(spark, "loads")
    cubes.write_load_map(document_cells(spark, sf_dir).withColumn("load", F.col("q") / 8), path)
    return spark.read.csv(path, schema="scenario long, r int, c int, load double", header=True)


@query("cell_file", f"{SQL_LATTICE} SELECT scenario, r, c, round(q / 16e0, 5) AS q, CAST(fuel AS DOUBLE) AS fuel, CAST(slope AS DOUBLE) AS slope, CAST(elevation AS DOUBLE) AS elevation FROM lattice")
def cell_file(spark, sf_dir: str) -> DataFrame:
    """A cube's layers through CSV."""
    path, layers = _folder(spark, "cells"), ["q", "fuel", "slope", "elevation"]
    cubes.write_cell_csv(document_cells(spark, sf_dir).withColumn("q", F.col("q") / 16), path, layers)
    return spark.read.csv(path, schema="scenario long, r int, c int, " + ", ".join(f"{x} double" for x in layers), header=True)


@query("cube_file", f"{SQL_LATTICE} SELECT scenario, {_SPLIT} AS split, r, c, q, fuel FROM lattice WHERE scenario % 4 = 3")
def cube_file(spark, sf_dir: str) -> DataFrame:
    """The test scenarios of a cube written by split and scenario: the others' folders are not read."""
    path = _folder(spark, "cube")
    cubes.write_cube(document_cells(spark, sf_dir).withColumn("split", F.expr(_SPLIT)), path, ["split", "scenario"])
    back = spark.read.parquet(path).where("split = 'test'")
    return back.select(F.col("scenario").cast("long").alias("scenario"), "split", "r", "c", "q", "fuel")


@query("binary_cubes", f"{SQL_LATTICE} SELECT scenario, r, c, CAST(q AS DOUBLE) AS q, CAST(fuel AS DOUBLE) AS fuel, slope / 4e0 AS slope FROM lattice")
def binary_cubes(spark, sf_dir: str) -> DataFrame:
    """Cubes of three layers through a binary file a scenario."""
    folder = _folder(spark, "cubes")
    cubes.write_cubes(document_cells(spark, sf_dir).withColumn("slope", F.col("slope") / 4), folder, ["q", "fuel", "slope"]).agg(F.sum("bytes")).collect()
    rows = cubes.read_cubes(spark, folder, 3)
    layer = lambda k: F.get("layers", k).cast("double")
    return rows.select(F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("long").alias("scenario"), "r", "c", layer(0).alias("q"), layer(1).alias("fuel"), layer(2).alias("slope"))


@query("scenario_file", f"{SQL_LATTICE}, s AS (SELECT DISTINCT scenario, {_SPLIT} AS split FROM lattice) SELECT format('S{{:06d}}', scenario) AS id, split, scenario FROM s WHERE split = 'train'")
def scenario_file(spark, sf_dir: str) -> DataFrame:
    """The training scenarios of a table of all, through CSV."""
    path = _folder(spark, "scenarios")
    rows = document_cells(spark, sf_dir).select("scenario").distinct()
    rows.select(F.format_string("S%06d", "scenario").alias("id"), F.expr(_SPLIT).alias("split"), "scenario").write.csv(path, header=True)
    return cubes.read_scenarios(spark, path, "id string, split string, scenario long", split="train")


@query("partition_map_file", f"{SQL_LATTICE}, ld AS (SELECT scenario, r, c, q AS load FROM lattice), {partition.sql_kd(8, SIDE, 'ld')} SELECT scenario, r, c, CAST(dense_rank() OVER (PARTITION BY scenario ORDER BY path) - 1 AS INTEGER) AS partition_id FROM kd")
def partition_map_file(spark, sf_dir: str) -> DataFrame:
    """Each cell's part of a k-d split, through CSV."""
    path = _folder(spark, "partitions")
    split = partition.kd_split(document_cells(spark, sf_dir).withColumnRenamed("q", "load"), 8, SIDE, ["scenario"])
    cubes.write_partition_map(split.withColumnRenamed("leaf", "partition_id"), path)
    return spark.read.csv(path, schema="scenario long, r int, c int, partition_id int", header=True)


_LON, _LAT = "-125 + doc_id * 37 % 5800 / 1e2", "245e-1 + doc_id * 11 % 2500 / 1e2"


@query("geojson_features", f"SELECT doc_id, n_chars, round(({_LON}) + 4e-1, 9) AS lon, round(({_LAT}) + 6e-1, 9) AS lat FROM documents WHERE doc_id IS NOT NULL")
def geojson_features(spark, sf_dir: str) -> DataFrame:
    """Documents as squares of a degree in GeoJSON files of 500 features, read as features with the mean of their vertices,
    of which the first is also the last."""
    folder = _folder(spark, "geojson")
    rows = _documents(spark, sf_dir, "doc_id", "n_chars").where("doc_id is not null")
    lon, lat = (F.expr(e.replace("245e-1", "24.5D").replace("1e2", "100D")) for e in (_LON, _LAT))
    ring = F.array(*[F.array(lon + a, lat + b) for a, b in ((0, 1), (1, 1), (1, 0), (0, 0), (0, 1))])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), F.struct("doc_id", "n_chars").alias("properties"), shape.alias("geometry"))
    paged = rows.select(F.floor(F.col("doc_id") / 500).alias("file"), one.alias("f")).groupBy("file").agg(F.collect_list("f").alias("features"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))
    paged.select("file", text.alias("value")).write.partitionBy("file").text(folder)
    return files.read_features(spark, folder, "doc_id: long, n_chars: long").select("doc_id", "n_chars", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("boxed_documents", f"SELECT doc_id, {_LON} AS lon, {_LAT} AS lat FROM documents WHERE {_LON} BETWEEN -1245e-1 AND -1144e-1 AND {_LAT} BETWEEN 325e-1 AND 42")
def boxed_documents(spark, sf_dir: str) -> DataFrame:
    """Places inside a box of longitudes and latitudes, borders included."""
    lon, lat = (F.expr(e.replace("245e-1", "24.5D").replace("1e2", "100D")) for e in (_LON, _LAT))
    rows = _documents(spark, sf_dir, "doc_id").select("doc_id", lon.alias("lon"), lat.alias("lat"))
    return rows.where(F.col("lon").between(-124.5, -114.4) & F.col("lat").between(32.5, 42.0))
