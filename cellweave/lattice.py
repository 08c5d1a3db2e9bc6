"""A grid that grows with its table: 16 x 16 cells a scenario, one cell for each document's number.

Cells are (scenario, r, c, q, fuel, slope, elevation) as those of the other grid; q comes from a document's length, and is
0 where no document falls, as a raster's missing value is filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 16


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", (F.coalesce("n_chars", F.lit(0)) % 100).alias("q"))
    scenario, place = F.floor(F.col("doc_id") / (SIDE * SIDE)), F.pmod("doc_id", F.lit(SIDE * SIDE))
    met = docs.groupBy(scenario.alias("scenario"), place.cast("int").alias("place")).agg(F.sum("q").alias("q"))
    # A scenario's documents, at most as many as it has cells, become its whole lattice.
    whole = met.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("place", "q"))).alias("at"))
    cells = whole.select("scenario", "at", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("place"))
    cells = cells.select("scenario", F.floor(F.col("place") / SIDE).cast("int").alias("r"), (F.col("place") % SIDE).cast("int").alias("c"), F.coalesce(F.try_element_at("at", F.col("place")), F.lit(0)).alias("q"))
    q = F.col("q")
    fuel = F.when(q == 0, 0).when(q % 10 == 9, 98).otherwise(1 + q % 13).cast("int")
    return cells.select("*", fuel.alias("fuel"), ((q * 3) % 60).cast("int").alias("slope"), ((q * 17) % 900).cast("int").alias("elevation"))


#: The same table in SQL, as the beginning of a WITH clause.
SQL_LATTICE = f"""WITH met AS (SELECT doc_id // {SIDE * SIDE} AS scenario, doc_id % {SIDE * SIDE} AS place, CAST(sum(coalesce(n_chars, 0) % 100) AS BIGINT) AS q FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL),
whole AS (SELECT scenario, range AS place FROM (SELECT DISTINCT scenario FROM met), range({SIDE * SIDE})),
filled AS (SELECT scenario, CAST(place // {SIDE} AS INTEGER) AS r, CAST(place % {SIDE} AS INTEGER) AS c, coalesce(q, 0) AS q FROM whole LEFT JOIN met USING (scenario, place)),
lattice AS (SELECT scenario, r, c, q, CAST(CASE WHEN q = 0 THEN 0 WHEN q % 10 = 9 THEN 98 ELSE 1 + q % 13 END AS INTEGER) AS fuel,
  CAST((q * 3) % 60 AS INTEGER) AS slope, CAST((q * 17) % 900 AS INTEGER) AS elevation FROM filled)"""
