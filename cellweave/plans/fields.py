"""More queries over the grid: code tables, coordinates, strips, patches, triggers, sweeps and model measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, rates
from ..grid import SIZE, SQL_CELLS, SQL_FUELS, cells, fuels
from ..operators import partition, regions, spread
from ..session import checkpointed
from .core import _DENSITY, _SQL_EDGES, _SQL_FRONTS, _fronts, _ignition, _rated, query, sql_fixpoint

_LAND = ", ".join(f"({k}, {v})" for k, v in geo.LANDCOVER.items())
_CANOPY = ", ".join(str((k, *v)) for k, v in geo.CANOPY.items())


@query("landcover_fuel", f"{SQL_CELLS}, l(code, f) AS (VALUES {_LAND}), k(code, cc, ch, cbh, cbd) AS (VALUES {_CANOPY}), x AS (SELECT CAST(q % 14 AS INTEGER) AS code FROM cells) SELECT code, coalesce(f, 99) AS fuel13, coalesce(cc, 0) AS cc, coalesce(ch, 0) AS ch, coalesce(cbh, 0) AS cbh, coalesce(cbd, 0) AS cbd, count(*) AS n FROM x LEFT JOIN l USING (code) LEFT JOIN k USING (code) GROUP BY ALL")
def landcover_fuel(spark, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).groupBy((F.col("q") % 14).cast("int").alias("code")).agg(F.count("*").alias("n"))
    return rows.select("code", geo.landcover_fuel(F.col("code")).alias("fuel13"), geo.canopy(F.col("code")).alias("k"), "n").select("code", "fuel13", "k.*", "n")


# Places are customers: longitude and latitude come from their keys.
_SQL_PLACES = "WITH p AS (SELECT c_custkey, c_mktsegment, c_custkey * 37 % 3600 / 1e1 - 180 AS lon, c_custkey * 11 % 1600 / 1e1 - 79.97e0 AS lat FROM customer)"


def _places(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return rows.select("*", (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 11 % 1600 / 10.0 - 79.97).alias("lat"))


@query("projected_places", f"{_SQL_PLACES} SELECT c_custkey, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + floor((lon + 180) / 6) + 1 AS INTEGER) AS utm, round(6378137e0 * radians(lon), 2) AS x, round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS y FROM p")
def projected_places(spark, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    x, y = geo.web_mercator(lon, lat)
    return _places(spark, sf_dir).select("c_custkey", geo.utm_code(lon, lat).alias("utm"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("buffered_bounds", f"{_SQL_PLACES} SELECT c_mktsegment, round(min(lon) - 0.5e0, 6) AS west, round(min(lat) - 0.5e0, 6) AS south, round(max(lon) + 0.5e0, 6) AS east, round(max(lat) + 0.5e0, 6) AS north FROM p GROUP BY ALL")
def buffered_bounds(spark, sf_dir: str) -> DataFrame:
    ends = [(F.min, "lon", -0.5, "west"), (F.min, "lat", -0.5, "south"), (F.max, "lon", 0.5, "east"), (F.max, "lat", 0.5, "north")]
    return _places(spark, sf_dir).groupBy("c_mktsegment").agg(*[F.round(f(c) + by, 6).alias(n) for f, c, by, n in ends])


@query("cell_centres", f"{SQL_CELLS} SELECT scenario, CAST(r * {SIZE} + c AS INTEGER) AS cell, 5e5 + (c + 0.5e0) * 30 AS x, 4e6 - (r + 0.5e0) * 30 AS y FROM cells")
def cell_centres(spark, sf_dir: str) -> DataFrame:
    centre = lambda x: (F.col(x) + 0.5) * 30
    return cells(spark, sf_dir).select("scenario", (F.col("r") * SIZE + F.col("c")).cast("int").alias("cell"), (5e5 + centre("c")).alias("x"), (4e6 - centre("r")).alias("y"))


@query("strips_8", f"{SQL_CELLS}, m AS (SELECT scenario, r, sum(q) AS load FROM cells GROUP BY ALL), s AS (SELECT *, sum(load) OVER (PARTITION BY scenario ORDER BY r) AS run, sum(load) OVER (PARTITION BY scenario) AS tot FROM m), k AS (SELECT unnest(range(1, 8)) AS part) SELECT scenario, CAST(part AS INTEGER) AS part, CAST(count(*) FILTER (WHERE 8 * run < tot * part) AS INTEGER) AS edge FROM s, k GROUP BY ALL")
def strips_8(spark, sf_dir: str) -> DataFrame:
    return partition.strip_edges(cells(spark, sf_dir).withColumnRenamed("q", "load"), 8, ["scenario"])


@query("patches_3", f"{SQL_CELLS}, o AS (SELECT scenario, r, c, a.range AS dr, b.range AS dc FROM cells, range(-1, 2) a, range(-1, 2) b), t AS (SELECT scenario, r, c, dr, dc, CASE WHEN r + dr < 0 THEN 1 WHEN r + dr >= {SIZE} THEN {SIZE} - 2 ELSE r + dr END AS pr, CASE WHEN c + dc < 0 THEN 1 WHEN c + dc >= {SIZE} THEN {SIZE} - 2 ELSE c + dc END AS pc FROM o) SELECT t.scenario, t.r, t.c, string_agg(CAST(q AS VARCHAR), ',' ORDER BY dr, dc) AS patch FROM t JOIN cells ON cells.scenario = t.scenario AND cells.r = pr AND cells.c = pc GROUP BY ALL")
def patches_3(spark, sf_dir: str) -> DataFrame:
    rows = regions.patches(cells(spark, sf_dir), 3, SIZE, ["scenario"], "q")
    return rows.select("scenario", "r", "c", F.array_join(F.transform("patch", lambda x: x.cast("string")), ",").alias("patch"))


@query("advance_axis", f"{_SQL_FRONTS} SELECT scenario, step, CAST(CASE WHEN abs(avg(c) - 32) >= abs(avg(r) - 32) THEN 0 ELSE 1 END AS INTEGER) AS axis FROM fr GROUP BY ALL")
def advance_axis(spark, sf_dir: str) -> DataFrame:
    away = lambda x: F.abs(F.avg(x) - 32)
    return _fronts(spark, sf_dir).groupBy("scenario", "step").agg(F.when(away("c") >= away("r"), 0).otherwise(1).alias("axis"))


@query("imbalance_trigger", f"{_SQL_FRONTS}, b AS (SELECT scenario, step, r // 8 AS band, count(*) AS n FROM fr GROUP BY ALL) SELECT scenario, step, max(n) - CASE WHEN count(*) < 8 THEN 0 ELSE min(n) END >= 0.1e0 * sum(n) / 8 AS imbalanced FROM b GROUP BY ALL")
def imbalance_trigger(spark, sf_dir: str) -> DataFrame:
    """Whether the loads of eight bands in a step are apart by a tenth of their mean; a band without cells has load 0."""
    bands = _fronts(spark, sf_dir).groupBy("scenario", "step", F.floor(F.col("r") / 8).alias("band")).agg(F.count("*").alias("n"))
    least = F.when(F.count("*") < 8, 0).otherwise(F.min("n"))
    return bands.groupBy("scenario", "step").agg((F.max("n") - least >= 0.1 * F.sum("n") / 8).alias("imbalanced"))


_SWEEP = f"{SQL_FUELS}, w AS (SELECT CAST(3 * range AS DOUBLE) AS wind FROM range(7)), m(moisture) AS (SELECT CAST(a AS DOUBLE) FROM (VALUES (0.03), (0.06), (0.09), (0.12), (0.18), (0.25)) v(a))"


@query("parameter_sweep", f"WITH {_SWEEP} SELECT wind, moisture, round(avg(ln(1 + {rates.SQL_RATE.format(density=_DENSITY, damp=rates.SQL_DAMP.format(m='moisture'), wind='wind', slope='0e0', moisture='moisture')})), 6) AS mean_log_rate FROM fuels, w, m GROUP BY ALL")
def parameter_sweep(spark, sf_dir: str) -> DataFrame:
    winds, moist = F.array(*[F.lit(3.0 * k) for k in range(7)]), F.array(*[F.lit(x) for x in (0.03, 0.06, 0.09, 0.12, 0.18, 0.25)])
    rows = fuels(spark).select("*", F.explode(winds).alias("wind")).select("*", F.explode(moist).alias("moisture"))
    return rows.groupBy("wind", "moisture").agg(F.round(F.avg(F.log1p(rates.full_rate(F.col("wind"), F.lit(0.0), F.col("moisture")))), 6).alias("mean_log_rate"))


def _sql_pull(n: int) -> str:
    out, last = ", pe AS (SELECT cells.scenario, r + dr AS r, c + dc AS c, r AS to_r, c AS to_c, dist / greatest(0.001e0, rate * (0.5e0 + 0.5e0 * cos(radians(18e1 - (bearing + 18e1))))) AS seconds FROM rated cells, nb WHERE fuel BETWEEN 1 AND 13 AND rate >= 1e-6)", "ig"
    for k in range(1, n + 1):
        out += f", p{k} AS (SELECT scenario, r, c, min(toa) AS toa FROM (SELECT * FROM {last} UNION ALL SELECT pe.scenario, to_r, to_c, toa + seconds FROM {last} JOIN pe ON pe.scenario = {last}.scenario AND pe.r = {last}.r AND pe.c = {last}.c) GROUP BY ALL)"
        last = f"p{k}"
    return out


@query("toa_pull_4", f"{_SQL_EDGES}{_sql_pull(4)} SELECT scenario, r, c, round(toa, 4) AS toa FROM p4")
def toa_pull_4(spark, sf_dir: str, rounds: int | None = 4) -> DataFrame:
    """Arrival times by the rates of the cells that are reached; only those that burn are."""
    rows = _rated(spark, sf_dir)
    return spread.relax(checkpointed(spread.pull_edges(rows, size=SIZE)), _ignition(rows), rounds).select("scenario", "r", "c", F.round("toa", 4).alias("toa"))


@query("toa_pull_fixpoint", f"{sql_fixpoint(_SQL_EDGES + _sql_pull(0), 'pe')} SELECT scenario, r, c, round(toa, 4) AS toa FROM t")
def toa_pull_fixpoint(spark, sf_dir: str) -> DataFrame:
    return toa_pull_4(spark, sf_dir, None)


# A model's history and its predictions are line items: discount as the loss, tax against it as prediction and label.
@query("early_stop", "SELECT l_suppkey AS run, l_orderkey AS epoch, l_linenumber AS part, min(l_discount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS best, coalesce(l_discount < min(l_discount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL)")
def early_stop(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("loss"))
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    before = F.min("loss").over(order.rowsBetween(W.unboundedPreceding, -1))
    best = F.min("loss").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("epoch"), F.col("l_linenumber").alias("part"), best.alias("best"), F.coalesce(F.col("loss") < before, F.lit(True)).alias("improved"))


@query("model_measures", "WITH x AS (SELECT l_linenumber AS run, l_discount AS y, l_tax AS p FROM lineitem) SELECT run, round(avg((p - y) * (p - y)), 8) AS mse, round(avg((p - y) * (p - y)) FILTER (WHERE y > 0.05e0), 8) AS mse_burned, round(1e0 * count(*) FILTER (WHERE p > 0.04e0 AND y > 0.05e0) / greatest(count(*) FILTER (WHERE y > 0.05e0), 1), 8) AS recall, round(1e0 * count(*) FILTER (WHERE p > 0.04e0 AND y > 0.05e0) / greatest(count(*) FILTER (WHERE p > 0.04e0), 1), 8) AS precision FROM x GROUP BY ALL")
def model_measures(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("run"), F.col("l_discount").alias("y"), F.col("l_tax").alias("p"))
    error, true, said = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), F.col("y") > 0.05, F.col("p") > 0.04
    share = lambda of: F.round(F.count_if(true & said) / F.greatest(F.count_if(of), F.lit(1)), 8)
    return rows.groupBy("run").agg(F.round(F.avg(error), 8).alias("mse"), F.round(F.avg(F.when(true, error)), 8).alias("mse_burned"), share(true).alias("recall"), share(said).alias("precision"))
