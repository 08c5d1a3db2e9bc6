"""Reports on the growing grid: aspects, scores of all cells, rates by weather, ignition in order of a search, hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rates, search
from ..grid import SQL_FUELS, burnable, fuels
from ..lattice import SIDE, SQL_LATTICE, document_cells
from ..operators import regions
from ..sources.cubes import metric_json
from .core import _DENSITY, QUERIES, SQL, query
from .scenarios import _SQL_SWEEP, _sweep

_LAYERS = ("q", "fuel", "slope", "elevation")


def _slopes(rows: DataFrame) -> DataFrame:
    """With dx and dy of the elevation, in metres a metre: central differences, one-sided ones at the borders."""

    def along(at: str, across: str) -> Column:
        line = W.partitionBy("scenario", across).orderBy(at)
        after, before, here = F.lead("elevation").over(line), F.lag("elevation").over(line), F.col("elevation")
        return F.when(F.col(at) == 0, (after - here).cast("double")).when(F.col(at) == SIDE - 1, (here - before).cast("double")).otherwise((after - before) / 2) / 30

    return rows.withColumns({"dx": along("c", "r"), "dy": along("r", "c")})


_SQL_SLOPES = f"""{SQL_LATTICE}, g AS (SELECT scenario, r, c,
  CASE WHEN c = 0 THEN lead(elevation) OVER x - elevation WHEN c = {SIDE - 1} THEN elevation - lag(elevation) OVER x ELSE (lead(elevation) OVER x - lag(elevation) OVER x) / 2e0 END / 3e1 AS dx,
  CASE WHEN r = 0 THEN lead(elevation) OVER y - elevation WHEN r = {SIDE - 1} THEN elevation - lag(elevation) OVER y ELSE (lead(elevation) OVER y - lag(elevation) OVER y) / 2e0 END / 3e1 AS dy
  FROM lattice WINDOW x AS (PARTITION BY scenario, r ORDER BY c), y AS (PARTITION BY scenario, c ORDER BY r))"""


@query("aspect_degrees", f"{_SQL_SLOPES}, a AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 18e1 ELSE degrees(atan2(dy, -dx)) + 36e1 END AS a FROM g) SELECT scenario, r, c, round(100 * sqrt(dx * dx + dy * dy), 6) AS slope_pct, round(CASE WHEN a >= 36e1 THEN a - 36e1 ELSE a END, 6) AS aspect FROM a")
def aspect_degrees(spark, sf_dir: str) -> DataFrame:
    """Slope in per cent and aspect in degrees from 0 to 360 of every cell; a flat cell faces 180."""
    dx, dy = F.col("dx"), F.col("dy")
    turned = F.when((dx == 0) & (dy == 0), 180.0).otherwise(F.degrees(F.atan2(dy, -dx)) + 360)
    rows = _slopes(document_cells(spark, sf_dir)).withColumn("a", turned)
    return rows.select("scenario", "r", "c", F.round(100 * F.sqrt(dx * dx + dy * dy), 6).alias("slope_pct"), F.round(F.when(F.col("a") >= 360, F.col("a") - 360).otherwise(F.col("a")), 6).alias("aspect"))


_MOMENTS = ", ".join(f"avg({x}) FILTER (WHERE scenario % 4 <> 3) AS m_{x}, greatest(stddev_samp({x}) FILTER (WHERE scenario % 4 <> 3), 1e-6) AS s_{x}" for x in _LAYERS)


@query("zscore_cells", f"{SQL_LATTICE}, n AS (SELECT {_MOMENTS} FROM lattice) SELECT scenario, r, c, " + ", ".join(f"round(({x} - m_{x}) / s_{x}, 6) AS {x}" for x in _LAYERS) + " FROM lattice, n")
def zscore_cells(spark, sf_dir: str) -> DataFrame:
    """Every cell's layers less the mean over the deviation of the training scenarios, three of four."""
    rows = document_cells(spark, sf_dir)
    own = lambda x: F.when(F.col("scenario") % 4 != 3, F.col(x))
    moments = rows.agg(*[f for x in _LAYERS for f in (F.avg(own(x)).alias(f"m_{x}"), F.greatest(F.stddev_samp(own(x)), F.lit(1e-6)).alias(f"s_{x}"))]).first()
    score = lambda x: F.round((F.col(x) - F.lit(moments[f"m_{x}"])) / F.lit(moments[f"s_{x}"]), 6).alias(x)
    return rows.select("scenario", "r", "c", *map(score, _LAYERS))


@query("fuel_or_first", f"{SQL_LATTICE}, {SQL_FUELS} SELECT scenario, r, c, lattice.fuel AS code, fuels.fuel AS model, w1, sv, mx FROM lattice JOIN fuels ON fuels.fuel = CASE WHEN lattice.fuel BETWEEN 1 AND 13 THEN lattice.fuel ELSE 1 END")
def fuel_or_first(spark, sf_dir: str) -> DataFrame:
    """Each cell's fuel model; the first where its code has none."""
    rows, table = document_cells(spark, sf_dir).withColumnRenamed("fuel", "code"), fuels(spark).select("fuel", "w1", "sv", "mx")
    met = rows.join(F.broadcast(table.withColumnRenamed("fuel", "model")), F.col("code") == F.col("model"), "left")  # 13 rows
    first = table.where("fuel = 1").first()
    return met.select("scenario", "r", "c", "code", *[F.coalesce(F.col(n), F.lit(first[k])).alias(n) for n, k in (("model", "fuel"), ("w1", "w1"), ("sv", "sv"), ("mx", "mx"))])


@query("reduced_rate_cells", f"{SQL_LATTICE}, {SQL_FUELS} SELECT scenario, r, c, round(ln(1 + {rates.SQL_RATE.format(density='w1 / delta', damp='1e0', wind='5e0', slope='slope', moisture='0.05e0')}), 6) AS log_rate FROM lattice JOIN fuels USING (fuel)")
def reduced_rate_cells(spark, sf_dir: str) -> DataFrame:
    """The rate from the finest load alone, of every cell that burns."""
    met = document_cells(spark, sf_dir).join(F.broadcast(fuels(spark)), "fuel")
    return met.select("scenario", "r", "c", F.round(F.log1p(rates.reduced_rate(F.lit(5.0), F.col("slope").cast("double"))), 6).alias("log_rate"))


_WINDS, _MOISTURES = [3.0 * k for k in range(7)], [0.03, 0.06, 0.09, 0.12, 0.18, 0.25]


@query("weather_sweep", f"{SQL_LATTICE}, {SQL_FUELS}, n AS (SELECT fuel, slope, count(*) AS n FROM lattice GROUP BY ALL), w AS (SELECT unnest([{', '.join(f'{x!r}e0' for x in _WINDS)}]) AS wind), m AS (SELECT unnest([{', '.join(f'{x!r}e0' for x in _MOISTURES)}]) AS moisture), x AS (SELECT wind, moisture, n, {rates.SQL_RATE.format(density=_DENSITY, damp=rates.SQL_DAMP.format(m='moisture'), wind='wind', slope='slope', moisture='moisture')} AS rate FROM n JOIN fuels USING (fuel), w, m) SELECT wind, moisture, CAST(sum(n) AS BIGINT) AS n_cells, round(sum(n * ln(1 + rate)) / sum(n), 6) AS mean_log_rate, CAST(sum(CASE WHEN rate > 1e-6 THEN n ELSE 0 END) AS BIGINT) AS n_spreading FROM x GROUP BY ALL")
def weather_sweep(spark, sf_dir: str) -> DataFrame:
    """Mean rate over all cells that burn for each wind and moisture. Cells are counted by fuel and slope first, so that the
    sweep multiplies a small table and not the cells."""
    counted = document_cells(spark, sf_dir).groupBy("fuel", "slope").agg(F.count("*").alias("n")).join(F.broadcast(fuels(spark)), "fuel")
    grid = counted.withColumn("wind", F.explode(F.array(*map(F.lit, _WINDS)))).withColumn("moisture", F.explode(F.array(*map(F.lit, _MOISTURES))))
    grid = grid.withColumn("rate", rates.full_rate(F.col("wind"), F.col("slope").cast("double"), F.col("moisture")))
    n = F.col("n")
    return grid.groupBy("wind", "moisture").agg(F.sum("n").alias("n_cells"), F.round(F.sum(n * F.log1p("rate")) / F.sum("n"), 6).alias("mean_log_rate"), F.sum(F.when(F.col("rate") > 1e-6, n).otherwise(0)).alias("n_spreading"))


_MIDDLE = SIDE // 2


def _first_burnable(spark, sf_dir: str, turn) -> DataFrame:
    rows = document_cells(spark, sf_dir).where(burnable(F.col("fuel")))
    away = turn(F.col("r") - _MIDDLE, F.col("c") - _MIDDLE)
    return rows.groupBy("scenario").agg(F.min(F.struct(away.alias("turn"), "r", "c")).alias("m")).select("scenario", "m.r", "m.c", F.col("m.turn.far").cast("int").alias("far"))


for _name, _turn, _key in (("ignition_in_turn_8", search.turn_of_8, search.SQL_8), ("ignition_in_turn_4", search.turn_of_4, search.SQL_4)):
    _order = _key.format(r=f"(r - {_MIDDLE})", c=f"(c - {_MIDDLE})")
    _far = f"greatest(abs(r - {_MIDDLE}), abs(c - {_MIDDLE}))" if _name.endswith("8") else f"abs(r - {_MIDDLE}) + abs(c - {_MIDDLE})"

    @query(_name, f"{SQL_LATTICE} SELECT scenario, r, c, CAST({_far} AS INTEGER) AS far FROM lattice WHERE fuel BETWEEN 1 AND 13 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY {_order}) = 1")
    def ignition_in_turn(spark, sf_dir: str, turn=_turn) -> DataFrame:
        """The cell that burns which a search from the middle meets first."""
        return _first_burnable(spark, sf_dir, turn)


@query("hourly_isochrones", f"{SQL_LATTICE}, t AS (SELECT scenario, q * 1000 AS toa FROM lattice WHERE q > 0), m AS (SELECT scenario, max(toa) AS last FROM t GROUP BY scenario), h AS (SELECT scenario, CAST(range AS INTEGER) AS hour FROM m, range(1, 25) WHERE range * 3600 <= last) SELECT h.scenario, hour, count(*) FILTER (WHERE toa <= hour * 3600) AS reached, count(*) FILTER (WHERE toa <= hour * 3600 AND toa > (hour - 1) * 3600) AS in_hour FROM h JOIN t ON t.scenario = h.scenario GROUP BY ALL")
def hourly_isochrones(spark, sf_dir: str) -> DataFrame:
    """For each full hour up to the last arrival and a day: cells reached by then, and in that hour. Times are counted by
    hour first, so that the running sum goes over 25 rows a scenario."""
    toa = F.col("q") * 1000
    rows = document_cells(spark, sf_dir).where("q > 0").groupBy("scenario", F.ceil(toa / 3600).cast("int").alias("hour")).agg(F.count("*").alias("n"), F.max(toa).alias("latest"))
    whole = rows.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("at"), F.max("latest").alias("last"))
    hours = whole.select("scenario", "at", F.explode(F.filter(F.sequence(F.lit(1), F.lit(24)), lambda h: h * 3600 <= F.col("last"))).alias("hour"))
    in_hour = F.coalesce(F.try_element_at("at", F.col("hour")), F.lit(0))
    reached = F.aggregate(F.map_entries("at"), F.lit(0).cast("long"), lambda n, e: n + F.when(e["key"] <= F.col("hour"), e["value"]).otherwise(0))
    return hours.select("scenario", "hour", reached.alias("reached"), in_hour.cast("long").alias("in_hour"))


@query("burned_rmse_hours", f"{SQL_LATTICE}, p AS (SELECT scenario, q / 1e2 AS y, slope / 6e1 AS p FROM lattice) SELECT scenario, count(*) FILTER (WHERE y > 0) AS n_burned, round(sqrt(avg((p - y) * (p - y)) FILTER (WHERE y > 0)) * 24, 6) AS burned_rmse_hours, round(sqrt(avg((p - y) * (p - y))) * 24, 6) AS rmse_hours FROM p GROUP BY ALL")
def burned_rmse_hours(spark, sf_dir: str) -> DataFrame:
    """The error, in hours, of times given as shares of a day; slopes stand in for predictions."""
    y, p = F.col("q") / 100, F.col("slope") / 60
    square, burned = (p - y) * (p - y), y > 0
    hours = lambda x: F.round(F.sqrt(F.avg(x)) * 24, 6)
    return document_cells(spark, sf_dir).groupBy("scenario").agg(F.count_if(burned).alias("n_burned"), hours(F.when(burned, square)).alias("burned_rmse_hours"), hours(square).alias("rmse_hours"))


@query("online_static_mean", f"WITH s AS ({SQL['online_static']}) SELECT round(avg(relative_time), 6) AS mean_relative_time, min(relative_time) AS best, max(relative_time) AS worst, count(*) AS scenarios FROM s")
def online_static_mean(spark, sf_dir: str) -> DataFrame:
    """The relative makespan of the static layout over all scenarios, and their count."""
    x = "relative_time"
    return QUERIES["online_static"](spark, sf_dir).agg(F.round(F.avg(x), 6).alias("mean_relative_time"), F.min(x).alias("best"), F.max(x).alias("worst"), F.count("*").alias("scenarios"))


@query("sweep_json", f"{_SQL_SWEEP} SELECT strategy, '{{' || string_agg('\"' || n || '\":' || relative_time, ',' ORDER BY n) || '}}' AS json FROM mean GROUP BY ALL")
def sweep_json(spark, sf_dir: str) -> DataFrame:
    """Mean relative time by number of parts, as one JSON object a strategy."""
    return metric_json(_sweep(spark, sf_dir), "relative_time")


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{x}' AS layer, CAST({x} AS DOUBLE) AS v FROM lattice" for x in _LAYERS) + ")"


@query("layer_table", f"{SQL_LATTICE}, {_LONG} SELECT layer, count(*) AS n, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(100e0 * count(*) FILTER (WHERE v = 0) / count(*), 6) AS pct_zero, count(DISTINCT v) AS n_unique, max(v) <= 1.0001e0 AS normalized, count(DISTINCT v) <= 1 OR stddev_pop(v) < 1e-9 AS constant FROM l GROUP BY layer")
def layer_table(spark, sf_dir: str) -> DataFrame:
    """Statistics and flags of each layer over all cells, in one table. Values are counted first, so that a layer's distinct
    values, and not its cells, make the statistics."""
    values = document_cells(spark, sf_dir).select(*[F.col(x).cast("double").alias(x) for x in _LAYERS]).unpivot([], list(_LAYERS), "layer", "v").groupBy("layer", "v").agg(F.count("*").alias("k"))
    k, v = F.col("k"), F.col("v")
    sums = values.groupBy("layer").agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(k * v) / F.sum("k")).alias("m"), F.sum(k * v * v).alias("squares"), F.sum(F.when(v == 0, k).otherwise(0)).alias("zeros"), F.count("v").alias("n_unique"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - F.col("m") * F.col("m")))
    return sums.select("layer", "n", "lo", "hi", F.round("m", 6).alias("mean"), F.round(std, 6).alias("std"), F.round(100 * F.col("zeros") / F.col("n"), 6).alias("pct_zero"), "n_unique", (F.col("hi") <= 1.0001).alias("normalized"), ((F.col("n_unique") <= 1) | (std < 1e-9)).alias("constant"))


@query("load_targets", f"{SQL_LATTICE}, x AS (SELECT scenario, r, 'time' AS target, q / 1e2 AS load FROM lattice UNION ALL SELECT scenario, r, 'burn', CASE WHEN q > 0 THEN 1e0 ELSE 0e0 END FROM lattice) SELECT scenario, target, round(sum(load), 6) AS load, round(max(load), 6) AS most FROM (SELECT scenario, target, r // 4 AS band, sum(load) AS load FROM x GROUP BY ALL) GROUP BY ALL")
def load_targets(spark, sf_dir: str) -> DataFrame:
    """The loads of bands of four rows under either target: a cell's time, or whether it is reached."""
    q = F.col("q")
    choices = F.array(F.struct(F.lit("time").alias("target"), (q / 100).alias("load")), F.struct(F.lit("burn").alias("target"), F.when(q > 0, 1.0).otherwise(0.0).alias("load")))
    bands = document_cells(spark, sf_dir).select("scenario", F.floor(F.col("r") / 4).alias("band"), F.inline(choices)).groupBy("scenario", "target", "band").agg(F.sum("load").alias("load"))
    return bands.groupBy("scenario", "target").agg(F.round(F.sum("load"), 6).alias("load"), F.round(F.max("load"), 6).alias("most"))


@query("first_scenarios", f"{SQL_LATTICE} SELECT scenario, split, n_cells, load FROM (SELECT scenario, CASE WHEN scenario % 4 = 3 THEN 'test' ELSE 'train' END AS split, count(*) AS n_cells, CAST(sum(q) AS BIGINT) AS load FROM lattice GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY split ORDER BY scenario) <= 5")
def first_scenarios(spark, sf_dir: str) -> DataFrame:
    """The first five scenarios of each split, by number, with their cells: a top-k of each, before any cell is summed."""
    cells = document_cells(spark, sf_dir)
    split = F.when(F.col("scenario") % 4 == 3, "test").otherwise("train")
    names = cells.select("scenario", split.alias("split")).distinct()
    first = [names.where(F.col("split") == s).orderBy("scenario").limit(5) for s in ("train", "test")]
    chosen = first[0].unionByName(first[1])
    return cells.join(F.broadcast(chosen), "scenario").groupBy("scenario", "split").agg(F.count("*").alias("n_cells"), F.sum("q").cast("long").alias("load"))  # ten rows


_RAW = "CASE WHEN q % 7 = 0 THEN -9999 WHEN q % 11 = 0 THEN -9990 ELSE q END"


@query("nodata_cells", f"{SQL_LATTICE}, x AS (SELECT scenario, r, c, {_RAW} AS raw FROM lattice) SELECT scenario, r, c, raw, CAST(CASE WHEN raw <= -9990 THEN -9999 ELSE raw END AS BIGINT) AS normalised, CAST(CASE WHEN raw <= -9990 OR raw = 42 THEN 0 ELSE raw END AS BIGINT) AS filled, raw <= -9990 OR raw = 42 AS no_data FROM x")
def nodata_cells(spark, sf_dir: str) -> DataFrame:
    """Missing values of a raster, -9990 and less or its own code 42: as one code for files, as 0 for cubes."""
    raw = F.expr(_RAW)
    lacks = (raw <= -9990) | (raw == 42)
    return document_cells(spark, sf_dir).select("scenario", "r", "c", raw.cast("long").alias("raw"), F.when(raw <= -9990, -9999).otherwise(raw).cast("long").alias("normalised"), F.when(lacks, 0).otherwise(raw).cast("long").alias("filled"), lacks.alias("no_data"))


_REFLECT = "CASE WHEN {x} < 0 THEN -({x}) WHEN {x} >= " + str(SIDE) + " THEN 2 * " + str(SIDE - 1) + " - ({x}) ELSE {x} END"


@query("window_samples", f"""{SQL_LATTICE}, n AS (SELECT avg(fuel) FILTER (WHERE scenario % 4 <> 3) AS m, greatest(stddev_samp(fuel) FILTER (WHERE scenario % 4 <> 3), 1e-6) AS s FROM lattice),
z AS (SELECT scenario, r, c, (fuel - m) / s AS z FROM lattice, n), o AS (SELECT scenario, r, c, q, a.range AS i, b.range AS j FROM lattice, range(-4, 5) a, range(-4, 5) b),
t AS (SELECT scenario, r, c, q, i, j, {_REFLECT.format(x="r + i")} AS pr, {_REFLECT.format(x="c + j")} AS pc FROM o)
SELECT t.scenario, t.r, t.c, CASE WHEN t.scenario % 4 = 3 THEN 'test' ELSE 'train' END AS split, any_value(t.q) / 1e2 AS target, CAST(any_value(t.q) > 0 AS INTEGER) AS burned, round(sum(z * ((i + 4) * 9 + j + 5)), 5) AS weighted, round(min(z), 6) AS lo, round(max(z), 6) AS hi
FROM t JOIN z ON z.scenario = t.scenario AND z.r = pr AND z.c = pc GROUP BY t.scenario, t.r, t.c""")
def window_samples(spark, sf_dir: str) -> DataFrame:
    """A sample for each cell: its split, both targets, and the 9 x 9 window of normalised fuel around it, here as the sum
    of its values by their place and its ends."""
    rows = document_cells(spark, sf_dir)
    own = F.when(F.col("scenario") % 4 != 3, F.col("fuel"))
    norm = rows.agg(F.avg(own).alias("m"), F.greatest(F.stddev_samp(own), F.lit(1e-6)).alias("s")).first()
    windows = regions.patches(rows.withColumn("z", (F.col("fuel") - F.lit(norm.m)) / F.lit(norm.s)), 9, SIDE, ["scenario"], "z")
    weighted = F.aggregate(F.zip_with("patch", F.sequence(F.lit(1), F.lit(81)), lambda z, k: z * k), F.lit(0.0), lambda s, x: s + x)
    samples = windows.select("scenario", "r", "c", F.round(weighted, 5).alias("weighted"), F.round(F.array_min("patch"), 6).alias("lo"), F.round(F.array_max("patch"), 6).alias("hi"))
    split = F.when(F.col("scenario") % 4 == 3, "test").otherwise("train")
    return samples.join(rows.select("scenario", "r", "c", split.alias("split"), (F.col("q") / 100).alias("target"), (F.col("q") > 0).cast("int").alias("burned")), ["scenario", "r", "c"])
