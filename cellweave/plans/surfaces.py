"""Queries over documents as features, places and cells of a growing grid: paged reads, mosaics of tiles, rectangles,
projections, regions, seeded weather, files that are written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection, seeded
from ..grid import SQL_CELLS, burnable, cells
from ..lattice import SIDE, SQL_LATTICE, document_cells
from ..operators import partition, regions, spread
from ..operators.spatial import range_join
from ..session import checkpointed, shared_folder
from ..sources import paged, rasters, restartable
from .core import query

STEP, GAP, ACROSS = 30, 12, 8


def _documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/cellweave/{uuid.uuid4().hex}-{name}"


@query("paged_features", "SELECT doc_id, source, lang, n_chars FROM documents WHERE n_chars >= 300 AND source IS NOT NULL")
def paged_features(spark, sf_dir: str) -> DataFrame:
    """Documents as features of a paged service, asked for long ones with a source."""
    path = _folder(spark, "pages")
    paged.write_pages(_documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars"), path, ["doc_id"])
    where = (("n_chars", ">=", 300), ("source", "is not null", None))
    return paged.read_pages(spark, path, "doc_id long, source string, lang string, n_chars long", where=where)


# A scenario of the grid is a tile, eight side by side, each over a quarter of the next; cells of fuel 98 have no data.
_TILES = f"t AS (SELECT DISTINCT scenario, format('{{:08d}}', scenario) AS tile, CAST(scenario % {ACROSS} * {GAP * STEP} AS DOUBLE) AS x0, CAST(scenario // {ACROSS} * {GAP * STEP} + {SIDE * STEP} AS DOUBLE) AS y1 FROM lattice), "
_PLACES = f"p AS (SELECT doc_id, CAST(doc_id * 37 % 3000 AS DOUBLE) AS x, doc_id * 11 % 2048 * 2e-1 + doc_id // 2048 * {GAP * STEP} AS y FROM documents), "
_MET = f"m AS (SELECT doc_id, scenario, tile, (y1 - y) / {STEP} AS down, (x - x0) / {STEP} AS across FROM p JOIN t ON x >= x0 AND x < x0 + {SIDE * STEP} AND y <= y1 AND y > y1 - {SIDE * STEP})"


def _mosaic(spark, sf_dir: str, way: str) -> DataFrame:
    cells = document_cells(spark, sf_dir)
    scenario = F.col("scenario")
    laid = cells.select(F.format_string("%08d", scenario).alias("tile"), (scenario % ACROSS * GAP * STEP).alias("left"), (F.floor(scenario / ACROSS) * GAP * STEP + SIDE * STEP).alias("top"), F.lit(STEP).alias("step"), "r", "c", F.when(F.col("fuel") != 98, F.col("elevation")).alias("v"))
    folder = _folder(spark, "tiles")
    rasters.write_tiles(laid, folder).agg(F.sum("bytes")).collect()
    tiles, values = rasters.read_tiles(spark, folder)
    id_ = F.col("doc_id")
    places = _documents(spark, sf_dir, "doc_id").select("doc_id", (id_ * 37 % 3000).cast("double").alias("x"), (id_ * 11 % 2048 * F.lit(0.2) + F.floor(id_ / 2048) * GAP * STEP).alias("y"))
    return rasters.mosaic(places, tiles, values, "doc_id", way)


@query("mosaic_nearest", f"{SQL_LATTICE}, {_TILES}{_PLACES}{_MET} SELECT doc_id, min(tile) AS tile, CAST(arg_min(elevation, tile) AS DOUBLE) AS v FROM m JOIN lattice l ON l.scenario = m.scenario AND l.r = floor(down) AND l.c = floor(across) WHERE fuel <> 98 GROUP BY doc_id")
def mosaic_nearest(spark, sf_dir: str) -> DataFrame:
    """Elevations of places, from raster files that overlap."""
    return _mosaic(spark, sf_dir, "nearest")


_CLIP = f"greatest(0, least({SIDE - 1}, floor({{}} - 5e-1) + {{}}))"
_SHARE = "CASE WHEN {1} = 0 THEN 1 - ({0} - 5e-1 - floor({0} - 5e-1)) ELSE {0} - 5e-1 - floor({0} - 5e-1) END"


@query("mosaic_bilinear", f"""{SQL_LATTICE}, {_TILES}{_PLACES}{_MET}, k(i, j) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
w AS (SELECT doc_id, scenario, tile, {_CLIP.format('down', 'i')} AS r, {_CLIP.format('across', 'j')} AS c, ({_SHARE.format('down', 'i')}) * ({_SHARE.format('across', 'j')}) AS w FROM m, k),
v AS (SELECT doc_id, tile, sum(w * elevation) AS v FROM w JOIN lattice l ON l.scenario = w.scenario AND l.r = w.r AND l.c = w.c WHERE fuel <> 98 GROUP BY doc_id, tile HAVING sum(w) > 1 - 1e-9)
SELECT doc_id, min(tile) AS tile, round(arg_min(v, tile), 6) AS v FROM v GROUP BY doc_id""")
def mosaic_bilinear(spark, sf_dir: str) -> DataFrame:
    return _mosaic(spark, sf_dir, "bilinear").withColumn("v", F.round("v", 6))


# A rectangle for each document in its scenario's grid; they overlap at will.
_RECTANGLES = f"x AS (SELECT doc_id, doc_id // {SIDE * SIDE} AS scenario, coalesce(n_chars, 0) % {SIDE} AS r0, least({SIDE}, coalesce(n_chars, 0) % {SIDE} + 1 + coalesce(n_chars, 0) // {SIDE} % 6) AS r1, doc_id * 7 % {SIDE} AS c0, least({SIDE}, doc_id * 7 % {SIDE} + 1 + doc_id * 3 % 9) AS c1 FROM documents WHERE doc_id IS NOT NULL)"


def _rectangles(spark, sf_dir: str) -> DataFrame:
    n, id_ = F.coalesce("n_chars", F.lit(0)), F.col("doc_id")
    r0, c0 = n % SIDE, id_ * 7 % SIDE
    rows = _documents(spark, sf_dir, "doc_id", "n_chars").where("doc_id is not null")
    return rows.select("doc_id", F.floor(id_ / (SIDE * SIDE)).alias("scenario"), r0.alias("r0"), F.least(F.lit(SIDE), r0 + 1 + F.floor(n / SIDE) % 6).alias("r1"), c0.alias("c0"), F.least(F.lit(SIDE), c0 + 1 + id_ * 3 % 9).alias("c1"))


@query("cells_in_rectangles", f"{SQL_LATTICE}, {_RECTANGLES} SELECT doc_id, count(*) AS n_cells, CAST(sum(q) AS BIGINT) AS load FROM x JOIN lattice l ON l.scenario = x.scenario AND r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY doc_id")
def cells_in_rectangles(spark, sf_dir: str) -> DataFrame:
    """Cells and load of half-open rectangles of any number."""
    met = range_join(document_cells(spark, sf_dir).select("scenario", "r", "c", "q"), _rectangles(spark, sf_dir), "r", "c", ("scenario",), ("r0", "r1", "c0", "c1"))
    return met.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.sum("q").cast("long").alias("load"))


_LONLAT = "p AS (SELECT doc_id, {lon} AS lon, {lat} AS lat FROM documents)"
_CONUS = {"lon": "-125 + doc_id * 37 % 5800 / 1e2", "lat": "245e-1 + doc_id * 11 % 2500 / 1e2"}
_WORLD = {"lon": "-180 + doc_id * 37 % 36000 / 1e2", "lat": "-80 + doc_id * 11 % 16400 / 1e2"}


def _lonlat(spark, sf_dir: str, at: dict[str, str]) -> DataFrame:
    return _documents(spark, sf_dir, "doc_id").select("doc_id", *[F.expr(e.replace("245e-1", "24.5D").replace("1e2", "100D")).alias(n) for n, e in at.items()])


def _number(x: float) -> str:
    return f"({x!r})" if "e" in repr(x) else f"({x!r}e0)"


def _sql_q(s: str) -> str:
    e2 = projection.GRS80.e2
    e = _number(e2**0.5)
    return f"{_number(1 - e2)} * ({s} / (1 - {_number(e2)} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e}))"


def _sql_albers() -> str:
    to = projection.Albers()
    n, c, rho0 = map(_number, to.constants())
    a, e2 = _number(to.ellipsoid.a), _number(to.ellipsoid.e2)
    out = f"WITH {_LONLAT.format(**_CONUS)}, s AS (SELECT *, sin(radians(lat)) AS s FROM p), h AS (SELECT *, {a} * sqrt({c} - {n} * ({_sql_q('s')})) / {n} AS rho, {n} * radians(lon - {_number(to.lon0)}) AS theta FROM s), "
    out += f"xy AS (SELECT doc_id, rho * sin(theta) AS x, {rho0} - rho * cos(theta) AS y FROM h), b AS (SELECT *, ({c} - (x * x + ({rho0} - y) * ({rho0} - y)) * ({n} * {n} / ({a} * {a}))) / {n} AS goal FROM xy), n0 AS (SELECT *, asin(goal / 2) AS phi FROM b)"
    for k in range(1, 6):
        out += f", n{k} AS (SELECT * EXCLUDE (phi, s), phi + pow(1 - {e2} * s * s, 2) / (2 * cos(phi)) * ((goal - {_sql_q('s')}) / (1 - {e2})) AS phi FROM (SELECT *, sin(phi) AS s FROM n{k - 1}))"
    return out + f" SELECT doc_id, round(x, 2) AS x, round(y, 2) AS y, round({_number(to.lon0)} + degrees(atan2(x, {rho0} - y)) / {n}, 8) AS lon, round(degrees(phi), 8) AS lat FROM n5"


@query("albers_places", _sql_albers())
def albers_places(spark, sf_dir: str) -> DataFrame:
    """Places of the contiguous United States on the equal-area conic, and back."""
    rows = _lonlat(spark, sf_dir, _CONUS).select("doc_id", projection.albers(F.col("lon"), F.col("lat")).alias("m"))
    rows = rows.select("doc_id", "m.x", "m.y", projection.albers_inverse(F.col("m.x"), F.col("m.y")).alias("g"))
    return rows.select("doc_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("g.lon", 8).alias("lon"), F.round("g.lat", 8).alias("lat"))


def _sql_utm() -> str:
    ellipsoid = projection.WGS84
    radius, forward, back, latitude = projection._series(ellipsoid)
    e, k0 = _number(ellipsoid.e2**0.5), _number(0.9996 * radius)
    terms = lambda cs, f, g, u, v: " + ".join(f"{_number(x)} * {f}({2 * k} * {u}) * {g}({2 * k} * {v})" for k, x in enumerate(cs, 1))
    out = f"WITH {_LONLAT.format(**_WORLD)}, z AS (SELECT *, floor((lon + 180) / 6) * 6 - 177 AS lon0, sin(radians(lat)) AS s FROM p), t AS (SELECT *, sinh(atanh(s) - {e} * atanh({e} * s)) AS t, radians(lon - lon0) AS d FROM z), "
    out += f"uv AS (SELECT *, atan2(t, cos(d)) AS u, atanh(sin(d) / sqrt(1 + t * t)) AS v FROM t), xy AS (SELECT doc_id, lon0, 5e5 + {k0} * (v + {terms(forward, 'cos', 'sinh', 'u', 'v')}) AS x, {k0} * (u + {terms(forward, 'sin', 'cosh', 'u', 'v')}) AS y FROM uv), "
    out += f"b AS (SELECT *, y / {k0} AS u, (x - 5e5) / {k0} AS v FROM xy), w AS (SELECT * EXCLUDE (u, v), u - ({terms(back, 'sin', 'cosh', 'u', 'v')}) AS u, v - ({terms(back, 'cos', 'sinh', 'u', 'v')}) AS v FROM b), c AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM w) "
    series = " + ".join(f"{_number(x)} * sin({2 * k} * chi)" for k, x in enumerate(latitude, 1))
    return out + f"SELECT doc_id, CAST(lon0 AS INTEGER) AS lon0, round(x, 2) AS x, round(y, 2) AS y, round(lon0 + degrees(atan2(sinh(v), cos(u))), 8) AS lon, round(degrees(chi + {series}), 8) AS lat FROM c"


@query("utm_places", _sql_utm())
def utm_places(spark, sf_dir: str) -> DataFrame:
    """Places of the world in their UTM zone, and back."""
    lon, lat, lon0 = F.col("lon"), F.col("lat"), F.col("lon0")
    rows = _lonlat(spark, sf_dir, _WORLD).withColumn("lon0", projection.central_meridian(lon).cast("int"))
    rows = rows.select("doc_id", "lon0", projection.transverse_mercator(lon, lat, lon0).alias("m"))
    rows = rows.select("doc_id", "lon0", "m.x", "m.y", projection.transverse_mercator_inverse(F.col("m.x"), F.col("m.y"), lon0).alias("g"))
    return rows.select("doc_id", "lon0", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("g.lon", 8).alias("lon"), F.round("g.lat", 8).alias("lat"))


_WEATHER = ", ".join(f"('{n}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for n, lo, hi in seeded.WEATHER)


@query("scenario_weather", f"{SQL_LATTICE}, w(parameter, lo, hi) AS (VALUES {_WEATHER}), d AS (SELECT scenario, parameter, lo, hi, CAST('0x' || substr(md5('7:' || CAST(scenario AS VARCHAR) || ':' || parameter), 1, 8) AS BIGINT) AS drawn FROM (SELECT DISTINCT scenario FROM lattice), w) SELECT scenario, parameter, drawn, round(lo + (hi - lo) * (drawn / 4294967296e0), 9) AS value FROM d")
def scenario_weather(spark, sf_dir: str) -> DataFrame:
    """Constants of each scenario, from its number and a seed."""
    table = F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in seeded.WEATHER])
    rows = document_cells(spark, sf_dir).select("scenario").distinct().select("scenario", F.inline(table))
    key, stream = F.col("scenario"), F.col("parameter")
    return rows.select("scenario", "parameter", seeded.drawn(7, key, stream).alias("drawn"), F.round(seeded.uniform(7, key, stream, F.col("lo"), F.col("hi")), 9).alias("value"))


def _sql_fill(ctes: str, mask: str, seeds: str) -> str:
    steps = "SELECT scenario, r + dr AS r, c + dc AS c FROM f, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dr, dc)"
    filled = f"f AS (SELECT scenario, r, c FROM m JOIN s USING (scenario, r, c) UNION SELECT m.scenario, m.r, m.c FROM ({steps}) g JOIN m USING (scenario, r, c))"
    return f"{ctes.replace('WITH ', 'WITH RECURSIVE ', 1)}, m AS ({mask}), s AS ({seeds}), {filled} SELECT scenario, r, c FROM f UNION ALL SELECT scenario, r, c FROM m WHERE scenario NOT IN (SELECT scenario FROM f)"


@query("flood_fill_documents", _sql_fill(SQL_LATTICE, "SELECT scenario, r, c FROM lattice WHERE fuel BETWEEN 1 AND 13", "SELECT scenario, r, c FROM lattice WHERE q % 50 = 7"))
def flood_fill_documents(spark, sf_dir: str) -> DataFrame:
    """Cells that burn and that a cell with a certain quantity reaches, over the growing grid, in tiles of an odd size."""
    rows = document_cells(spark, sf_dir)
    return regions.flood_fill(rows.where(burnable(F.col("fuel"))), rows.where(F.col("q") % 50 == 7), ["scenario"], 6)


@query("flood_fill", _sql_fill(SQL_CELLS, "SELECT scenario, r, c FROM cells WHERE fuel BETWEEN 1 AND 13", "SELECT scenario, r, c FROM cells WHERE fuel BETWEEN 1 AND 13 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY greatest(abs(r - 32), abs(c - 32)), r, c) = 1"))
def flood_fill(spark, sf_dir: str) -> DataFrame:
    """Cells that burn and that the one nearest to the middle reaches, over all grids."""
    rows = cells(spark, sf_dir)
    return regions.flood_fill(rows.where(burnable(F.col("fuel"))), spread.nearest_burnable(rows), ["scenario"], 16)


@query("kd_documents", f"{SQL_LATTICE}, ld AS (SELECT scenario, r, c, q AS load FROM lattice), {partition.sql_kd(8, SIDE, 'ld')} SELECT scenario, CAST(dense_rank() OVER (PARTITION BY scenario ORDER BY path) - 1 AS INTEGER) AS leaf, r0, r1, c0, c1, CAST(sum(load) AS BIGINT) AS load FROM kd GROUP BY scenario, path, r0, r1, c0, c1")
def kd_documents(spark, sf_dir: str) -> DataFrame:
    """Balanced rectangles of every scenario of the growing grid."""
    return partition.kd_rectangles(document_cells(spark, sf_dir).withColumnRenamed("q", "load"), 8, SIDE, ["scenario"]).drop("path")


@query("written_once", f"{SQL_LATTICE}, n AS (SELECT count(DISTINCT scenario) AS n FROM lattice) SELECT scenario, count(*) AS n_cells, CAST(sum(q) AS BIGINT) AS load, any_value(n) AS written, 0 AS skipped, 0 AS again_written, any_value(n) AS again_skipped FROM lattice, n GROUP BY scenario")
def written_once(spark, sf_dir: str) -> DataFrame:
    """A cube written scenario by scenario, and once more, which writes nothing; the files' own cells."""
    path, rows = _folder(spark, "cube"), document_cells(spark, sf_dir)
    first = restartable.write_missing(rows, path, ["scenario"])
    again = restartable.write_missing(rows, path, ["scenario"])
    told = [F.lit(v).cast(k).alias(n) for v, k, n in ((first["written"], "long", "written"), (first["skipped"], "int", "skipped"), (again["written"], "int", "again_written"), (again["skipped"], "long", "again_skipped"))]
    back = spark.read.parquet(path).groupBy(F.col("scenario").cast("long").alias("scenario")).agg(F.count("*").alias("n_cells"), F.sum("q").cast("long").alias("load"))
    return back.select("*", *told)


@query("scanned_labels", f"{SQL_LATTICE}, n AS (SELECT count(DISTINCT scenario) AS n_wanted, count(DISTINCT scenario) FILTER (WHERE scenario % 5 = 1) AS n_missing FROM lattice) SELECT scenario, count(*) AS n_cells, CAST(sum(q) AS BIGINT) AS load, any_value(n_wanted) AS n_wanted, any_value(n_missing) AS n_missing, any_value(n_wanted - n_missing) AS n_read, CAST(0 AS BIGINT) AS n_failed FROM lattice, n WHERE scenario % 5 <> 1 GROUP BY scenario")
def scanned_labels(spark, sf_dir: str) -> DataFrame:
    """Labels of all scenarios from a file each, of which every fifth was never made: their cells, and how many files were
    read, missing and failed."""
    rows, folder = document_cells(spark, sf_dir), _folder(spark, "labels")
    made = rows.where("scenario % 5 <> 1").select(F.col("scenario").cast("string").alias("tile"), F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1).alias("step"), "r", "c", F.col("q").alias("v"))
    rasters.write_tiles(made, folder).agg(F.sum("bytes")).collect()

    def labels(content: bytes):
        values = rasters.decode_tiff(content)[0]
        return [{"n_cells": values.size, "load": int(values.sum())}]

    found, counts = restartable.scan_files(rows.select("scenario"), "scenario", folder, "*.tif", "regexp_extract(file, '([^/]+)[.]tif$', 1)", labels, "n_cells long, load long")
    found = checkpointed(found)
    told = counts.get
    return found.select("scenario", "n_cells", "load", *[F.lit(told[c]).cast("long").alias(c) for c in ("n_wanted", "n_missing", "n_read", "n_failed")])
