"""Paged features, raster tiles, range joins and projections against plain Python and published values."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import projection
from cellweave.operators.spatial import range_join
from cellweave.plans import surfaces
from cellweave.sources import paged, rasters

DDL = "id long, name string, acres double, day date, geometry string"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def pages(tmp_path):
    """A function that writes pages of features by their offset and gives the folder's URI."""

    def write(by_offset):
        for offset, features in by_offset.items():
            folder = tmp_path / f"offset={offset}"
            folder.mkdir()
            (folder / "part-0.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
            (folder / "_SUCCESS").write_text("")
        return f"file://{tmp_path}"

    return write


def feature(k, **more):
    return {"type": "Feature", "properties": {"id": k, "name": f"n{k}", "acres": k / 2} | more, "geometry": None}


def test_short_page_ends_the_scan(spark, pages):
    stale = [feature(99)]
    path = pages({0: [feature(k) for k in range(3)], 3: [feature(k) for k in range(3, 6)], 6: [feature(6)], 9: stale})
    rows = paged.read_pages(spark, path, DDL, 3)
    assert sorted(r.id for r in rows.collect()) == list(range(7)) and rows.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("n", [0, 1, 3, 4, 24, 25])
def test_any_number_of_pages(spark, pages, n):
    path = pages({k: [feature(j) for j in range(k, min(k + 3, n))] for k in range(0, n, 3)})
    assert sorted(r.id for r in paged.read_pages(spark, path, DDL, 3).collect()) == list(range(n))


def test_properties_of_any_kind(spark, pages):
    odd = [feature(1, day="2016-07-01", name=None), {"type": "Feature", "properties": {"id": "2", "acres": "7.5"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}}]
    got = sorted(paged.read_pages(spark, pages({0: odd}), DDL).collect(), key=lambda r: (r.id is None, r.id))
    assert [(r.id, r.name, r.acres, str(r.day)) for r in got] == [(1, None, 0.5, "2016-07-01"), (2, None, 7.5, "None"), (None, None, None, "None")]
    assert json.loads(got[1].geometry)["coordinates"] == [1, 2]


def test_conditions_go_to_the_pages(spark, pages):
    path = pages({0: [feature(k, name=None if k == 4 else f"n{k}") for k in range(8)]})
    read = lambda *where: paged.read_pages(spark, path, DDL, 10, where)
    for where, want in (
        ([("acres", ">=", 2)], {4, 5, 6, 7}),
        ([("id", "in", [1, 5, 70])], {1, 5}),
        ([("name", "is null", None)], {4}),
        ([("name", "starts with", "n7")], {7}),
        ([("name", "<>", "n1"), ("id", "<", 3)], {0, 2}),
        ([("name", "<>", "n5"), ("id", ">", 3)], {6, 7}),
        ([("name", "is not null", None), ("id", "=", 4)], set()),
    ):
        assert {r.id for r in read(*where).collect()} == want, where
    assert sorted(r.id for r in read(("id", "<", 2)).union(read(("id", ">=", 6))).collect()) == [0, 1, 6, 7]
    with pytest.raises(Exception, match="no condition"):
        read(("nothing", "=", 1)).collect()


def test_a_frame_serves_several_queries(spark, pages):
    rows = paged.read_pages(spark, pages({0: [feature(k) for k in range(8)]}), DDL)
    assert {r.id for r in rows.where("id < 3").collect()} == {0, 1, 2} and rows.count() == 8
    assert {r.id for r in rows.where("id = 3 or acres = 0").union(rows.where("id = 7")).collect()} == {0, 3, 7}


def test_pages_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 3 else f'q"{k}', json.dumps({"type": "Point", "coordinates": [k, 0]})) for k in (5, 3, 9, 1, 7)], "id long, name string, geometry string")
    path = f"file://{tmp_path}/pages"
    paged.write_pages(rows, path, ["id"], 2, "geometry")
    back = paged.read_pages(spark, path, DDL, 2)
    assert back.rdd.getNumPartitions() == 3
    assert sorted((r.id, r.name, json.loads(r.geometry)["coordinates"][0]) for r in back.collect()) == sorted((k, None if k % 3 else f'q"{k}', k) for k in (5, 3, 9, 1, 7))


def test_schema_must_be_named(spark):
    spark.dataSource.register(paged.PagedFeatures)
    with pytest.raises(Exception, match="name the columns"):
        spark.read.format("paged_features").load("/nowhere")


def test_tiff_round_trip():
    values = np.array([[1, -2, 300], [-9999, -9990, -9989]], np.int16)
    got, valid, left, top, step = rasters.decode_tiff(rasters.encode_tiff(values, -12.5, 99.25, 30.0))
    assert (got == values).all() and valid.tolist() == [[True, True, True], [False, False, True]] and (left, top, step) == (-12.5, 99.25, 30.0)
    with pytest.raises(ValueError, match="no TIFF"):
        rasters.decode_tiff(b"GIF89a..........")


def test_tiff_of_another_make():
    """Big-endian, two strips, its own nodata value, a tie point inside the raster."""
    rows = [struct.pack(">3h", 1, 2, 3), struct.pack(">3h", 4, 5, 6)]
    fields = [(256, 3, [3]), (257, 3, [2]), (258, 3, [16]), (259, 3, [1]), (273, 4, [8, 14]), (277, 3, [1]), (278, 3, [1]), (279, 4, [6, 6]), (339, 3, [2]), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [1.0, 1.0, 0.0, 50.0, 80.0, 0.0]), (42113, 2, b"5\0")]
    body, entries = bytearray(b"MM\0*" + struct.pack(">I", 0) + rows[0] + rows[1]), b""
    for tag, kind, items in fields:
        data = items if kind == 2 else struct.pack(f">{len(items)}{rasters.KINDS[kind][0]}", *items)
        if len(data) > 4:
            at = len(body)
            body += data
            data = struct.pack(">I", at)
        entries += struct.pack(">HHI", tag, kind, len(items)) + data.ljust(4, b"\0")
    body[4:8] = struct.pack(">I", len(body))
    values, valid, left, top, step = rasters.decode_tiff(bytes(body) + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0")
    assert values.tolist() == [[1, 2, 3], [4, 5, 6]] and valid.tolist() == [[True, True, True], [True, False, True]] and (left, top, step) == (40.0, 90.0, 10.0)


def tile_rows(tile, left, top, grid):
    return [(tile, left, top, 1.0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)]


def test_mosaic(spark, tmp_path):
    """Overlap by name, holes filled by the next tile, borders, places outside."""
    one, two = [[1, 2], [3, None]], [[10, 20, 30], [40, 50, 60], [70, 80, 90]]
    cells = spark.createDataFrame(tile_rows("a", 0.0, 2.0, one) + tile_rows("b", 1.0, 2.0, two), "tile string, left double, top double, step double, r int, c int, v int")
    folder = f"file://{tmp_path}/tiles"
    assert {r.tile for r in rasters.write_tiles(cells, folder).collect()} == {"a", "b"}
    tiles, values = rasters.read_tiles(spark, folder)
    assert values.count() == 12 and {(r.tile, r.x0, r.y0, r.x1, r.y1) for r in tiles.collect()} == {("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.0, -1.0, 4.0, 2.0)}
    places = {1: (0.5, 1.5), 2: (1.5, 1.5), 3: (1.5, 0.5), 4: (2.0, 2.0), 5: (0.0, 2.0), 6: (0.0, 0.0), 7: (3.9, -0.9), 8: (4.0, 0.0), 9: (-0.1, 1.0), 10: (1.0, 1.0), 11: (None, 1.0)}
    table = spark.createDataFrame([(k, *p) for k, p in places.items()], "id long, x double, y double")
    near = rasters.mosaic(table, tiles, values, "id")
    assert {r.id: (r.tile, r.v) for r in near.collect()} == {1: ("a", 1.0), 2: ("a", 2.0), 3: ("b", 40.0), 4: ("b", 20.0), 5: ("a", 1.0), 7: ("b", 90.0), 10: ("b", 40.0)}
    smooth = {r.id: (r.tile, r.v) for r in rasters.mosaic(table, tiles, values, "id", "bilinear").collect()}
    assert smooth[2] == ("a", 2.0) and smooth[4] == ("b", 15.0) and smooth[5] == ("a", 1.0) and smooth[10] == ("b", 25.0)  # 10: a lacks a corner
    assert "NestedLoop" not in plan_of(near) and "Cartesian" not in plan_of(near)


def test_bad_file(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"II*\0 nothing of use here")
    (tmp_path / "good.tif").write_bytes(rasters.encode_tiff(np.ones((2, 2), np.int16), 0, 0, 1))
    assert [r.tile for r in rasters.read_tiles(spark, f"file://{tmp_path}", skip_bad=True)[0].collect()] == ["good"]
    with pytest.raises(Exception, match="."):
        rasters.read_tiles(spark, f"file://{tmp_path}")[0].collect()


def test_range_join(spark):
    rng = random.Random(5)
    edge = lambda: rng.choice([-7.5, -1.0, 0.0, 0.25, 3.0, 8.0, 1e6, rng.uniform(-9, 9)])
    points = [(k, rng.choice("ab"), edge(), edge()) for k in range(150)] + [(900, "a", None, 1.0), (901, None, 0.0, 0.0)]
    rects = [(k, rng.choice("ab"), edge(), edge(), edge(), edge()) for k in range(150)] + [(k + 200, "a", -7.5, 8.0, 0.0, 0.25) for k in range(3)] + [(999, "b", None, 1.0, 0.0, 1.0)]
    met = range_join(spark.createDataFrame(points, "p long, g string, x double, y double"), spark.createDataFrame(rects, "q long, g string, x0 double, x1 double, y0 double, y1 double"), "x", "y", ("g",))
    want = sorted((p[0], q[0]) for p in points for q in rects if p[1] is not None and p[1] == q[1] and None not in (*p, *q) and q[2] <= p[2] < q[3] and q[4] <= p[3] < q[5])
    assert sorted((r.p, r.q) for r in met.collect()) == want and len(want) > 300
    none = range_join(spark.createDataFrame(points, "p long, g string, x double, y double"), spark.createDataFrame([], "q long, g string, x0 double, x1 double, y0 double, y1 double"), "x", "y", ("g",))
    assert none.count() == 0


@pytest.mark.parametrize("name", ["cells_in_rectangles", "mosaic_nearest"])
def test_no_nested_loops(spark, small, name):
    plan = plan_of(getattr(surfaces, name)(spark, small))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


# Worked examples of USGS Professional Paper 1395, on Clarke's ellipsoid of 1866.
CLARKE = projection.Ellipsoid(6378206.4, 1 / 294.978698214)


def test_golden_points(spark):
    one = spark.range(1)
    conic = projection.Albers(ellipsoid=CLARKE)
    p = one.select(projection.albers(F.lit(-75.0), F.lit(35.0), conic).alias("m")).first().m
    assert p.x == pytest.approx(1885472.7, abs=0.06) and p.y == pytest.approx(1535925.0, abs=0.06)
    p = one.select(projection.transverse_mercator(F.lit(-73.5), F.lit(40.5), F.lit(-75.0), CLARKE, east=0.0).alias("m")).first().m
    assert p.x == pytest.approx(127106.5, abs=0.06) and p.y == pytest.approx(4484124.4, abs=0.06)
    p = one.select(projection.transverse_mercator(F.lit(3.0), F.lit(45.0), F.lit(3.0)).alias("m"), projection.albers(F.lit(-96.0), F.lit(23.0)).alias("o")).first()
    assert p.m.x == pytest.approx(500_000, abs=1e-6) and p.m.y == pytest.approx(0.9996 * 4984944.378, abs=1e-3)  # the meridian's arc to 45 degrees
    assert (p.o.x, p.o.y) == pytest.approx((0, 0), abs=1e-6)


def test_forth_and_back_within_a_millimetre(spark):
    places = [(lon, lat) for lon in range(-180, 181, 9) for lat in (-84.0, -60.0, -33.3, -0.5, 0.0, 12.0, 47.11, 80.0)]
    rows = spark.createDataFrame([(float(a), b) for a, b in places] + [(None, 1.0)], "lon double, lat double")
    lon, lat, lon0 = F.col("lon"), F.col("lat"), projection.central_meridian(F.col("lon"))
    utm = rows.select("lon", "lat", lon0.alias("lon0"), projection.transverse_mercator(lon, lat, lon0).alias("m"))
    utm = utm.select("lon", "lat", "m", projection.transverse_mercator_inverse(F.col("m.x"), F.col("m.y"), F.col("lon0")).alias("g"))
    conus = rows.where("lat > -84 and abs(lon + 96) < 100").select("lon", "lat", projection.albers(lon, lat).alias("m"))
    conus = conus.select("lon", "lat", "m", projection.albers_inverse(F.col("m.x"), F.col("m.y")).alias("g"))
    n = 0
    for table in (utm, conus):
        for r in table.collect():
            if r.lon is None:
                assert r.m.x is None
                continue
            metres = 111_320 * math.hypot((r.g.lon - r.lon) * math.cos(math.radians(r.lat)), r.g.lat - r.lat)
            assert metres < 1e-3, r
            n += 1
    assert n > 400


def test_conic_keeps_areas(spark):
    """A small quadrangle has the area of the ellipsoid's: its radii of curvature times its angles."""
    e2, a, lon, lat, d = projection.GRS80.e2, projection.GRS80.a, -118.0, 37.0, 1e-4
    corners = [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
    m = [r.m for r in spark.createDataFrame(corners, "lon double, lat double").select(projection.albers(F.col("lon"), F.col("lat")).alias("m")).collect()]
    got = abs(sum(m[k].x * m[(k + 1) % 4].y - m[(k + 1) % 4].x * m[k].y for k in range(4))) / 2
    s = math.sin(math.radians(lat + d / 2))
    want = a * a * (1 - e2) / (1 - e2 * s * s) ** 2 * math.cos(math.radians(lat + d / 2)) * math.radians(d) ** 2
    assert got == pytest.approx(want, rel=1e-5)
