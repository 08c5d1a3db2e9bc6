"""Round trips of files and a stream against the same counts over the table."""

import json

import pytest

from cellweave.sources import files
from cellweave.streaming.windows import windowed_counts


def test_arrivals_round_trip(spark, tmp_path):
    rows = [(1, r, c, None if (r + c) % 3 == 0 else r * 1.005 + c) for r in range(8) for c in range(8)]
    arrivals = spark.createDataFrame(rows, "scenario int, r int, c int, toa double")
    path = str(tmp_path / "toa")
    files.write_arrivals(arrivals, path)
    files.write_arrivals(arrivals.limit(0), path, "ignore")
    got = {(x.r, x.c): x.toa for x in files.dense(files.read_arrivals(spark, path), arrivals).collect()}
    assert len(got) == 64
    assert all((got[r, c] is None) == (t is None) and (t is None or got[r, c] == pytest.approx(t, abs=0.0051)) for _, r, c, t in rows)


def test_cells_with_bad_numbers(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("r,c,fuel,slope\n0,0,3,1.5\n0,1,x,-9999\n1,0,,2\n")
    got = files.read_cells(spark, str(tmp_path / "cells.csv"), ["fuel", "slope"]).orderBy("r", "c").collect()
    assert [tuple(x) for x in got] == [(0, 0, 3.0, 1.5), (0, 1, 0.0, 0.0), (1, 0, 0.0, 2.0)]


def test_features(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    shapes = [{"type": "Polygon", "coordinates": [ring, [[9, 9]]]}, {"type": "MultiPolygon", "coordinates": [[ring], [[[9, 9]]]]}, None, {"type": "Point", "coordinates": [1, 1]}]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"name": f"n{k}"}, "geometry": s} for k, s in enumerate(shapes)]}))
    got = {x.name: (x.lon, x.lat) for x in files.read_features(spark, str(tmp_path / "f.json"), "name: string").collect()}
    assert got == {"n0": (0.8, 0.8), "n1": (0.8, 0.8), "n2": (None, None), "n3": (None, None)}


def test_stream_equals_table(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "event_type", width="1 day")
    run = stream.writeStream.format("memory").queryName("day_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = lambda df: sorted((str(x.start), x.event_type, x.n, round(x.total, 6)) for x in df.collect())
    got = rows(spark.table("day_counts"))
    assert got == rows(windowed_counts(table, "event_type", width="1 day")) and sum(x[2] for x in got) == table.count()
