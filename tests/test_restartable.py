"""Outputs that are written once, mended where broken, and files that are counted."""

import os
import struct
from pathlib import Path

import pytest

from cellweave.sources import restartable


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(s, split, k, k * 0.5) for s, split in (("S1", "train"), ("S 2/x", "train"), ("S3", "test"), (None, "test")) for k in range(20)], "scenario string, split string, k int, v double")


def state(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def same(spark, path, rows):
    back = spark.read.parquet(path).select("scenario", "split", "k", "v")
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_second_run_writes_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "cube")
    assert restartable.write_missing(rows, path, ["split", "scenario"]) == {"written": 4, "skipped": 0}
    before = state(tmp_path)
    assert restartable.write_missing(rows, path, ["split", "scenario"]) == {"written": 0, "skipped": 4}
    assert state(tmp_path) == before
    same(spark, path, rows)


@pytest.mark.parametrize("way", ["truncated", "deleted", "added", "no manifest"])
def test_broken_folders_are_written_anew(spark, rows, tmp_path, way):
    path = str(tmp_path / "cube")
    restartable.write_missing(rows, path, ["split", "scenario"])
    before = state(path)
    victim = next(f for f in sorted(Path(path).rglob("*.parquet")) if "scenario=S1" in str(f))
    if way == "truncated":
        os.truncate(victim, victim.stat().st_size - 7)
    elif way == "deleted":
        victim.unlink()
    elif way == "added":
        (victim.parent / "part-99.parquet").write_bytes(victim.read_bytes())
    else:
        for f in Path(path + ".manifest").iterdir():
            f.unlink()
    for crc in victim.parent.glob(".*.crc"):
        crc.unlink()
    written = restartable.write_missing(rows, path, ["split", "scenario"])["written"]
    assert written == (4 if way == "no manifest" else 1)
    if way != "no manifest":
        assert all(state(path).get(f) == s for f, s in before.items() if f != str(victim))
    same(spark, path, rows)
    assert restartable.write_missing(rows, path, ["split", "scenario"])["written"] == 0


def test_new_scenarios_are_added(spark, rows, tmp_path):
    path = str(tmp_path / "cube")
    restartable.write_missing(rows.where("scenario = 'S1'"), path, ["split", "scenario"])
    assert restartable.write_missing(rows, path, ["split", "scenario"]) == {"written": 3, "skipped": 1}
    same(spark, path, rows)
    assert restartable.write_missing(rows.limit(0), path, ["split", "scenario"]) == {"written": 0, "skipped": 0}


def test_counts_of_files(spark, tmp_path):
    for name, content in (("S1", struct.pack("<2f", 1, 2)), ("S2", b"abc"), ("S4", b""), ("S9", struct.pack("<f", 9))):
        (tmp_path / f"{name}.lab").write_bytes(content)
    (tmp_path / "S3.txt").write_text("no label")

    def decode(content):
        if len(content) % 4:
            raise ValueError("cut off")
        return ({"v": x} for x in struct.unpack(f"<{len(content) // 4}f", content))

    wanted = spark.createDataFrame([("S1",), ("S2",), ("S3",), ("S4",), ("S4",)], "id string")
    got, counts = restartable.scan_files(wanted, "id", f"file://{tmp_path}", "*.lab", "regexp_extract(file, '([^/]+)[.]lab$', 1)", decode, "v double")
    assert sorted((r.id, r.v) for r in got.collect()) == [("S1", 1.0), ("S1", 2.0)]
    assert counts.get == {"n_wanted": 4, "n_missing": 2, "n_failed": 1, "n_read": 1, "n_rows": 2}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"12345")
    (tmp_path / "y.txt").write_text("")
    assert [(r.file.rsplit("/", 2)[1:], r.length) for r in restartable.files_of(spark, f"file://{tmp_path}", "*.bin").collect()] == [(["a", "x.bin"], 5)]
    assert restartable.files_of(spark, f"file://{tmp_path}/nothing").isEmpty()
