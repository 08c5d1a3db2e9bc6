"""Raster tiles as plain GeoTIFF files of signed 16-bit values: written from cells, read as cells, and met by places.

Values of -9990 and less, and the file's own nodata value, are no data. Files are uncompressed, in strips, of one band,
north up, with square cells.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import range_join

NODATA = -9990
# Numbers of TIFF tags, and types (short, long, double, text).
WIDTH, HEIGHT, BITS, COMPRESSION, MEANING, OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PIXEL_SCALE, TIE_POINT, NO_DATA_TEXT = 33550, 33922, 42113
KINDS = {2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
TILE = "tile string, x0 double, y0 double, x1 double, y1 double, step double, width int, height int"


def encode_tiff(values: np.ndarray, left: float, top: float, step: float, nodata: int = -9999) -> bytes:
    """A file of one strip: header, values, what doesn't fit an entry, entries."""
    data = np.ascontiguousarray(values, "<i2").tobytes()
    height, width = values.shape
    text = str(nodata).encode() + b"\0"
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [16]), (COMPRESSION, 3, [1]), (MEANING, 3, [1]), (OFFSETS, 4, [8]), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [height]), (STRIP_BYTES, 4, [len(data)]), (FORMAT, 3, [2]), (PIXEL_SCALE, 12, [step, step, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (NO_DATA_TEXT, 2, text)]
    body, entries = bytearray(b"II*\0\0\0\0\0" + data), b""
    for tag, kind, items in fields:
        packed = items if kind == 2 else struct.pack(f"<{len(items)}{KINDS[kind][0]}", *items)
        if len(packed) > 4:
            body += b"\0" * (len(body) % 2)
            packed, at = struct.pack("<I", len(body)), packed
            body += at
        entries += struct.pack("<HHI", tag, kind, len(items)) + packed.ljust(4, b"\0")
    body += b"\0" * (len(body) % 2)
    body[4:8] = struct.pack("<I", len(body))
    return bytes(body) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"


def decode_tiff(data: bytes) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Values, which of them are data, left, top and step. Raises ValueError on files of another make."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    tags: dict[int, object] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in KINDS:
            continue
        code, size = KINDS[kind]
        place = at + 10 + 12 * k if n * size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = data[place : place + n] if kind == 2 else struct.unpack_from(f"{order}{n}{code}", data, place)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if (one(BITS), one(COMPRESSION, 1), one(SAMPLES, 1), one(FORMAT, 1)) != (16, 1, 1, 2) or PIXEL_SCALE not in tags or TIE_POINT not in tags:
        raise ValueError("only uncompressed signed 16-bit tiles with a place are read")
    strips = [data[o : o + n] for o, n in zip(tags[OFFSETS], tags[STRIP_BYTES], strict=True)]
    values = np.frombuffer(b"".join(strips), order + "i2").reshape(one(HEIGHT), one(WIDTH)).astype(np.int16)
    (step, down), tie = tags[PIXEL_SCALE][:2], tags[TIE_POINT]
    if step != down:
        raise ValueError("cells must be square")
    valid = values > NODATA
    if NO_DATA_TEXT in tags:
        valid &= values != float(tags[NO_DATA_TEXT].rstrip(b"\0 ").decode())
    return values, valid, tie[3] - tie[0] * step, tie[4] + tie[1] * step, step


def write_tiles(cells: DataFrame, folder: str) -> DataFrame:
    """Files of dense tiles. cells: (tile, left, top, step, r, c, v), v null where there is no data. The result, one row a
    file (tile, bytes), says what was written; a task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for b in batches:
            names, sizes = [], []
            for row in b.to_pylist():
                grid = np.full((max(x["r"] for x in row["cells"]) + 1, max(x["c"] for x in row["cells"]) + 1), -9999, np.int16)
                for x in row["cells"]:
                    grid[x["r"], x["c"]] = -9999 if x["v"] is None else x["v"]
                data = encode_tiff(grid, row["left"], row["top"], row["step"])
                with system.open_output_stream(f"{root.rstrip('/')}/{row['tile']}.tif") as out:
                    out.write(data)
                names.append(row["tile"])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["tile", "bytes"])

    one = cells.groupBy(F.col("tile").cast("string").alias("tile"), F.col("left").cast("double").alias("left"), F.col("top").cast("double").alias("top"), F.col("step").cast("double").alias("step")).agg(F.collect_list(F.struct("r", "c", F.col("v").cast("int").alias("v"))).alias("cells"))
    return one.mapInArrow(write, "tile string, bytes long")


def read_tiles(spark: SparkSession, folder: str, skip_bad: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tiles, cells) of all .tif files of a folder: (tile, x0, y0, x1, y1, step, width, height) and (tile, r, c, v) of the
    cells with data. A file of another make fails the job, or is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("tile")

    def decoded(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    values, valid, left, top, step = decode_tiff(content)
                except (ValueError, struct.error, KeyError):
                    if skip_bad:
                        continue
                    raise
                height, width = values.shape
                if whole:
                    yield pa.RecordBatch.from_pylist([{"tile": tile, "x0": left, "y0": top - height * step, "x1": left + width * step, "y1": top, "step": step, "width": width, "height": height}], pa.schema([("tile", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1", "step")), ("width", pa.int32()), ("height", pa.int32())]))
                else:
                    r, c = np.nonzero(valid)
                    yield pa.RecordBatch.from_arrays([pa.array([tile] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(values[r, c], pa.int32())], ["tile", "r", "c", "v"])

    found = files.select(name, "content")
    return found.mapInArrow(lambda b: decoded(b, True), TILE), found.mapInArrow(lambda b: decoded(b, False), "tile string, r int, c int, v int")


def mosaic(places: DataFrame, tiles: DataFrame, cells: DataFrame, key: str, way: str = "nearest") -> DataFrame:
    """(key, tile, v) of each place (key, x, y) that a tile with data covers: of the covering tiles with data at the place
    the one that comes first by name. tiles, cells: as of read_tiles; names with leading zeros sort as their numbers do.

    nearest takes the cell that holds the place. bilinear weighs the four cells around it, at a tile's border twice the
    same, and has no data where one of them that weighs anything has none. A place on a tile's lower edge or right edge is not in it.
    """
    flipped = places.select(key, "x", (-F.col("y")).alias("y"))  # rows count down from the top, whose line belongs to the tile
    extents = tiles.select("tile", "x0", "x1", (-F.col("y1")).alias("y0"), (-F.col("y0")).alias("y1"), "step", "width", "height")
    met = range_join(flipped, extents, "x", "y")
    across, down = (F.col("x") - F.col("x0")) / F.col("step"), (F.col("y") - F.col("y0")) / F.col("step")
    if way == "nearest":
        wanted = met.select(key, "tile", F.floor(down).cast("int").alias("r"), F.floor(across).cast("int").alias("c"), F.lit(1.0).alias("w"))
    else:
        sides = []
        for at, n in ((down - 0.5, "height"), (across - 0.5, "width")):
            low = F.floor(at).cast("int")
            inside = lambda k, n=n: F.least(F.greatest(k, F.lit(0)), F.col(n) - 1)
            sides.append(((inside(low), 1 - (at - low)), (inside(low + 1), at - low)))
        corners = [F.struct(r.alias("r"), c.alias("c"), (wr * wc).alias("w")) for r, wr in sides[0] for c, wc in sides[1]]
        wanted = met.select(key, "tile", F.inline(F.array(*corners)))
    values = wanted.join(cells, ["tile", "r", "c"]).groupBy(key, "tile").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum("w").alias("w"))
    return values.where(F.col("w") > 1 - 1e-9).groupBy(key).agg(F.min_by(F.struct("tile", "v"), "tile").alias("s")).select(key, "s.tile", "s.v")
