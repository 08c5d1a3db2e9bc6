"""Scenario tables, binary cubes, cell lines, load maps and metric files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import line_numbers


def read_scenarios(spark: SparkSession, path: str, schema: str, split: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """A scenario table (CSV with a header), all of it, those of a split, or those of some ids; ids that are missing fail."""
    rows = spark.read.csv(path, schema=schema, header=True)
    rows = rows if split is None else rows.where(F.col("split") == split)
    if ids is None:
        return rows
    rows = rows.where(F.col("id").isin(ids))
    missing = set(ids) - {r.id for r in rows.select("id").distinct().limit(len(ids)).collect()}
    if missing:
        raise LookupError(f"no scenario {sorted(missing)}")
    return rows


def read_cell_lines(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """(file, r, c, layers): cell files without indices, a line a cell, row by row; wholetext keeps a file's order.

    A file is one scenario, read by one task, as its lines only have a place by their order.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("k", "line")).select("file", F.floor(F.col("k") / cols).cast("int").alias("r"), (F.col("k") % cols).alias("c"), line_numbers(F.col("line")).alias("layers"))


def read_cubes(spark: SparkSession, path: str, layers: int, most: int = 4096) -> DataFrame:
    """(file, r, c, layers): binary cubes of three 32-bit counts (rows, columns, layers) and as many 32-bit floats.

    A file with other layers, too many rows or columns, or too few values fails.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, cols, n = np.frombuffer(blob[:12], "<i4").tolist() if len(blob) >= 12 else (0, 0, 0)
                if n != layers or not 0 < rows <= most or not 0 < cols <= most or len(blob) < 12 + 4 * rows * cols * n:
                    raise ValueError(f"{name} is no cube of {layers} layers")
                values = np.frombuffer(blob, "<f4", rows * cols * n, 12).reshape(rows, cols, n)
                for r in range(rows):  # a batch a row of cells
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(cols + 1) * n, pa.int32()), pa.array(values[r].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * cols), pa.array([r] * cols, pa.int32()), pa.array(np.arange(cols), pa.int32()), cells], ["file", "r", "c", "layers"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "file string, r int, c int, layers array<float>")


def write_cubes(cells: DataFrame, folder: str, layers: list[str]) -> DataFrame:
    """A binary cube for each scenario of dense cells (scenario, r, c, layers), as read_cubes reads them; one row a file
    (scenario, bytes). A task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            names, sizes = [], []
            for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, cols = max(x["r"] for x in cells) + 1, max(x["c"] for x in cells) + 1
                values = np.zeros((rows, cols, len(layers)), "<f4")
                for x in cells:
                    values[x["r"], x["c"]] = [0 if v is None else v for v in x["v"]]
                data = np.array(values.shape, "<i4").tobytes() + values.tobytes()
                with system.open_output_stream(f"{root.rstrip('/')}/{name}.bin") as out:
                    out.write(data)
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["scenario", "bytes"])

    one = F.struct("r", "c", F.array(*[F.col(x).cast("float") for x in layers]).alias("v"))
    return cells.groupBy(F.col("scenario").cast("string").alias("scenario")).agg(F.collect_list(one).alias("cells")).mapInArrow(write, "scenario string, bytes long")


def write_partition_map(split: DataFrame, path: str, mode: str = "error") -> None:
    """(scenario, r, c, partition_id) as CSV in order of scenario, row and column over the files."""
    split.select("scenario", "r", "c", "partition_id").orderBy("scenario", "r", "c").write.mode(mode).csv(path, header=True)


def write_cube(cells: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """Cells as Parquet, partitioned by split and scenario or the like; mode "ignore" leaves what is there."""
    cells.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def write_cell_csv(cells: DataFrame, path: str, layers: list[str], digits: int = 5, mode: str = "error") -> None:
    """Cells of a cube as CSV in order of row and column, layers with that many decimals."""
    cells.orderBy("scenario", "r", "c").select("scenario", "r", "c", *[F.format_string(f"%.{digits}f", F.col(x).cast("double")).alias(x) for x in layers]).write.mode(mode).csv(path, header=True)


def write_load_map(loads: DataFrame, path: str, mode: str = "error") -> None:
    write_cell_csv(loads, path, ["load"], 4, mode)


def metric_json(metrics: DataFrame, value: str) -> DataFrame:
    """One row a strategy: its values by n as a JSON object, of metrics (strategy, n, value)."""
    pairs = F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("v"))))
    return metrics.groupBy("strategy").agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["n"].cast("string"), p["v"])))).alias("json"))
