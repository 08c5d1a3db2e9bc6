"""Outputs that can be run again: what is whole stays, what lacks or is broken is written; and inputs of many files, with
counts of what was read, missing and failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MANIFEST = "file string, length long"


def files_of(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, length) of the files below a folder, which are not read; none where there is no folder."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return found.select(F.col("path").alias("file"), "length")


def _keys(files: DataFrame, by: list[str]) -> DataFrame:
    """files with the values of their partition's columns, as texts."""
    return files.select("*", *[F.url_decode(F.regexp_extract("file", f"/{c}=([^/]*)/", 1)).alias(c) for c in by])


def write_missing(rows: DataFrame, path: str, by: list[str]) -> dict[str, int]:
    """Writes rows to Parquet files, a folder for each value of `by`, where a former run left none that are whole.

    A manifest beside the folder lists each file with its length, once its folder is complete. A folder is whole if its
    files and lengths are those of the manifest; any other is written anew, as are folders that the manifest lacks. Nulls
    in `by` have a folder of their own. Returns how many folders were written and skipped; where all are whole, no job but
    the comparison runs and no file changes.
    """
    spark, manifest = rows.sparkSession, path.rstrip("/") + ".manifest"
    wanted = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in by]).distinct()
    lists = files_of(spark, manifest, "*.parquet")
    known = spark.read.schema(MANIFEST).parquet(manifest) if not lists.isEmpty() else spark.createDataFrame([], MANIFEST)
    there = files_of(spark, path, "*.parquet")
    odd = known.exceptAll(there).unionByName(there.exceptAll(known))  # lacking, of another length, or left by a broken run
    broken = _keys(odd, by).select(*by).distinct()
    done = _keys(known, by).select(*by).distinct().join(broken, by, "left_anti")
    missing = [tuple(r) for r in wanted.join(done, by, "left_anti").collect()]  # a row a folder
    total = wanted.count()
    if missing:
        schema = ", ".join(f"`{c}` string" for c in by)
        todo = F.broadcast(spark.createDataFrame(missing, schema).withColumnsRenamed({c: f"_{c}" for c in by}))
        match = [F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) == F.col(f"_{c}") for c in by]
        part = rows.join(todo, match, "left_semi")
        part.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        kept = [tuple(r) for r in files_of(spark, path, "*.parquet").collect()]  # a row a file
        spark.createDataFrame(kept, MANIFEST).coalesce(1).write.mode("overwrite").parquet(manifest)
    return {"written": len(missing), "skipped": total - len(missing)}


def scan_files(wanted: DataFrame, key: str, folder: str, pattern: str, name: str, decode: Callable[[bytes], Iterator[dict]], schema: str) -> tuple[DataFrame, Observation]:
    """The rows that decode makes of the content of each file that `wanted` names, and an observation of counts.

    name: an expression over `file` that gives the key in its path. A key without a file, or with an empty one, which
    Spark does not list, is missing, one whose content
    decode refuses by an exception has failed: both are left out and counted. After any one action on the whole result
    the observation has n_wanted, n_missing, n_failed and n_read, files each, and n_rows. The result has the key and the
    columns of `schema`.
    """
    spark = wanted.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("file"), "content").withColumn("_key", F.expr(name))
    met = wanted.select(F.col(key)).distinct().join(files, F.col(key).cast("string") == F.col("_key"), "left").select(key, "content")
    fields = spark.createDataFrame([], schema).schema.fields
    whole = T.StructType([wanted.schema[key], T.StructField("state", T.StringType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                state = "missing" if content is None else "read"
                if content is not None:
                    try:
                        rows = list(decode(content))
                    except Exception:
                        state = "failed"
                rows = [{key: k, "state": state}] + [{key: k, "state": None, **r} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, b_schema)

    b_schema = to_arrow_schema(whole)
    counts = Observation("files")
    state = lambda s: F.count_if(F.col("state") == s)
    told = met.mapInArrow(run, whole).observe(counts, F.count("state").alias("n_wanted"), state("missing").alias("n_missing"), state("failed").alias("n_failed"), state("read").alias("n_read"), F.count_if(F.col("state").isNull()).alias("n_rows"))
    return told.where("state is null").drop("state"), counts
