"""Lineage cuts that survive the loss of an executor: Parquet tables in the shared checkpoint folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from the files, not from df's lineage."""
    path = f"{shared_folder(df.sparkSession)}/cellweave/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cellweave_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by keep() that no later job reads."""
    for df in frames:
        path = getattr(df, "_cellweave_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of queries that nothing refers to any more, as between large steps."""
    gc.collect()
    spark._jvm.System.gc()
