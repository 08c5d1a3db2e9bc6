"""Numbers of rows in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number in this order, from 0. Rows are dealt out and sorted by ranges and checkpointed with their
    number in their range; the ranges' sizes, a row each, give the rest."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = dealt.groupBy(part.alias("_range")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = dealt.join(F.broadcast(sizes.select("_range", before.alias("_before"))), part == F.col("_range"))
    return met.select(*rows.columns, (F.col("_before") + F.col(name) - F.shiftleft(part, 33)).alias(name))
