"""Exact places of all rows in one order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import keep, partitions


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in this order, from 0, in a new column `name`, over a kept table.

    Rows are dealt out by ranges of the order, sorted within them and written, each with its number in its range; sums
    over a row a range give the rest, so rows move once. Rows that agree in all of `order` come in any order.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = keep(dealt.withColumn(name, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(name, 33)  # the id holds the range above bit 33 and the row's number in it below
    per = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_part", before.alias("_before"))
    placed = dealt.join(F.broadcast(per), part == F.col("_part"))
    return placed.select(*rows.columns, (F.col("_before") + F.col(name) - F.shiftleft(part, 33)).alias(name))
