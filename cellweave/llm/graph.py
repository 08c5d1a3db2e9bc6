"""Connected components of an edge table: forests of BATCH edges a task, then large-star and small-star steps where several
tasks were needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep

#: Edges that a task joins at once.
BATCH = 1 << 20


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n nodes that each of them reaches over the pairs a, b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars around the least node of what BATCH of them span."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int64)]) for k in range(2))
        nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = nodes[least_reached(len(nodes), ends[: len(u)], ends[len(u) :])]
        own = np.flatnonzero(root != nodes)
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["u", "v"])

    for b in batches:
        held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
        if sum(len(h[0]) for h in held) >= BATCH:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) with m, the least of u and its neighbours; and the kept table of the minima.

    Minima are combined before the shuffle; written, they are a side of their own, so that Spark can split a hot u.
    """
    least = keep(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return pairs.join(least, "u"), least


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _settled(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of every node to the least one of its component, a kept table.

    Tasks take BATCH edges each and return the stars of their components. Those of a single task are the result. Those of
    several are rewritten as stars around smaller nodes, written to the shared folder each round, until they no longer
    change.
    """
    sided = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "sided")
    tasks = -(-sided.count() // BATCH)
    dealt = sided.repartition(tasks, "u") if tasks > 1 else sided.coalesce(1)
    now = keep(dealt.mapInArrow(_stars, "u long, v long"), "edges")
    drop(sided)
    if tasks <= 1:
        return now
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, first = _with_least(both)
        large = large.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small, second = _with_least(large)
        new = keep(small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct(), "edges")
        drop(now, first, second)
        now, state = new, _state(new)
        if state == seen:
            return now
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that can be reached, for every node with an edge to another node.

    Null ends and loops are ignored; an empty table gives an empty table.
    """
    return _labels(_settled(edges, a, b))


def relabelled(labels: DataFrame | None, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels (node, component) after more edges, as a kept table: only what the labels leave apart is joined anew."""
    if labels is None:
        stars = _settled(edges, a, b)
        out = keep(_labels(stars), "labels")
        drop(stars)
        return out
    known = labels.select("node", F.col("component").alias("_c"))
    ends = edges.select(a, b)
    for end in (a, b):
        ends = ends.join(known.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    stars = _settled(ends, a, b)
    more = _labels(stars)
    moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = more.join(labels.select("node"), "node", "left_anti")
    out = keep(moved.unionByName(fresh.select("node", "component")), "labels")
    drop(labels, stars)
    return out
