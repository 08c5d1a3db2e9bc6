"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

Vectors that agree in label and components form one node with a count. Every node starts with the best neighbours of
its cell in some random-hyperplane partitions of its label. Rounds then join, at every node, all nodes that name it or
that it names, and keep each node's K best. A node whose whole list reaches the threshold is saturated, and links beyond
its K best may be cut. Its list then grows twofold a round, up to LONGER times. A group compares its saturated nodes for links between the parts that their lists leave
apart, links that join parts of the graph outlive the cut, and saturated nodes meet again in partitions of their own
until no turn joins more. Links are counted within the components that they span, by blocks: most pairs of blocks by the
angles between them, the rest vector by vector. An audit compares a
bounded number of nodes, chosen by hash, with all vectors; while it finds less than the wanted share of their links,
further rounds follow, then a warning, and an error where it finds less than LEAST_RECALL.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, have a null label, or differ
in length link with nothing; equal vectors of one label link with each other; null vec_ids take part, their own id
never names a component; an empty table gives an empty table; other columns are ignored, whatever their names;
ties of similarity go to the lesser node.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components
from .scratch import drop, keep, partitions, release
from .words import groups

#: Least cosine; length of neighbour lists; hyperplane partitions at the start; cells of about that many nodes; nodes
#: compared at once; rounds at least and at most; audited nodes; the share of their links that must be found.
THRESHOLD, K, TABLES, CELL, BLOCK, ROUNDS, MOST_ROUNDS, AUDIT, RECALL = 0.98, 12, 8, 64, 256, 2, 8, 256, 0.999
#: How many times as long the lists of saturated nodes get; the recall under which the result is refused.
LONGER, LEAST_RECALL = 4, 0.9


def _is_usable():
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False))


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision, of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs_within(x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other, cosine) of each row's k best others."""
    n = len(x)
    for lo in range(0, n, BLOCK):
        sims = x[lo : lo + BLOCK] @ x.T
        at = np.arange(len(sims))
        sims[at, lo + at] = -2
        top = np.argpartition(-sims, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
        yield np.repeat(lo + at, top.shape[1]), top.ravel(), np.take_along_axis(sims, top, 1).ravel()


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the pairs a, b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _links_between(x: np.ndarray, at: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, cosine): for any two parts that the lists of k leave apart but a pair links, one such pair.

    The list of a row that isn't saturated holds all its links, so that both ends are saturated.
    """
    hit = sim >= threshold
    full = np.flatnonzero(np.bincount(at[hit], minlength=len(x)) >= k)
    part = _joined(len(x), at[hit], other[hit])[full] if len(full) else full
    a, b, s = [at[:0]], [at[:0]], [sim[:0]]
    if len(np.unique(part)) > 1:
        for lo in range(0, len(full), BLOCK):
            sims = x[full[lo : lo + BLOCK]] @ x[full].T
            i, j = np.nonzero((sims >= threshold) & (part[lo : lo + BLOCK, None] < part[None, :]))
            _, first = np.unique(np.stack((part[lo + i], part[j])), axis=1, return_index=True)
            a.append(full[lo + i[first]])
            b.append(full[j[first]])
            s.append(sims[i[first], j[first]])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


def _edges(a: list[np.ndarray], b: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    empty = [np.zeros(0, np.int64)]
    cols = [np.concatenate(a or empty), np.concatenate(b or empty), np.concatenate(s or [np.zeros(0)])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "sim"])


def _best_in_groups(rows: DataFrame, key: str, k: int, threshold: float) -> DataFrame:
    """(a, b, sim): for rows (key, node, v), each node's k best in its groups, and links between parts of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s, size = [], [], [], 0
        for table in groups(batches, key):
            node = np.asarray(table.column("node"))
            _, first = np.unique(node, return_index=True)
            if len(first) < 2:
                continue
            node, x = node[first], _matrix(table.column("v").take(pa.array(first)))
            pairs = list(_pairs_within(x, k))
            for at, other, sim in [*pairs, _links_between(x, *map(np.concatenate, zip(*pairs, strict=True)), k, threshold)]:
                a.append(node[at])
                b.append(node[other])
                s.append(sim)
                size += len(at)
            if size > 200_000:
                yield _edges(a, b, s)
                a, b, s, size = [], [], [], 0
        yield _edges(a, b, s)

    return rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key).select(key, "node", "v").mapInArrow(run, "a long, b long, sim double")


def _start(nodes: DataFrame, n_by_label: DataFrame, tables: int, seed: int, k: int, threshold: float) -> DataFrame:
    """Best neighbours inside the cells of random-hyperplane partitions; a label's cells hold about CELL nodes each,
    a cell that holds more is split by hash, another way in each partition."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            dim = np.diff(np.asarray(b.column(1).offsets))
            out = np.zeros((b.num_rows, tables), np.int64)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = _matrix(b.column(1).take(pa.array(at)))
                p = planes.setdefault(d, np.random.default_rng([seed, d]).standard_normal((d, tables * 32)))
                bits = (x @ p > 0).reshape(len(at), tables, 32)
                out[at] = (bits * (1 << np.arange(32))).sum(2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out.tolist(), pa.list_(pa.int64()))], ["node", "v", "label", "codes"])

    rows = nodes.select("node", "v", "label").mapInArrow(codes, "node long, v array<double>, label string, codes array<long>")
    rows = rows.join(F.broadcast(n_by_label) if n_by_label.count() < 10_000 else n_by_label, "label").select("node", "v", "label", "n", F.size("v").alias("dim"), F.posexplode("codes").alias("table", "code"))
    mask = F.pow(F.lit(2.0), F.least(F.lit(31), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL))))).cast("long") - 1
    rows = rows.withColumn("cell", F.xxhash64("label", "dim", "table", F.col("code").bitwiseAND(mask)))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("in_cell"))
    rows = rows.join(sizes, "cell").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("node", "table", F.lit(seed)), F.ceil(F.col("in_cell") / (4 * CELL)))))
    return _best_in_groups(rows, "cell", k, threshold)


def _top(edges: DataFrame, k: int, threshold: float, longer: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each node's k best distinct neighbours, of saturated nodes (k of them reach the threshold) `longer` times as many; and
    links that join what these leave apart; its components; all as kept tables, the last one only to be dropped.

    Every link of edges has both its ends in one component, be it cut or not.
    """
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))
    edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    ranked = edges.withColumn("_r", rank).where(F.col("_r") <= k * longer)
    # Ranks go by similarity: a node whose k-th neighbour reaches the threshold keeps those beyond it that do, too.
    best = ranked.where((F.col("_r") <= k) | (F.col("sim") >= threshold)).select("a", "b", "sim", F.lit(False).alias("any"))
    both = keep(best.unionByName(edges.where(F.col("sim") >= threshold).withColumn("any", F.lit(True))), "graph")
    graph, links = both.where("not any").drop("any"), both.where("any").drop("any")
    labels = keep(components(graph.where(F.col("sim") >= threshold)), "labels")
    if links.groupBy("a").count().where(F.col("count") > k).isEmpty():
        return graph, labels, both
    part = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
    apart = links.join(part("a"), "a", "left").join(part("b"), "b", "left").withColumn("x", F.coalesce("part_a", "a")).withColumn("y", F.coalesce("part_b", "b")).where("x <> y")
    joins = keep(apart.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("a", "b", "sim")).alias("m")).select("m.*"), "joins")
    if joins.isEmpty():
        drop(joins)
        return graph, labels, both
    drop(labels)
    graph = keep(graph.unionByName(joins), "graph")
    drop(both, joins)
    return graph, keep(components(graph.where(F.col("sim") >= threshold)), "labels"), graph


def _local_join(graph: DataFrame, nodes: DataFrame, k: int, turn: int, threshold: float) -> DataFrame:
    """At every node, the nodes that it names or that name it, and itself, are compared with each other.

    A node that very many name is split at random, another way each round, with its own list in every part.
    """
    named = graph.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(graph.select(F.col("b").alias("at"), F.col("a").alias("node")))
    named = named.distinct()
    counts = named.groupBy("at").agg(F.ceil(F.count("*") / (4 * CELL)).alias("parts"))
    named = named.join(counts, "at").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")))
    own = counts.select("at", F.col("at").alias("node"), "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = named.select("at", "node", "parts", "part").unionByName(own).withColumn("group", F.xxhash64("at", "part"))
    return _best_in_groups(rows.join(nodes.select("node", "v"), "node"), "group", k, threshold)


def _codes(rows: DataFrame) -> DataFrame:
    """rows (component, node, v, count, n) with code, the sides of 16 random planes on which a vector lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, dim = np.zeros(b.num_rows, np.int64), np.diff(np.asarray(b.column("v").offsets))
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                planes = np.random.default_rng([7, d]).standard_normal((d, 16))
                code[at] = (_matrix(b.column("v").take(pa.array(at))) @ planes > 0) @ (1 << np.arange(16))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], [*b.schema.names, "code"])

    return rows.mapInArrow(run, "component long, node long, v array<double>, count long, n long, code long")


def _cones(blocked: DataFrame) -> DataFrame:
    """(component, block, total, radius, centre): a block's rows, counted, lie within that angle of its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "block"):
            x = _matrix(table.column("v"))
            middle = x.mean(0)
            middle = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-9 else x[0]
            radius = float(np.arccos(np.clip((x @ middle).min(), -1, 1)))
            keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("component", "block")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([int(np.asarray(table.column("count")).sum())]), pa.array([radius]), pa.array([middle.tolist()])], ["component", "block", "total", "radius", "centre"])

    rows = blocked.repartition(partitions(blocked.sparkSession), "block").sortWithinPartitions("block").select("component", "block", "v", "count")
    return rows.mapInArrow(run, "component long, block long, total long, radius double, centre array<double>")


def _judged(cones: DataFrame, threshold: float) -> DataFrame:
    """(a, b, total_a, total_b, all): pairs of blocks of a component, a <= b, whose vectors all link, or of which only a
    comparison can tell; those of which none can link are left out. Blocks of a component meet in groups of 64 by all."""
    salts = cones.groupBy("component").agg(F.ceil(F.count("*") / 64).alias("salts"))
    rows = cones.join(salts, "component")
    left = rows.select("component", F.pmod("block", F.col("salts")).alias("salt"), *[F.col(c).alias(f"{c}_a") for c in ("block", "total", "radius", "centre")])
    right = rows.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("block", "total", "radius", "centre")])
    names = ["block_a", "block_b", "total_a", "total_b", "radius_a", "radius_b", "centre_a", "centre_b"]
    margin, limit = 1e-6, float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.asarray(b.column(k).flatten(), float).reshape(b.num_rows, -1) for k in (6, 7))
            angle = np.arccos(np.clip((x * y).sum(1), -1, 1))
            reach = np.asarray(b.column(4)) + np.asarray(b.column(5))
            surely, open_ = angle + reach <= limit - margin, angle - reach < limit + margin
            kept = pa.array(open_)
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in [*b.columns[:4], pa.array(surely)]], ["a", "b", "total_a", "total_b", "all"])

    met = left.join(right, ["component", "salt"]).where("block_a <= block_b").select(*names)
    return met.mapInArrow(run, "a long, b long, total_a long, total_b long, all boolean")


def _compared(both: DataFrame, threshold: float) -> DataFrame:
    """(node, n): the vectors of the other side of a group (group, node, v, count, left, same) that reach the threshold, for
    each node of the left side; with same, of the other nodes of the left side."""
    both = both.repartition(partitions(both.sparkSession), "group").sortWithinPartitions("group").select("group", "node", "v", "count", "left", "same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n, size = [], [], 0
        for table in groups(batches, "group"):
            node, count, left, same = (np.asarray(table.column(c)) for c in ("node", "count", "left", "same"))
            x = _matrix(table.column("v"))
            own = np.flatnonzero(left)
            other = own if same[0] else np.flatnonzero(~left)
            if not len(own) or not len(other):
                continue
            hit = (x[own] @ x[other].T >= threshold).astype(np.int64)
            if same[0]:
                np.fill_diagonal(hit, 0)
                a.append(node[own])
                n.append(hit @ count[other])
            else:
                a += [node[own], node[other]]
                n += [hit @ count[other], count[own] @ hit]
            size += len(table)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(n))], ["node", "n"])
                a, n, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, np.zeros(0, np.int64)])), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]))], ["node", "n"])

    return both.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _links_in_components(nodes: DataFrame, labels: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, n): for each node of a component the vectors of other nodes of it that reach the threshold.

    A component of at most `block` nodes is compared in one group. A larger one is cut into blocks of vectors on the same
    sides of some planes; a block has a centre and an angle that holds it, so that most pairs of blocks are decided by
    three angles: all of them link, which is counted without a look at vectors, or none does. Only what is left is compared,
    a group for each pair of blocks, which returns counts. A group of near copies, however large, costs its pairs of
    blocks, and vectors move once.
    """
    rows = nodes.join(labels, "node").select("component", "node", "v", "count")
    rows = keep(rows.join(rows.groupBy("component").agg(F.count("*").alias("n")), "component"), "members")
    small = rows.where(F.col("n") <= block).select(F.col("component").alias("group"), "node", "v", "count", F.lit(True).alias("left"), F.lit(True).alias("same"))
    large = rows.where(F.col("n") > block)
    if large.isEmpty():
        return _compared(small, threshold)
    bits = F.least(F.lit(16), F.floor(F.log2(F.col("n") / block))).cast("int")
    celled = _codes(large.select("component", "node", "v", "count", "n")).withColumn("cell", F.col("code") % F.pow(F.lit(2.0), bits).cast("long"))
    parts = celled.groupBy("component", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    blocked = celled.join(parts, ["component", "cell"]).withColumn("block", F.xxhash64("component", "cell", F.pmod(F.xxhash64("node"), F.col("parts"))))
    blocked = keep(blocked.select("component", "node", "v", "count", "block"), "blocked")
    judged = keep(_judged(keep(_cones(blocked), "cones"), threshold), "judged")
    sure = judged.where("all")
    given = sure.select(F.col("a").alias("block"), F.col("total_b").alias("more"), (F.col("a") == F.col("b")).cast("long").alias("own"))
    given = given.unionByName(sure.where("a <> b").select(F.col("b").alias("block"), F.col("total_a").alias("more"), F.lit(0).cast("long").alias("own")))
    given = given.groupBy("block").agg(F.sum("more").alias("more"), F.sum("own").alias("own"))
    open_ = judged.where("not all").select("a", "b", (F.col("a") == F.col("b")).alias("same"), F.xxhash64("a", "b").alias("group"))
    side = lambda end, left, pairs: pairs.join(blocked.select(F.col("block").alias(end), "node", "v", "count"), end).select("group", "node", "v", "count", F.lit(left).alias("left"), "same")
    compared = _compared(small.unionByName(side("a", True, open_)).unionByName(side("b", False, open_.where("not same"))), threshold)
    counted = blocked.select("node", "count", "block").join(given, "block").select("node", (F.col("more") - F.col("own") * F.col("count")).alias("n"))
    return compared.unionByName(counted).groupBy("node").agg(F.sum("n").alias("n"))


def _audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """The share of the links of AUDIT nodes, compared with all nodes, that were found; half of them are nodes with links, half
    any. 1 where there are none."""
    spark = nodes.sparkSession
    order = [F.xxhash64("node", F.lit("audit")), F.col("node")]
    linked = nodes.join(found.where("n > 0").select("node"), "node", "left_semi").orderBy(*order).limit(AUDIT // 2).collect()
    chosen = list({r.node: r for r in linked + nodes.orderBy(*order).limit(AUDIT // 2).collect()}.values())
    if not chosen:
        return 1.0
    by_kind: dict[tuple[str, int], list] = {}
    for r in chosen:
        by_kind.setdefault((r.label, len(r.v)), []).append((r.node, np.array(r.v) / np.linalg.norm(r.v)))
    shared = spark.sparkContext.broadcast(by_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            label, dim, node, count = np.asarray(b.column(0)), np.diff(np.asarray(b.column(2).offsets)), np.asarray(b.column(1)), np.asarray(b.column(3))
            for (own, d), queries in shared.value.items():
                at = np.flatnonzero((label == own) & (dim == d))
                if len(at):
                    hit = np.array([v for _, v in queries]) @ _matrix(b.column(2).take(pa.array(at))).T >= threshold
                    hit &= np.array([q for q, _ in queries])[:, None] != node[at][None, :]
                    for (q, _), n in zip(queries, (hit @ count[at]).tolist(), strict=True):
                        total[q] = total.get(q, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "n"])

    true = nodes.select("label", "node", "v", "count").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    row = true.join(found, "node", "left").agg(F.sum("true").alias("t"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("true"))).alias("f")).first()
    return 1.0 if not row.t else row.f / row.t


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    good = rows.where(_is_usable()).withColumn("node", F.xxhash64("label", "embedding"))
    nodes = keep(good.groupBy("node").agg(F.first("embedding").alias("v"), F.first("label").alias("label"), F.count("*").alias("count"), F.min("vec_id").alias("least")), "nodes")
    n_by_label = nodes.groupBy("label").agg(F.count("*").alias("n"))
    graph, labels, made = _top(_start(nodes, n_by_label, TABLES, 0, k, threshold), k, threshold)
    extent, turn = None, 0
    while True:
        turn += 1
        more = _local_join(graph, nodes, k, turn, threshold)
        full = keep(nodes.join(graph.where(F.col("sim") >= threshold).groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("node")), "node", "left_semi"), "full")
        saturated = not full.isEmpty()
        if saturated:
            more = more.unionByName(_start(full, full.groupBy("label").agg(F.count("*").alias("n")), TABLES, MOST_ROUNDS + turn, k, threshold))
        if turn > ROUNDS and seen < recall:  # the audit found too little: new partitions as well
            more = more.unionByName(_start(nodes, n_by_label, TABLES, turn, k, threshold))
        before = made, labels
        graph, labels, made = _top(graph.unionByName(more), k, threshold, min(LONGER, 2**turn) if saturated else 1)
        drop(*before, full)
        release(spark)
        row = labels.agg(F.count("*"), F.count_distinct("component")).first()
        settled, extent = not saturated or (row[0], row[1]) == extent, (row[0], row[1])
        if turn < ROUNDS:
            continue
        found = keep(_links_in_components(nodes, labels, threshold), "links")
        seen = _audit(nodes, found, threshold)
        if settled and (seen >= recall or turn >= MOST_ROUNDS):
            break
        drop(found)
    if seen < LEAST_RECALL:
        raise RuntimeError(f"the audit found {seen:.6f} of the links after {turn} rounds")
    if seen < recall:
        warnings.warn(f"the audit found {seen:.6f} of the links, fewer than {recall}, after {turn} rounds", stacklevel=2)
    drop(made)
    per = nodes.select("node", "count", "least").join(found, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = per.join(names, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "node").join(per, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where(~_is_usable())
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(float(seen)).alias("audit_recall"))


def op9_nn_descent(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept", "audit_recall")


SQL: dict[str, str] = {}
