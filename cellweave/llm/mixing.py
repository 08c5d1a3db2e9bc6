"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points u = frac(i * phi) run through the cumulative target shares and give each slot a source; a slot's
rank among its source's slots names the block of that source's shuffled stream which it takes. A stream is the source's
documents in a seeded hash order, laid end to end in words and repeated, cut into blocks of equal size.

Defined results: a null text has 0 words; a null source is a source, sorted last; sources that reach `cap` times their
size give the excess to the others by weight; documents without words are never taken; repeated rows are rows of their
own, each with its own place in the stream, also where no id tells them apart; an empty table gives an empty table; a
text of any length is counted whole; columns other than the named ones are ignored, mixed_documents keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import drop, keep, partitions

WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
#: Cells of the unit interval by which slots meet their source, slots ranked at once, documents of a bucket of a stream.
CELLS, CHUNK, BUCKET = 4096, 1 << 16, 4096


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of sums, its sum over the rows before in this order, as a kept table.

    Rows are dealt out by ranges of the order and written, so that no task holds them all; a row a range is summed first.
    """
    dealt = keep(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])  # a row for each partition
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    full = dealt.join(F.broadcast(per), "_part").select(*rows.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(n) for n, c in sums.items()])
    out = keep(full, "running")
    drop(dealt)
    return out


def targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """One row per source: source, s (its number from 0), source_size, target, as a kept table.

    Sorted by cap / weight, a source is capped when its share of what the capped ones before it leave is above its cap.
    """
    one = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    numbered = running(one, [F.col("source").asc_nulls_last()], {"s": F.lit(1).cast("long")})
    one = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    one = one.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    totals = one.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    by = [(F.col("most") / F.col("weight")).asc(), F.col("s").asc()]
    shares = running(one, by, {"before": F.col("most"), "gone": F.col("weight")})
    shares = shares.withColumn("each", (F.lit(totals["size"]) - F.col("before")) / (F.lit(totals["weight"]) - F.col("gone")))
    # From the first source in this order that isn't capped, no other is.
    level = shares.where(F.col("most") >= F.col("weight") * F.col("each")).agg(F.min_by("each", F.struct(F.col("most") / F.col("weight"), "s"))).first()[0]
    out = keep(shares.select("source", "s", "source_size", F.least("most", F.col("weight") * F.lit(float(level or 0.0))).alias("target")), "targets")
    drop(numbered, shares)
    return out


def streams(sized: DataFrame, per_source: DataFrame, seed: str) -> DataFrame:
    """A row for each document, with s, source_size, target and a: the words that stand before it in its source's stream.

    sized: (doc_id, source, size, n), one row for the n documents that agree in these; they follow each other. Prefix
    sums go over buckets of the hash order first, so that no task holds a whole source.
    """
    rows = sized.join(per_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    n, digits = sized.count(), 0
    while 16**digits * BUCKET < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("h", 1, digits)).withColumn("words", F.col("size") * F.col("n"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("words").alias("in_bucket"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("in_bucket")
    own = W.partitionBy("s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, ["s", "bucket"]).withColumn("a", F.col("before") + F.coalesce(F.sum("words").over(own), F.lit(0)))
    zero, last = F.lit(0).cast("long"), F.col("n") - 1
    rows = rows.withColumn("run", F.explode(F.sequence(zero, F.floor(last / BUCKET)))).withColumn("k", F.explode(F.sequence(F.col("run") * BUCKET, F.least(last, (F.col("run") + 1) * BUCKET - 1))))
    return rows.select("doc_id", "source", "size", "s", "source_size", "target", (F.col("a") + F.col("k") * F.col("size")).alias("a"))


def schedule(per_source: DataFrame, block: int) -> DataFrame:
    """(slot, s, rank): the golden-ratio schedule; each source gets as many slots as its target has blocks.

    A source's slots beyond its target are left out; the few that discrepancy leaves open close the schedule.
    """
    spark = per_source.sparkSession
    shares = per_source.withColumn("quota", F.ceil(F.floor("target") / block).cast("long")).select("s", "quota")
    shares = running(shares, [F.col("s").asc()], {"lo": F.col("quota")}).withColumn("hi", F.col("lo") + F.col("quota"))
    total = shares.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    edges = shares.where("quota > 0").select("s", "quota", (F.col("lo") / F.lit(float(max(total, 1)))).alias("lo"), (F.col("hi") / F.lit(float(max(total, 1)))).alias("hi"))
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(PHI), F.lit(1.0)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    slots = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "s", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = slots.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.join(counts.select("s", "chunk", "before"), ["s", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("s", "chunk").orderBy("slot")) - 1)
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    left = edges.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    left = left.select((F.lit(total) + F.col("s")).alias("slot"), "s", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    return ranked.where("rank < quota").select("slot", "s", "rank").unionByName(left)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, block: int = 512, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, mix). documents: a row per input row with doc_id, source, size, source_size, target, s, a.
    mix: a row per piece of a block that the mix takes: slot, s, a (names the document), first (its first word), n (words).
    """
    sized = keep(docs.select("doc_id", "source", n_words().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    per_source = targets(sized, weights, cap)
    rows = keep(streams(sized, per_source, seed), "streams")
    drop(sized)
    epochs = rows.where("size > 0 and target >= 1").withColumn("whole", F.floor("target"))
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / F.col("source_size")))))
    lo = F.col("epoch") * F.col("source_size") + F.col("a")
    epochs = epochs.select("s", "a", lo.alias("lo"), F.least(lo + F.col("size"), F.col("whole")).alias("hi")).where("hi > lo")
    pieces = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    first, last = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    pieces = pieces.select("s", "rank", "a", (first - F.col("lo")).alias("first"), (last - first).alias("n"))
    return rows, schedule(per_source, block).join(pieces, ["s", "rank"]).select("slot", "s", "a", "first", "n")


def taken(docs: DataFrame, **params) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs, summed over the pieces of the mix."""
    rows, mix = mix_sources(docs, **params)
    sums = mix.groupBy("s", "a").agg(F.sum("n").alias("taken"))
    full = rows.where("size > 0").join(sums, ["s", "a"], "left").unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, words: str = "mix_words", **params) -> DataFrame:
    """The documents of which the mix takes words, with all their columns, and how many (repeats counted) in a column
    named `words`, which takes the place of one of that name.

    What rows that agree in doc_id, source and size give differs in one such group of a source at most, where its target
    ends: its rows are numbered, in order of text, and take what the group's places in the stream give in turn.
    """
    marks = taken(docs.select("doc_id", "source", "text"), **params).groupBy("doc_id", "source", "size").agg(F.min("taken").alias("lo"), F.max("taken").alias("hi"), F.count("*").alias("n"), F.sum("taken").alias("sum"))
    # In a group whose rows differ, some take hi, then one takes part of the difference, the rest lo.
    whole = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("sum") - F.col("n") * F.col("lo")) / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.col("n"))
    marks = keep(marks.where("hi > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("lo").alias("_lo"), (F.col("hi") > F.col("lo")).alias("_differ"), whole.alias("_whole"), (F.col("sum") - F.col("n") * F.col("lo")).alias("_extra")), "marks")
    names = [f"c{k}" for k in range(len(docs.columns))]
    id_, source, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text"))
    rows = docs.toDF(*names).withColumn("_n", n_words(names[docs.columns.index("text")]))
    hit = rows.join(marks, id_.eqNullSafe(F.col("_id")) & source.eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")))
    same = hit.where("not _differ").select(*names, F.col("_lo").alias("_words"))
    rank = F.row_number().over(W.partitionBy("_id", "_source", "_size").orderBy(text)) - 1
    apart = hit.where("_differ").withColumn("_r", rank)
    more = F.when(F.col("_r") < F.col("_whole"), F.col("_size")).when(F.col("_r") == F.col("_whole"), F.col("_extra") - F.col("_whole") * F.col("_size")).otherwise(0)
    apart = apart.select(*names, (F.col("_lo") + more).alias("_words")).where("_words > 0")
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c != words]
    return same.unionByName(apart).select(*[F.col(n).alias(c) for n, c in kept], F.col("_words").alias(words))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The words a document gives are its share of the first `target` words of its source's repeated stream.
SQL = {
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source),
w AS (SELECT *, CAST(s % 3 + 1 AS DOUBLE) AS weight, 3e0 * source_size AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM p),
e AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each FROM w),
f AS (SELECT each AS level FROM e WHERE most >= weight * each ORDER BY most / weight, s LIMIT 1),
t AS (SELECT source, source_size, least(most, weight * level) AS target FROM e, f),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS whole,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE (whole // source_size) * size + greatest(0, least(size, whole % source_size - a)) END AS BIGINT) AS taken FROM a"""
}
