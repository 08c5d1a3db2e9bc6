"""Merkle fixity audit of WARC replicas: digests of records and of ordered offset ranges, compared from the root down.

Records are hashed; the records of an offset range of a file, the ranges of a file, `fanout` neighbouring volumes of a
file, `fanout` neighbouring files, and so on to the root, are hashed over their parts' places and digests in order. Both
trees get the height of their joint range of files and volumes, so that they meet at one root. They are compared there
and then only below the nodes that differ, until the records that differ are found.

A record's place is given when a replica is written, by page_id and, for rows of one page_id, by what they hold then;
copies of it keep the place whatever becomes of their bytes. A file with more than PER_FILE records is cut into volumes,
also where one page_id (or none) holds them all, so that no file, range or task takes an unbounded group.

Defined results: null fields are empty in a record; null page_ids belong to file -1; repeated rows are records of their
own, one after the other; a record that only one replica holds differs; two empty replicas agree; a text of any length
is one record, hashed as a whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import drop, keep

#: Records of a WARC file's volume, about; bytes of an offset range; volumes or files (or nodes) of a node above.
PER_FILE, RANGE_BYTES, FANOUT = 1024, 1 << 18, 16
PLACE, NODE = ("file", "volume", "offset"), ("file", "volume", "at")


def record(url: Column, payload: Column) -> Column:
    """A response record: version, type, target, length, an empty line, the payload and two line ends."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, copy: Column | None = None, per_file: int = PER_FILE) -> DataFrame:
    """(page_id, file, volume, offset, length, digest, copy_digest): pages (page_id, url, html) written as records.

    copy: the payload that a replica has in the place of html (as many bytes), html itself if none is given. Equal rows
    are counted before they are laid out; runs of per_file of them go to neighbouring volumes.
    """
    own = record(F.col("url"), F.col("html"))
    rows = pages.select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file"),
        F.octet_length(own).cast("long").alias("length"),
        F.sha2(own, 256).alias("digest"),
        (F.sha2(own, 256) if copy is None else F.sha2(record(F.col("url"), copy), 256)).alias("copy_digest"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    volumes = rows.groupBy("file").agg(F.ceil(F.sum("n") / per_file).alias("volumes"))
    runs = rows.join(volumes, "file").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / per_file))))
    runs = runs.withColumn("n", F.least(F.lit(per_file), F.col("n") - F.col("run") * per_file))
    runs = runs.withColumn("volume", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") + F.col("run")) % F.col("volumes"))
    before = W.partitionBy("file", "volume").orderBy(F.col("page_id").asc_nulls_first(), "digest", "copy_digest", "run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0)))
    runs = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return runs.select("page_id", "file", "volume", (F.col("start") + F.col("k") * F.col("length")).alias("offset"), "length", "digest", "copy_digest")


def _above(children: DataFrame, place: tuple[Column, Column, Column]) -> DataFrame:
    """Nodes (file, volume, at, digest) at the places over children (file, volume, at, digest), hashed in order of place."""
    parts = F.array_sort(F.collect_list(F.struct("file", "volume", "at", "digest")))
    text = F.transform(parts, lambda p: F.concat_ws(":", p["file"].cast("string"), p["volume"].cast("string"), p["at"].cast("string"), p["digest"]))
    return children.groupBy(*(c.alias(n) for c, n in zip(place, NODE, strict=True))).agg(F.sha2(F.concat_ws("\n", text), 256).alias("digest"))


def _height(n: int, fanout: int) -> int:
    """Levels that lead n neighbours to one."""
    out = 0
    while fanout**out < n:
        out += 1
    return out


def _parents(volumes: int, files: int, fanout: int, range_bytes: int) -> list[tuple[Column, Column, Column]]:
    """From the records up: the place of a node's parent, from the place of the node. The last one is the root."""
    file, volume, at, none = F.col("file"), F.col("volume"), F.col("at"), F.lit(0).cast("long")
    up = lambda c: F.floor(c / fanout).cast("long")
    return [(file, volume, F.floor(at / range_bytes).cast("long")), (file, volume, none), *[(file, up(volume), none)] * _height(volumes, fanout), *[(up(file), volume, none)] * _height(files, fanout)]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places whose digest differs or that only one side has, with both digests."""
    return a.join(b.withColumnRenamed("digest", "other_digest"), [*NODE], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other_digest")))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, volume, offset, digest, other_digest) of the records that differ between replicas a and b."""
    ends = a.select("file", "volume").unionByName(b.select("file", "volume")).agg(F.min("file").alias("lo"), F.max("file").alias("hi"), F.max("volume").alias("volume")).first()
    lo, hi, volumes = (ends.lo, ends.hi, ends.volume + 1) if ends.lo is not None else (0, 0, 1)
    parents = _parents(volumes, hi - lo + 1, fanout, range_bytes)
    sides = [r.select((F.col("file") - lo).alias("file"), "volume", F.col("offset").alias("at"), "digest") for r in (a, b)]
    levels = [[side] for side in sides]
    for parent in parents:
        for level in levels:
            level.append(keep(_above(level[-1], parent), "level"))
    bad = keep(_differing(levels[0][-1], levels[1][-1]).select(*NODE), "branches")
    for depth in range(len(parents) - 1, -1, -1):
        up = bad.select(*(F.col(n).alias(f"_{n}") for n in NODE))
        under = [level[depth].join(up, reduce(Column.__and__, [c == F.col(f"_{n}") for c, n in zip(parents[depth], NODE, strict=True)]), "left_semi") for level in levels]
        found = _differing(*under)
        if depth:
            lower = keep(found.select(*NODE), "branches")
            drop(bad)
            bad = lower
    drop(*levels[0][1:], *levels[1][1:])  # what is read later is the records and the last branches
    return found.select((F.col("file") + lo).alias("file"), "volume", F.col("at").alias("offset"), "digest", "other_digest")


def rotten() -> Column:
    """html with bit rot: of about one page in 97 the first character, where it is "<", is another one of the same size."""
    hit = (F.coalesce(F.col("page_id"), F.lit(0)) * 7919 % 97 == 5) & (F.substring("html", 1, 1) == "<")
    return F.when(hit, F.concat(F.lit("?"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))


def op3_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record of the pages table with its place and digest, and whether the audit finds it differs in a replica."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = keep(warc_records(pages, rotten()), "replicas")
    found = audit(rows, rows.withColumn("digest", F.col("copy_digest"))).select(*PLACE, "other_digest", F.lit(True).alias("corrupted"))
    rows = rows.join(found, [*PLACE], "left")
    return rows.select("page_id", *PLACE, "length", "digest", F.coalesce("other_digest", "digest").alias("replica_digest"), F.coalesce("corrupted", F.lit(False)).alias("corrupted"))


_RECORD = r"E'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || coalesce(url, '') || E'\r\nContent-Length: ' || strlen({0}) || E'\r\n\r\n' || {0} || E'\r\n\r\n'"
SQL = {
    "op3_warc_fixity": f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, CASE WHEN coalesce(page_id, 0) * 7919 % 97 = 5 AND html[1] = '<' THEN '?' || html[2:] ELSE coalesce(html, '') END AS c FROM pages),
w AS (SELECT page_id, CAST(coalesce(floor(page_id / 1024e0), -1) AS BIGINT) AS file, CAST(strlen({_RECORD.format("h")}) AS BIGINT) AS length, sha256({_RECORD.format("h")}) AS digest, sha256({_RECORD.format("c")}) AS copy FROM p),
v AS (SELECT *, (row_number() OVER (PARTITION BY page_id, file, length, digest, copy) - 1) // 1024 AS run, CAST(ceil(count(*) OVER (PARTITION BY file) / 1024e0) AS BIGINT) AS volumes FROM w),
x AS (SELECT *, (CAST('0x' || substr(digest, 1, 8) AS BIGINT) + run) % volumes AS volume FROM v)
SELECT page_id, file, volume, CAST(coalesce(sum(length) OVER (PARTITION BY file, volume ORDER BY page_id NULLS FIRST, digest, copy, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, digest, copy AS replica_digest, digest <> copy AS corrupted FROM x"""
}
