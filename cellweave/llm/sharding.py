"""Shards along a Hilbert curve through metadata columns, so that readers skip shards by any of them.

Each column is cut into 2^bits cells that hold near equal numbers of rows, from counts of all its values. The cells of a
row are its place in a cube; rows are sorted by the cube's Hilbert index and the order is cut into runs of equal numbers
of rows, a shard each. Neighbours on the curve are neighbours in every column, so a shard spans few values of each.

Defined results: nulls of a column are its least value; a column with one value adds nothing; equal values always share a
cell, so a frequent value fills several cells' share alone; rows that agree in all of `together` (copies of a text, where
these are its hash and size) take the place of the least of their values in each column and follow each other, so that a
group is in one shard or, where a cut falls into it, in neighbours; rows of one cell follow each other by `together`, then
`ties`, then in any order, which only rows equal in all of these can tell; repeated rows are rows of their own; fewer rows
than shards leave shards empty; an empty table gives an empty table; columns named
like results (curve, shard, slot) are replaced, all others kept; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import running
from .ranks import ranked
from .scratch import drop, keep

SHARDS, BITS, MOST_DIMS = 24, 4, 4


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For state * 2^dims + digit: the digit's place on the curve, and the state of the next finer level.

    A state is the corner where the curve enters a cell (an integer of dims bits) and the axis it leaves along.
    """
    n, mask = dims, (1 << dims) - 1
    gray = lambda w: w ^ (w >> 1)
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    inverse = {gray(w): w for w in range(1 << n)}
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731  set bits at the lower end
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    axis = lambda w: (ones(w - 1) if w % 2 == 0 else ones(w)) % n if w else 0
    place, following = [], []
    for state in range(n << n):
        e, d = state % (1 << n), state >> n
        for digit in range(1 << n):
            w = inverse[turn(digit ^ e, n - (d + 1) % n)]
            place.append(w)
            following.append((e ^ turn(entry(w), d + 1)) | ((d + axis(w) + 1) % n) << n)
    return place, following


def curve_index(cells: list[Column], bits: int) -> Column:
    """The Hilbert index of a cell of a cube of 2^bits cells a side."""
    n = len(cells)
    place, following = (F.array(*map(F.lit, t)) for t in curve_tables(n))
    index, state = F.lit(0).cast("long"), F.lit(0)
    for level in reversed(range(bits)):
        digit = sum((F.shiftleft(F.shiftright(c, level).bitwiseAND(1), j) for j, c in enumerate(cells)), F.lit(0))
        at = state * (1 << n) + digit
        index, state = index * (1 << n) + F.get(place, at), F.get(following, at)
    return index


def cell_edges(rows: DataFrame, column: str, cells: int) -> list[tuple[object, int]]:
    """(least value, cell) of each cell of a column that has one, in order: at most `cells` of them go to the driver."""
    counts = keep(rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")), "values")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = running(counts, [F.col("v").asc_nulls_first()], {"before": F.col("n")})
    cell = F.floor(F.col("before") * cells / F.lit(max(total, 1))).cast("int")
    edges = before.where("v is not null").groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").collect()
    drop(counts, before)
    return [(r.v, r.cell) for r in edges]


def cell_of(column: Column, edges: list[tuple[object, int]]) -> Column:
    """A value's cell: steps at the edges add up; null is in cell 0."""
    steps, last = F.lit(0), 0
    for value, cell in edges:
        steps, last = steps + F.when(column >= F.lit(value), cell - last).otherwise(0), cell
    return steps


def _least_of_groups(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with the least value of each of columns ({new: old}) among the rows that agree in keys. Groups are counted
    first; those of one row, most of them, are not joined."""
    least = rows.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.count("*").alias("n"), *[F.min(old).alias(f"m_{new}") for new, old in columns.items()]).where("n > 1")
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    met = rows.join(least, same, "left")
    # A group without any value of a column has no least one, nor have its rows.
    return met.select(*rows.columns, *[F.coalesce(F.col(f"m_{new}"), F.col(old)).alias(new) for new, old in columns.items()])


def hilbert_shards(rows: DataFrame, dims: list[str], shards: int = SHARDS, bits: int = BITS, ties: tuple[str, ...] = (), together: tuple[str, ...] = ()) -> DataFrame:
    """rows with curve (the Hilbert index), shard (0 to shards - 1) and slot (the place in the shard, from 0)."""
    if not 2 <= len(dims) <= MOST_DIMS:
        raise ValueError(f"a curve takes 2 to {MOST_DIMS} columns")
    names = [f"c{k}" for k in range(len(rows.columns))]
    own = dict(zip(rows.columns, names, strict=True))
    base = rows.toDF(*names)
    placed_by = {f"d{k}": own[d] for k, d in enumerate(dims)}
    base = keep(_least_of_groups(base, [own[t] for t in together], placed_by), "grouped") if together else base.withColumns({n: F.col(c) for n, c in placed_by.items()})
    cells = [cell_of(F.col(n), cell_edges(base, n, 1 << bits)) for n in placed_by]
    placed = base.withColumn("_curve", curve_index(cells, bits)).drop(*placed_by)
    order = [F.col("_curve").asc(), *[F.col(own[t]).asc_nulls_last() for t in (*together, *ties)]]
    total = base.count()
    at = ranked(placed, order, "_at").withColumn("_shard", F.expr(f"_at * {shards} div {max(total, 1)}").cast("int"))
    # The first row of shard k is the least that is not under k * total / shards, so that counts are one apart at most.
    slot = F.col("_at") - F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")
    kept = [F.col(n).alias(c) for c, n in own.items() if c not in ("curve", "shard", "slot")]
    return at.select(*kept, F.col("_curve").alias("curve"), F.col("_shard").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS, files: int = 1) -> None:
    """Parquet, a folder a shard of `files` files each, rows in order of the curve."""
    dealt = sharded.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)


def shard_bounds(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """What a reader prunes by: for each shard its rows and the least and largest value of each column."""
    ends = [f(d).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)


def op13_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents along a curve through source, language and size; copies of a text lie side by side, whatever their source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = keep(docs.select("doc_id", "source", "lang", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("text_hash")), "sized")
    sharded = hilbert_shards(narrow, ["source", "lang", "size"], ties=("doc_id",), together=("text_crc32", "size", "text_hash"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


SQL: dict[str, str] = {}
