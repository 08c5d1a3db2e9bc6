"""The curve's properties, shards against a plain sort, and what readers can skip."""

import collections
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from cellweave.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(spark, dims, bits):
    points = list(itertools.product(range(1 << bits), repeat=dims))
    rows = spark.createDataFrame(points, ", ".join(f"x{j} int" for j in range(dims)))
    at = {r.h: r[:dims] for r in rows.withColumn("h", sharding.curve_index([F.col(f"x{j}") for j in range(dims)], bits)).collect()}
    assert sorted(at) == list(range(len(points)))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(len(points) - 1))


def cell(values, v, cells=16):
    """By the number of rows with lesser values; nulls are least, and in the first cell."""
    return 0 if v is None else cells * sum(x is None or x < v for x in values) // len(values)


def by_hand(rows, dims, ties, shards, together=()):
    """The row numbers of each shard in order, from a recursive walk through the curve's cube."""
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[tuple(r[t] for t in together) if together else k].append(r)
    least = {g: {d: min((r[d] for r in own if r[d] is not None), default=None) for d in dims} for g, own in groups.items()}
    rows = [{**r, **least[tuple(r[t] for t in together) if together else k]} for k, r in enumerate(rows)]
    ties = [*together, *ties]
    columns = [[r[d] for r in rows] for d in dims]
    own = [collections.Counter(c) for c in columns]
    least = [dict(zip(c, (cell(values, v) for v in c), strict=True)) for c, values in zip(own, columns, strict=True)]
    cubes = [tuple(least[j][r[d]] for j, d in enumerate(dims)) for r in rows]
    n = len(dims)
    place, following = sharding.curve_tables(n)

    def index(cube, state, bit):
        if bit < 0:
            return 0
        k = (state << n) + sum(((x >> bit) & 1) << j for j, x in enumerate(cube))
        return (place[k] << n * bit) + index(cube, following[k], bit - 1)

    order = sorted(range(len(rows)), key=lambda k: (index(cubes[k], 0, 3), *((rows[k][t] is None, rows[k][t]) for t in ties)))
    return [order[-(-s * len(rows) // shards) : -(-(s + 1) * len(rows) // shards)] for s in range(shards)]


def test_query_against_sort(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    rows = [{"doc_id": r.doc_id, "source": r.source, "lang": r.lang, "size": len((r.text or "").encode()) + 8, "crc": zlib.crc32((r.text or "").encode())} for r in docs]
    want = {rows[k]["doc_id"]: (rows[k]["size"], rows[k]["crc"], "rows", s, slot, None) for s, own in enumerate(by_hand(rows, ["source", "lang", "size"], ["doc_id"], 24, ("crc", "size"))) for slot, k in enumerate(own)}
    got = sharding.op13_hilbert_sharding(spark, medium).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == want and len(got) == len(docs)
    shards_of = collections.defaultdict(set)
    for r in got:
        shards_of[r.text_crc32, r.size].add(r.shard)
    split = [s for s in shards_of.values() if len(s) > 1]
    assert len(split) <= 23 and all(max(s) - min(s) == len(s) - 1 for s in split)  # copies are apart only where a cut falls among them


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "a", 2.0, 1), (1, "a", 2.0, 1), (2, None, float("nan"), 1), (3, "b" * 100_000, -1.0, 1), *((k, "hot", 0.5, 1) for k in range(20))]
    table = spark.createDataFrame(rows, "doc_id long, x string, y double, one int").selectExpr("*", "'k' shard", "2 c0", "3 v", "4 _at", "5 _curve")
    got = sharding.hilbert_shards(table, ["x", "y", "one"], shards=7, ties=("doc_id",))
    assert got.columns == [*(c for c in table.columns if c != "shard"), "curve", "shard", "slot"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.x or "", str(r.y)) for r in found) == sorted((str(r[0]), r[1] or "", str(r[2])) for r in rows)
    counts = collections.Counter(r.shard for r in found)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(counts[s])) for s in counts)
    assert sharding.hilbert_shards(table.limit(0), ["x", "y"]).count() == 0
    assert {r.shard for r in sharding.hilbert_shards(table.limit(2), ["x", "y"], shards=24).collect()} == {0, 12}
    with pytest.raises(ValueError, match="2 to 4"):
        sharding.hilbert_shards(table, ["x"])


def test_groups_stay_together(spark):
    """Copies with other sources, nulls in keys and in columns, a group of a third of all rows."""
    rows = [(k, f"text{k % 40}" if k % 3 else "hot", None if k % 7 == 0 else f"s{k % 11}", k % 5) for k in range(600)] + [(1000 + k, None, f"s{k}", None) for k in range(9)]
    table = spark.createDataFrame(rows, "id long, text string, source string, size int")
    got = sharding.hilbert_shards(table, ["source", "size"], shards=30, ties=("id",), together=("text",)).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    order = [r.text for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == len({r[1] for r in rows}) - 1


def test_readers_skip_shards_by_every_column(spark, tmp_path):
    rows = spark.range(6000).select("id", *[F.pmod(F.xxhash64("id", F.lit(d)), F.lit(1000)).alias(d) for d in "abc"])
    sharded = sharding.hilbert_shards(rows, ["a", "b", "c"], shards=64)
    sharding.write_shards(sharded, str(tmp_path / "shards"), shards=64)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 6000 and back.select("shard").distinct().count() == 64
    bounds = sharding.shard_bounds(back, ["a", "b", "c"]).collect()
    for d in "abc":  # a value of one column lies in half of the shards at most; sorted by a alone, all would hold any b
        assert all(sum(r[f"min_{d}"] <= v <= r[f"max_{d}"] for r in bounds) <= 64 / 2 for v in (50, 333, 600, 950))
        assert sum(r[f"min_{d}"] <= 400 <= r[f"max_{d}"] for r in bounds) > 0
