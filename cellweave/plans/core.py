"""Queries over the synthetic grid of the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rates
from ..grid import SIZE, SQL_CELLS, SQL_FUELS, burnable, cells, fuels
from ..operators import partition, rebalance, spread
from ..session import checkpointed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _rated(spark, sf_dir: str) -> DataFrame:
    """Cells with the full rate: it is computed once a fuel but for the slope, which enters linearly in its square."""
    rate = rates.full_rate(F.lit(5.0), F.col("slope").cast("double"), F.lit(0.05))
    return cells(spark, sf_dir).join(F.broadcast(fuels(spark)), "fuel", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))


_DENSITY = "(w1 + w10 + w100 + wherb) / delta"
_FULL = rates.SQL_RATE.format(density=_DENSITY, damp=rates.SQL_DAMP.format(m="0.05e0"), wind="5e0", slope="slope", moisture="0.05e0")
SQL_RATED = f"{SQL_CELLS}, {SQL_FUELS}, rated AS (SELECT cells.*, coalesce({_FULL}, 0e0) AS rate FROM cells LEFT JOIN fuels USING (fuel))"


@query("burnable_area", f"{SQL_RATED} SELECT scenario, fuel, count(*) AS n_cells, round(avg(ln(1 + rate)), 6) AS mean_log_rate FROM rated WHERE fuel BETWEEN 1 AND 13 GROUP BY ALL")
def burnable_area(spark, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).where(burnable(F.col("fuel"))).groupBy("scenario", "fuel").agg(F.count("*").alias("n_cells"), F.round(F.avg(F.log1p("rate")), 6).alias("mean_log_rate"))


@query("fuel_decode", f"{SQL_CELLS} SELECT scenario, r, c, CAST(CASE WHEN floor(q / 7e0 + 0.5e0) BETWEEN 1 AND 13 THEN floor(q / 7e0 + 0.5e0) ELSE 0 END AS INTEGER) AS fuel_id, q / 7e0 BETWEEN 1 AND 13 AS burns FROM cells")
def fuel_decode(spark, sf_dir: str) -> DataFrame:
    x = F.col("q") / 7
    return cells(spark, sf_dir).select("scenario", "r", "c", rates.decode_fuel(x).alias("fuel_id"), burnable(x).alias("burns"))


_WEATHER = [(0.0, 5.0, 0.05), (30.0, 5.0, 0.05), (0.0, 0.0, 0.05), (0.0, 5.0, 0.12)]


@query("spread_rate", f"WITH {SQL_FUELS}, w(slope, wind, m) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE) FROM (VALUES {', '.join(map(str, _WEATHER))}) v(a, b, c)) SELECT fuel, slope, wind, m AS moisture, round(ln(1 + {rates.SQL_RATE.format(density=_DENSITY, damp=rates.SQL_DAMP.format(m='m'), wind='wind', slope='slope', moisture='m')}), 6) AS log_rate FROM fuels, w")
def spread_rate(spark, sf_dir: str) -> DataFrame:
    weather = F.array(*[F.struct(F.lit(s).alias("slope"), F.lit(w).alias("wind"), F.lit(m).alias("moisture")) for s, w, m in _WEATHER])
    rows = fuels(spark).select("*", F.inline(weather))
    return rows.select("fuel", "slope", "wind", "moisture", F.round(F.log1p(rates.full_rate(F.col("wind"), F.col("slope"), F.col("moisture"))), 6).alias("log_rate"))


@query("spread_rate_reduced", f"WITH {SQL_FUELS} SELECT fuel, round({rates.SQL_RATE.format(density='w1 / delta', damp='1e0', wind='5e0', slope='0e0', moisture='0.05e0')}, 5) AS rate FROM fuels")
def spread_rate_reduced(spark, sf_dir: str) -> DataFrame:
    return fuels(spark).select("fuel", F.round(rates.reduced_rate(F.lit(5.0), F.lit(0.0)), 5).alias("rate"))


@query("directional_rate", f"{SQL_RATED}, b AS (SELECT CAST(45 * range AS DOUBLE) AS bearing FROM range(8)) SELECT scenario, r, c, bearing, round(ln(1 + greatest(0.01e0, rate * (1e0 + 0.5e0 * cos(radians(180e0 - bearing))) / 15e-1)), 6) AS source_form, round(ln(1 + greatest(0.001e0, rate * (0.5e0 + 0.5e0 * cos(radians(180e0 - bearing))))), 6) AS even_form FROM rated, b")
def directional_rate(spark, sf_dir: str) -> DataFrame:
    return _directional(_rated(spark, sf_dir))


@query("directional_rate_all", SQL["directional_rate"])
def directional_rate_all(spark, sf_dir: str) -> DataFrame:
    """directional_rate by its former name."""
    return directional_rate(spark, sf_dir)


def _directional(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k * 45).cast("double"))).alias("bearing"))
    form = lambda share, floor: F.round(F.log1p(rates.directional(F.col("rate"), F.col("bearing"), F.lit(180.0), share, floor)), 6)
    return rows.select("scenario", "r", "c", "bearing", form(0.5, 0.01).alias("source_form"), form(1.0, 0.001).alias("even_form"))


# Fuel codes of the 40-model system with their code of 13; all others are 99.
CROSSWALK = {
    91: 91, 92: 92, 93: 93, 98: 98, 99: 99, 101: 1, 102: 1, 103: 3, 104: 3,
    105: 3, 106: 3, 107: 3, 108: 3, 109: 3, 121: 1, 122: 2, 123: 2, 124: 2,
    141: 5, 142: 5, 143: 6, 144: 6, 145: 6, 146: 6, 147: 6, 148: 6, 149: 4,
    161: 8, 162: 8, 163: 8, 164: 10, 165: 10, 181: 8, 182: 8, 183: 8, 184: 9,
    185: 9, 186: 9, 187: 8, 188: 9, 189: 9, 201: 11, 202: 11, 203: 12, 204: 13,
}


@query("fbfm40_crosswalk", f"{SQL_CELLS}, x(a, b) AS (VALUES {', '.join(map(str, CROSSWALK.items()))}) SELECT coalesce(b, 99) AS fuel13, count(*) AS n, count(DISTINCT 90 + q % 120) AS codes FROM cells LEFT JOIN x ON a = 90 + q % 120 GROUP BY ALL")
def fbfm40_crosswalk(spark, sf_dir: str) -> DataFrame:
    table = F.create_map(*[F.lit(v) for pair in CROSSWALK.items() for v in pair])
    code = (90 + F.col("q") % 120).cast("int")
    return cells(spark, sf_dir).select(code.alias("code"), F.coalesce(F.try_element_at(table, code), F.lit(99)).alias("fuel13")).groupBy("fuel13").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))


# The octant from signs and sizes: k from 45 k degrees, which belong to it, to 45 (k + 1), which don't; -1 where flat.
_OCTANT = """CASE WHEN dx = 0 AND dy = 0 THEN -1 WHEN dx < 0 AND dy >= 0 AND dy < -dx THEN 0 WHEN dx < 0 AND dy > 0 THEN 1 WHEN dx >= 0 AND dy > 0 AND dx < dy THEN 2
  WHEN dx > 0 AND dy > 0 THEN 3 WHEN dx > 0 AND dy <= 0 AND -dy < dx THEN 4 WHEN dx > 0 AND dy < 0 THEN 5 WHEN dx <= 0 AND dy < 0 AND -dx < -dy THEN 6 ELSE 7 END"""


@query("slope_aspect", f"""{SQL_CELLS}, d AS (SELECT scenario, r, c,
  CASE WHEN c = 0 THEN lead(elevation) OVER x - elevation WHEN c = {SIZE - 1} THEN elevation - lag(elevation) OVER x ELSE (lead(elevation) OVER x - lag(elevation) OVER x) / 2e0 END / 3e1 AS dx,
  CASE WHEN r = 0 THEN lead(elevation) OVER y - elevation WHEN r = {SIZE - 1} THEN elevation - lag(elevation) OVER y ELSE (lead(elevation) OVER y - lag(elevation) OVER y) / 2e0 END / 3e1 AS dy
  FROM cells WINDOW x AS (PARTITION BY scenario, r ORDER BY c), y AS (PARTITION BY scenario, c ORDER BY r))
SELECT scenario, r, c, round(100 * sqrt(dx * dx + dy * dy), 5) AS slope_pct, CAST({_OCTANT} AS INTEGER) AS octant FROM d""")
def slope_aspect(spark, sf_dir: str) -> DataFrame:
    return _slopes(_gradients(spark, sf_dir), F.expr(_OCTANT).cast("int"))


def _gradients(spark, sf_dir: str) -> DataFrame:
    def gradient(at: str, along: W) -> F.Column:
        after, before, here = F.lead("elevation").over(along), F.lag("elevation").over(along), F.col("elevation")
        return F.when(F.col(at) == 0, (after - here).cast("double")).when(F.col(at) == SIZE - 1, (here - before).cast("double")).otherwise((after - before) / 2) / 30

    return cells(spark, sf_dir).withColumn("dx", gradient("c", W.partitionBy("scenario", "r").orderBy("c"))).withColumn("dy", gradient("r", W.partitionBy("scenario", "c").orderBy("r")))


def _slopes(rows: DataFrame, octant: F.Column) -> DataFrame:
    return rows.select("scenario", "r", "c", F.round(100 * F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), 5).alias("slope_pct"), octant.alias("octant"))


@query("slope_aspect_all", SQL["slope_aspect"])
def slope_aspect_all(spark, sf_dir: str) -> DataFrame:
    """slope_aspect by its former name."""
    return slope_aspect(spark, sf_dir)


@query("size_class", "SELECT CASE WHEN a < 0.25e0 THEN 'A' WHEN a < 10 THEN 'B' WHEN a < 100 THEN 'C' WHEN a < 300 THEN 'D' WHEN a < 1000 THEN 'E' WHEN a < 5000 THEN 'F' ELSE 'G' END AS size_class, count(*) AS n FROM (SELECT o_totalprice / 1e2 AS a FROM orders) GROUP BY ALL")
def size_class(spark, sf_dir: str) -> DataFrame:
    a = F.col("o_totalprice") / 100
    letter = F.when(a < 0.25, "A").when(a < 10, "B").when(a < 100, "C").when(a < 300, "D").when(a < 1000, "E").when(a < 5000, "F").otherwise("G")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(letter.alias("size_class")).agg(F.count("*").alias("n"))


# Features are orders: acres are their price, latest is their status, longitude and latitude come from their keys.
_REASON = "CASE WHEN o_orderstatus = 'P' THEN 'not latest' WHEN o_custkey % 50 = 0 THEN 'no centroid' WHEN NOT (24.5e0 + o_custkey % 300 / 1e1 BETWEEN 24.5e0 AND 49.5e0) THEN 'outside' WHEN o_totalprice / 1e2 < 300 THEN 'small' END"


def _features(spark, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lat = 24.5 + F.col("o_custkey") % 300 / 10
    reason = F.when(F.col("o_orderstatus") == "P", "not latest").when(F.col("o_custkey") % 50 == 0, "no centroid").when(~lat.between(24.5, 49.5), "outside").when(F.col("o_totalprice") / 100 < 300, "small")
    return orders.withColumn("reason", reason)


@query("filter_reasons", f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM orders GROUP BY ALL")
def filter_reasons(spark, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_SAMPLE = f"""WITH f AS (SELECT o_orderkey, o_totalprice / 1e2 >= 1000 AS large, (o_orderkey * 7919 + 42) % 1000003 AS h FROM orders WHERE ({_REASON}) IS NULL),
test AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS k FROM f WHERE large QUALIFY k <= 17),
train AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS k FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM test) QUALIFY k <= 51)"""


@query("scenario_sample", f"{_SAMPLE} SELECT format('S{{:03d}}', k) AS id, o_orderkey, 'train' AS split FROM train UNION ALL SELECT format('S{{:03d}}', k + 51), o_orderkey, 'test' FROM test")
def scenario_sample(spark, sf_dir: str) -> DataFrame:
    """Samples without replacement by a seeded hash; the lowest k come from a top-k, so no task ranks all rows."""
    pool = _features(spark, sf_dir).where("reason is null").select("o_orderkey", (F.col("o_totalprice") / 100 >= 1000).alias("large"), ((F.col("o_orderkey") * 7919 + 42) % 1000003).alias("h"))

    def lowest(rows: DataFrame, k: int) -> DataFrame:
        return rows.orderBy("h", "o_orderkey").limit(k).withColumn("k", F.row_number().over(W.orderBy("h", "o_orderkey")))

    test = lowest(pool.where("large"), 17)
    train = lowest(pool.join(test.select("o_orderkey"), "o_orderkey", "left_anti"), 51)
    name = lambda off: F.format_string("S%03d", F.col("k") + off).alias("id")
    return train.select(name(0), "o_orderkey", F.lit("train").alias("split")).unionByName(test.select(name(51), "o_orderkey", F.lit("test").alias("split")))


_LAYERS = ("q", "fuel", "slope", "elevation")
_SQL_LONG = SQL_CELLS + ", l AS (" + " UNION ALL ".join(f"SELECT scenario, '{x}' AS layer, CAST({x} AS DOUBLE) AS v FROM cells" for x in _LAYERS) + ")"
_SQL_PROFILE = "SELECT scenario, layer, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(100e0 * count(*) FILTER (WHERE v = 0) / count(*), 6) AS pct_zero, count(DISTINCT v) AS n_unique FROM l GROUP BY ALL"


def _long(spark, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).select("scenario", *[F.col(x).cast("double").alias(x) for x in _LAYERS])
    return rows.unpivot("scenario", list(_LAYERS), "layer", "v")


def _profile(long: DataFrame) -> DataFrame:
    # Values are counted first, so that the distinct count needs no second expansion of the rows.
    return long.groupBy("scenario", "layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(100 * F.count_if(F.col("v") == 0) / F.count("*"), 6).alias("pct_zero"), F.count_distinct("v").alias("n_unique"))


@query("layer_profile", f"{_SQL_LONG} {_SQL_PROFILE}")
def layer_profile(spark, sf_dir: str) -> DataFrame:
    return _profile(_long(spark, sf_dir))


@query("layer_rollup", f"{_SQL_LONG}, p AS ({_SQL_PROFILE}) SELECT layer, min(lo) AS lo, max(hi) AS hi, round(median(mean), 4) AS median_mean, round(median(std), 4) AS median_std, round(median(pct_zero), 2) AS median_pct_zero, CAST(median(n_unique) AS DOUBLE) AS median_n_unique, max(hi) <= 1.0001e0 AS normalized, median(n_unique) <= 1 OR median(std) < 1e-9 AS constant FROM p GROUP BY layer")
def layer_rollup(spark, sf_dir: str) -> DataFrame:
    p = _profile(_long(spark, sf_dir))
    return p.groupBy("layer").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.round(F.median("mean"), 4).alias("median_mean"),
        F.round(F.median("std"), 4).alias("median_std"),
        F.round(F.median("pct_zero"), 2).alias("median_pct_zero"),
        F.median("n_unique").alias("median_n_unique"),
        (F.max("hi") <= 1.0001).alias("normalized"),
        ((F.median("n_unique") <= 1) | (F.median("std") < 1e-9)).alias("constant"),
    )


_SQL_NORM = "n AS (SELECT layer, avg(v) AS mu, greatest(stddev_samp(v), 1e-6) AS sd FROM l GROUP BY layer)"


@query("channel_norm", f"{_SQL_LONG}, {_SQL_NORM} SELECT layer, round(mu, 6) AS mean, round(sd, 6) AS std FROM n")
def channel_norm(spark, sf_dir: str) -> DataFrame:
    return _norm(_long(spark, sf_dir)).select("layer", F.round("mu", 6).alias("mean"), F.round("sd", 6).alias("std"))


def _norm(long: DataFrame) -> DataFrame:
    return long.groupBy("layer").agg(F.avg("v").alias("mu"), F.greatest(F.stddev_samp("v"), F.lit(1e-6)).alias("sd"))


@query("zscore", f"{_SQL_LONG}, {_SQL_NORM} SELECT scenario, layer, round(min((v - mu) / sd), 5) AS lo, round(max((v - mu) / sd), 5) AS hi FROM l JOIN n USING (layer) GROUP BY ALL")
def zscore(spark, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    z = (F.col("v") - F.col("mu")) / F.col("sd")
    return long.join(_norm(long), "layer").groupBy("scenario", "layer").agg(F.round(F.min(z), 5).alias("lo"), F.round(F.max(z), 5).alias("hi"))


@query("layer_histogram", f"{_SQL_LONG}, b AS (SELECT layer, min(v) AS lo, max(v) AS hi FROM l GROUP BY layer) SELECT layer, CAST(least(49, floor(50 * (v - lo) / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM l JOIN b USING (layer) WHERE hi > lo GROUP BY ALL")
def layer_histogram(spark, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    bounds = long.groupBy("layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bin_ = F.least(F.lit(49), F.floor(50 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))).cast("int")
    return long.join(bounds, "layer").where("hi > lo").groupBy("layer", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("class_balance", f"{SQL_CELLS} SELECT scenario, count(*) FILTER (WHERE fuel BETWEEN 1 AND 13) AS pos, count(*) FILTER (WHERE NOT fuel BETWEEN 1 AND 13) AS neg, round(1e0 * count(*) FILTER (WHERE NOT fuel BETWEEN 1 AND 13) / greatest(count(*) FILTER (WHERE fuel BETWEEN 1 AND 13), 1), 8) AS pos_weight FROM cells GROUP BY ALL")
def class_balance(spark, sf_dir: str) -> DataFrame:
    b = burnable(F.col("fuel"))
    return cells(spark, sf_dir).groupBy("scenario").agg(F.count_if(b).alias("pos"), F.count_if(~b).alias("neg")).withColumn("pos_weight", F.round(F.col("neg") / F.greatest("pos", F.lit(1)), 8))


@query("prefix_sum", f"{SQL_CELLS}, x AS (SELECT scenario, r, c, sum(q) OVER (PARTITION BY scenario, r ORDER BY c) AS s FROM cells) SELECT scenario, r, c, CAST(sum(s) OVER (PARTITION BY scenario, c ORDER BY r) AS BIGINT) AS total FROM x")
def prefix_sum(spark, sf_dir: str) -> DataFrame:
    by_row = cells(spark, sf_dir).withColumn("s", F.sum("q").over(W.partitionBy("scenario", "r").orderBy("c")))
    return by_row.select("scenario", "r", "c", F.sum("s").over(W.partitionBy("scenario", "c").orderBy("r")).cast("long").alias("total"))


def _loads(spark, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("scenario", "r", "c", F.col("q").alias("load"))


_SQL_LOADS = f"{SQL_CELLS}, ld AS (SELECT scenario, r, c, q AS load FROM cells)"
_SQL_LEAVES = "SELECT scenario, CAST(dense_rank() OVER (PARTITION BY scenario ORDER BY path) - 1 AS INTEGER) AS leaf, r0, r1, c0, c1, CAST(sum(load) AS BIGINT) AS load FROM kd GROUP BY scenario, path, r0, r1, c0, c1"
for _n in (2, 3, 4, 8, 16, 32):

    @query(f"kd_leaves_{_n}", f"{_SQL_LOADS}, {partition.sql_kd(_n, SIZE, 'ld')} {_SQL_LEAVES}")
    def kd_leaves(spark, sf_dir: str, n: int = _n) -> DataFrame:
        return partition.kd_rectangles(_loads(spark, sf_dir), n, SIZE, ["scenario"]).drop("path")


@query("partition_map", f"{_SQL_LOADS}, {partition.sql_kd(8, SIZE, 'ld')} SELECT scenario, r, c, CAST(dense_rank() OVER (PARTITION BY scenario ORDER BY path) - 1 AS INTEGER) AS partition_id FROM kd")
def partition_map(spark, sf_dir: str) -> DataFrame:
    split = partition.kd_split(_loads(spark, sf_dir), 8, SIZE, ["scenario"])
    return split.select("scenario", "r", "c", F.col("leaf").alias("partition_id"))


@query("band_split", f"{_SQL_LOADS} SELECT scenario, CAST(floor(r / 8e0) AS INTEGER) AS band, CAST(sum(load) AS BIGINT) AS load FROM ld GROUP BY ALL")
def band_split(spark, sf_dir: str) -> DataFrame:
    return _loads(spark, sf_dir).groupBy("scenario", F.floor(F.col("r") / 8).cast("int").alias("band")).agg(F.sum("load").cast("long").alias("load"))


@query("imbalance_ratio", f"{_SQL_LOADS}, {partition.sql_kd(8, SIZE, 'ld')}, p AS (SELECT scenario, path, sum(load) AS load FROM kd GROUP BY ALL) SELECT scenario, CAST(min(load) AS BIGINT) AS lo, CAST(max(load) AS BIGINT) AS hi, round(avg(load), 6) AS mean, round(max(load) / CASE WHEN min(load) > 0 THEN min(load) ELSE 1e0 END, 8) AS imbalance FROM p GROUP BY ALL")
def imbalance_ratio(spark, sf_dir: str) -> DataFrame:
    p = partition.kd_rectangles(_loads(spark, sf_dir), 8, SIZE, ["scenario"])
    return p.groupBy("scenario").agg(F.min("load").alias("lo"), F.max("load").alias("hi"), F.round(F.avg("load"), 6).alias("mean"), F.round(F.max("load") / F.when(F.min("load") > 0, F.min("load")).otherwise(1), 8).alias("imbalance"))


def _strategies(spark, sf_dir: str) -> DataFrame:
    """Loads of each strategy on the true load: even, burnable cells, and the load itself (an oracle)."""
    rows = cells(spark, sf_dir)
    ways = F.array(*[F.struct(F.lit(n).alias("strategy"), v.cast("long").alias("load")) for n, v in (("oracle", F.col("q")), ("points", F.when(burnable(F.col("fuel")), 1).otherwise(0)), ("uniform", F.lit(1)))])
    return rows.select("scenario", "r", "c", "q", F.inline(ways))


_SQL_COMPARED = SQL_CELLS + "".join(
    f", ld_{s} AS (SELECT scenario, r, c, CAST({v} AS BIGINT) AS load FROM cells), rt_{s} AS (WITH {partition.sql_kd(8, SIZE, f'ld_{s}')} SELECT scenario, '{s}' AS strategy, round(max(x) / nullif(CAST(sum(x) AS DOUBLE), 0), 8) AS relative_time FROM (SELECT kd.scenario, path, sum(q) AS x FROM kd JOIN cells USING (scenario, r, c) GROUP BY ALL) GROUP BY ALL)"
    for s, v in (("oracle", "q"), ("points", "CASE WHEN fuel BETWEEN 1 AND 13 THEN 1 ELSE 0 END"), ("uniform", "1"))
) + ", rt AS (SELECT * FROM rt_oracle UNION ALL SELECT * FROM rt_points UNION ALL SELECT * FROM rt_uniform)"


def _compared(spark, sf_dir: str) -> DataFrame:
    split = partition.kd_split(_strategies(spark, sf_dir), 8, SIZE, ["scenario", "strategy"])
    parts = split.groupBy("scenario", "strategy", "path").agg(F.sum("q").alias("load"))
    return partition.relative_time(parts, ["scenario", "strategy"])


@query("strategy_comparison", f"{_SQL_COMPARED} SELECT * FROM rt")
def strategy_comparison(spark, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@query("gain_pct", f"{_SQL_COMPARED}, m AS (SELECT avg(relative_time) FILTER (WHERE strategy = 'uniform') AS u, avg(relative_time) FILTER (WHERE strategy = 'points') AS p, avg(relative_time) FILTER (WHERE strategy = 'oracle') AS o FROM rt) SELECT round(u, 6) AS uniform, round(p, 6) AS points, round(o, 6) AS oracle, round(100 * (least(u, p) - o) / least(u, p), 4) AS gain FROM m")
def gain_pct(spark, sf_dir: str) -> DataFrame:
    m = _compared(spark, sf_dir).groupBy().pivot("strategy", ["uniform", "points", "oracle"]).agg(F.avg("relative_time"))
    least = F.least("uniform", "points")
    return m.select(*[F.round(c, 6).alias(c) for c in ("uniform", "points", "oracle")], F.round(100 * (least - F.col("oracle")) / least, 4).alias("gain"))


@query("ignition_search", f"{SQL_CELLS} SELECT scenario, r, c, CAST(greatest(abs(r - 32), abs(c - 32)) AS INTEGER) AS ring FROM cells WHERE fuel BETWEEN 1 AND 13 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY greatest(abs(r - 32), abs(c - 32)), r, c) = 1")
def ignition_search(spark, sf_dir: str) -> DataFrame:
    return spread.nearest_burnable(cells(spark, sf_dir))


_SQL_EDGES = f"""{SQL_RATED}, nb(dr, dc, dist, bearing) AS (SELECT a, b, CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES {", ".join(map(str, spread.NEIGHBOURS))}) v(a, b, c, d)),
e AS (SELECT scenario, r, c, CAST(r + dr AS INTEGER) AS to_r, CAST(c + dc AS INTEGER) AS to_c, dist / greatest(0.01e0, rate * (1e0 + 0.5e0 * cos(radians(180e0 - bearing))) / 15e-1) AS seconds
  FROM rated, nb WHERE fuel BETWEEN 1 AND 13 AND rate >= 1e-6 AND r + dr BETWEEN 0 AND {SIZE - 1} AND c + dc BETWEEN 0 AND {SIZE - 1}),
ig AS (SELECT scenario, r, c, 0e0 AS toa FROM cells WHERE fuel BETWEEN 1 AND 13 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY greatest(abs(r - 32), abs(c - 32)), r, c) = 1)"""


def _sql_rounds(n: int) -> str:
    out, last = "", "ig"
    for k in range(1, n + 1):
        out += f", t{k} AS (SELECT scenario, r, c, min(toa) AS toa FROM (SELECT * FROM {last} UNION ALL SELECT e.scenario, to_r, to_c, toa + seconds FROM {last} JOIN e ON e.scenario = {last}.scenario AND e.r = {last}.r AND e.c = {last}.c) GROUP BY ALL)"
        last = f"t{k}"
    return out


@query("edges", f"{_SQL_EDGES} SELECT scenario, r, c, to_r, to_c, round(ln(1 + seconds), 6) AS log_seconds FROM e")
def edges(spark, sf_dir: str) -> DataFrame:
    return spread.edges(_rated(spark, sf_dir), size=SIZE).select("scenario", "r", "c", "to_r", "to_c", F.round(F.log1p("seconds"), 6).alias("log_seconds"))


def _ignition(rows: DataFrame) -> DataFrame:
    return spread.nearest_burnable(rows).select("scenario", "r", "c", F.lit(0.0).alias("toa"))


def _arrivals(spark, sf_dir: str, rounds: int | None = 6) -> DataFrame:
    rows = _rated(spark, sf_dir)
    return spread.relax(checkpointed(spread.edges(rows, size=SIZE)), _ignition(rows), rounds)


@query("toa_rounds_6", f"{_SQL_EDGES}{_sql_rounds(6)} SELECT scenario, r, c, round(toa, 4) AS toa FROM t6")
def toa_rounds(spark, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).select("scenario", "r", "c", F.round("toa", 4).alias("toa"))


def sql_fixpoint(ctes: str, edges: str = "e") -> str:
    """The least times t over the edges, in as many rounds as it takes: a round carries the cells that got earlier."""
    begin = ctes.replace("WITH ", "WITH RECURSIVE ", 1).replace(f"{edges} AS (", f"{edges} AS MATERIALIZED (", 1)
    reached = f"SELECT {edges}.scenario, to_r AS r, to_c AS c, min(toa + seconds) AS toa FROM t JOIN {edges} ON {edges}.scenario = t.scenario AND {edges}.r = t.r AND {edges}.c = t.c GROUP BY ALL"
    return f"{begin}, t(scenario, r, c, toa) USING KEY (scenario, r, c) AS (SELECT scenario, r, c, toa FROM ig UNION SELECT n.* FROM ({reached}) n LEFT JOIN recurring.t AS old ON old.scenario = n.scenario AND old.r = n.r AND old.c = n.c WHERE old.toa IS NULL OR n.toa < old.toa)"


_FIXPOINT = sql_fixpoint(_SQL_EDGES)


@query("toa_fixpoint", f"{_FIXPOINT} SELECT scenario, r, c, round(toa, 4) AS toa FROM t")
def toa_fixpoint(spark, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir)
    return spread.relax(checkpointed(spread.edges(rows, size=SIZE)), _ignition(rows)).select("scenario", "r", "c", F.round("toa", 4).alias("toa"))


_REACHED = f"{_SQL_EDGES}{_sql_rounds(6)}"


@query("reached_at_t", f"{_REACHED} SELECT scenario, count(*) AS reached, round(100e0 * count(*) FILTER (WHERE toa <= 30) / {SIZE * SIZE}, 6) AS pct_at_30_s, round(max(toa), 4) AS last FROM t6 GROUP BY ALL")
def reached_at_t(spark, sf_dir: str, rounds: int | None = 6) -> DataFrame:
    return _arrivals(spark, sf_dir, rounds).groupBy("scenario").agg(F.count("*").alias("reached"), F.round(100 * F.count_if(F.col("toa") <= 30) / (SIZE * SIZE), 6).alias("pct_at_30_s"), F.round(F.max("toa"), 4).alias("last"))


@query("downwind_shift", f"{_REACHED} SELECT scenario, round(CASE WHEN count(*) < 10 THEN 0e0 ELSE avg(c - 32) * sin(radians(18e1)) - avg(r - 32) * cos(radians(18e1)) END, 6) AS shift FROM t6 GROUP BY ALL")
def downwind_shift(spark, sf_dir: str, rounds: int | None = 6) -> DataFrame:
    theta = F.radians(F.lit(180.0))
    shift = F.avg(F.col("c") - 32) * F.sin(theta) - F.avg(F.col("r") - 32) * F.cos(theta)
    return _arrivals(spark, sf_dir, rounds).groupBy("scenario").agg(F.round(F.when(F.count("*") < 10, 0.0).otherwise(shift), 6).alias("shift"))


@query("isochrones", f"{_REACHED} SELECT scenario, CAST(floor(toa / 60) AS INTEGER) AS band, count(*) AS n FROM t6 GROUP BY ALL")
def isochrones(spark, sf_dir: str, rounds: int | None = 6) -> DataFrame:
    return _arrivals(spark, sf_dir, rounds).groupBy("scenario", F.floor(F.col("toa") / 60).cast("int").alias("band")).agg(F.count("*").alias("n"))


# The reports on final times of all cells that the fire reaches.
@query("reached_at_t_fixpoint", SQL["reached_at_t"].replace(_REACHED, _FIXPOINT).replace("FROM t6", "FROM t"))
def reached_at_t_fixpoint(spark, sf_dir: str) -> DataFrame:
    return reached_at_t(spark, sf_dir, None)


@query("downwind_shift_fixpoint", SQL["downwind_shift"].replace(_REACHED, _FIXPOINT).replace("FROM t6", "FROM t"))
def downwind_shift_fixpoint(spark, sf_dir: str) -> DataFrame:
    return downwind_shift(spark, sf_dir, None)


@query("isochrones_fixpoint", SQL["isochrones"].replace(_REACHED, _FIXPOINT).replace("FROM t6", "FROM t"))
def isochrones_fixpoint(spark, sf_dir: str) -> DataFrame:
    return isochrones(spark, sf_dir, None)


# A field of times that covers the grid: quantities as times, 0 where nothing falls.
_SQL_FRONTS = f"{SQL_CELLS}, mx AS (SELECT scenario, max(q) AS tmax FROM cells WHERE q > 0 GROUP BY ALL), fr AS (SELECT scenario, r, c, CAST(floor(CAST(q AS DOUBLE) * 40 / tmax) AS INTEGER) AS step FROM cells JOIN mx USING (scenario) WHERE q < tmax)"


def _fronts(spark, sf_dir: str) -> DataFrame:
    return rebalance.fronts(cells(spark, sf_dir).select("scenario", "r", "c", F.col("q").cast("double").alias("toa")), 40)


@query("front_bins", f"{_SQL_FRONTS} SELECT scenario, step, count(*) AS n FROM fr GROUP BY ALL")
def front_bins(spark, sf_dir: str) -> DataFrame:
    return _fronts(spark, sf_dir).groupBy("scenario", "step").agg(F.count("*").alias("n"))


@query("online_static", f"{_SQL_FRONTS}, one AS (SELECT scenario, r, c, CAST(1 AS BIGINT) AS load FROM cells), {partition.sql_kd(8, SIZE, 'one')}, s AS (SELECT fr.scenario, step, path, count(*) AS n FROM fr JOIN kd USING (scenario, r, c) GROUP BY ALL), t AS (SELECT scenario, step, max(n) AS most, sum(n) AS work FROM s GROUP BY ALL) SELECT scenario, round(CAST(sum(most) AS DOUBLE) / greatest(sum(work), 1), 8) AS relative_time FROM t GROUP BY ALL")
def online_static(spark, sf_dir: str) -> DataFrame:
    return rebalance.static_makespan(_fronts(spark, sf_dir), cells(spark, sf_dir), 8, SIZE)


@query("online_oracle")
def online_oracle(spark, sf_dir: str) -> DataFrame:
    return rebalance.lagged_makespan(_fronts(spark, sf_dir), 8, SIZE)


@query("speedup_mean", "WITH t AS (SELECT l_orderkey AS id, avg(l_extendedprice) FILTER (WHERE l_linenumber = 1) AS base, avg(l_extendedprice) FILTER (WHERE l_linenumber = 2) AS other FROM lineitem GROUP BY ALL) SELECT count(*) AS n, round(avg(base / other), 8) AS speedup FROM t WHERE base IS NOT NULL AND other > 0")
def speedup_mean(spark, sf_dir: str) -> DataFrame:
    """The mean of ratios of two configurations' times, here prices of two line numbers; pairs with a gap are left out."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_linenumber").isin(1, 2))
    t = rows.groupBy("l_orderkey").pivot("l_linenumber", [1, 2]).agg(F.avg("l_extendedprice"))
    return t.where(F.col("1").isNotNull() & (F.col("2") > 0)).agg(F.count("*").alias("n"), F.round(F.avg(F.col("1") / F.col("2")), 8).alias("speedup"))


@query("runtime_summary", "SELECT l_linenumber AS config, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY ALL")
def runtime_summary(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = "l_extendedprice"
    return rows.groupBy(F.col("l_linenumber").alias("config")).agg(F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.stddev_pop(x), 4).alias("std"))
