"""Queries on scenarios: features, parsed lines, profiles and flags, masks, strips, sweeps of strategies, run times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features
from ..grid import SIZE, SQL_CELLS, burnable, cells
from ..operators import partition, regions
from ..sources.cubes import metric_json as to_json
from .core import _SQL_LONG, _long, query

# Features are orders: acres and square metres are their price, names and dates come from their priority and key.
_ORDERS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey AS VARCHAR) END AS acres, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey * 1000 AS VARCHAR) END AS metres, CASE WHEN o_orderkey % 3 = 0 THEN '  ' WHEN o_orderkey % 3 = 1 THEN ' ' || o_orderpriority || ' fire' END AS name, CASE o_orderkey % 4 WHEN 0 THEN CAST(1000000000000 + o_orderkey * 86400000 AS VARCHAR) WHEN 1 THEN '2018-11-08T06:30:00Z' WHEN 2 THEN '' END AS day FROM orders"


@query("feature_cleanup", f"WITH f AS ({_ORDERS}) SELECT id, round(coalesce(TRY_CAST(acres AS DOUBLE), CASE WHEN TRY_CAST(metres AS DOUBLE) > 1e5 THEN TRY_CAST(metres AS DOUBLE) / 4046.86e0 ELSE TRY_CAST(metres AS DOUBLE) END, 0), 6) AS acres, coalesce(upper(replace(CASE WHEN trim(name) <> '' THEN trim(name) END, ' ', '_')), 'FIRE_' || CAST(id % 100000 AS VARCHAR)) AS name, CASE WHEN day IS NULL OR day = '' THEN '2016-07-01' WHEN TRY_CAST(day AS BIGINT) IS NOT NULL THEN strftime(epoch_ms(TRY_CAST(day AS BIGINT)), '%Y-%m-%d') ELSE substr(day, 1, 10) END AS day FROM f")
def feature_cleanup(spark, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("id"),
        F.when(key % 5 == 0, "n/a").when(key % 5 == 1, cust.cast("string")).alias("acres"),
        F.when(key % 7 != 0, (cust * 1000).cast("string")).alias("metres"),
        F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.concat(F.lit(" "), "o_orderpriority", F.lit(" fire"))).alias("name"),
        F.when(key % 4 == 0, (F.lit(1_000_000_000_000) + key * 86_400_000).cast("string")).when(key % 4 == 1, "2018-11-08T06:30:00Z").when(key % 4 == 2, "").alias("day"),
    )
    return rows.select("id", features.scaled_round(features.area_acres([(F.col("acres"), False), (F.col("metres"), True)]), 6).alias("acres"), features.clean_name([F.col("name")], F.col("id")).alias("name"), features.iso_date(F.col("day")).alias("day"))


@query("degree_boxes", "WITH p AS (SELECT c_custkey, c_custkey * 37 % 3600 / 1e1 - 180 AS lon, c_custkey * 11 % 1600 / 1e1 - 79.97e0 AS lat FROM customer) SELECT c_custkey, round(lon - 6750 / (111320e0 * cos(radians(lat))), 6) AS west, round(lat - 6750 / 111320e0, 6) AS south, round(lon + 6750 / (111320e0 * cos(radians(lat))), 6) AS east, round(lat + 6750 / 111320e0, 6) AS north, lon BETWEEN -125 AND -66.5e0 AND lat BETWEEN 24.5e0 AND 49.5e0 AS inside FROM p")
def degree_boxes(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (key * 37 % 3600 / 10.0 - 180).alias("lon"), (key * 11 % 1600 / 10.0 - 79.97).alias("lat"))
    dlon, dlat = features.degrees_of(F.lit(6750.0), F.col("lat"))
    ends = [("lon", -dlon, "west"), ("lat", -dlat, "south"), ("lon", dlon, "east"), ("lat", dlat, "north")]
    return rows.select("c_custkey", *[F.round(F.col(c) + d, 6).alias(n) for c, d, n in ends], (F.col("lon").between(-125, -66.5) & F.col("lat").between(24.5, 49.5)).alias("inside"))


@query("parsed_lines", "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter(string_split(CAST(l_quantity AS INTEGER) || ',,' || CASE WHEN l_partkey % 3 = 0 THEN 'bad' ELSE CAST(l_partkey AS VARCHAR) || 'm' END || ',-1.5e1', ','), lambda x: x <> '') AS x FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CAST(len(x) AS INTEGER) AS n, coalesce(TRY_CAST(regexp_extract(x[1], '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1) AS DOUBLE), 0) AS a, coalesce(TRY_CAST(regexp_extract(x[2], '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1) AS DOUBLE), 0) AS b, coalesce(TRY_CAST(regexp_extract(x[3], '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1) AS DOUBLE), 0) AS c FROM t".replace("\\\\", "\\"))
def parsed_lines(spark, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    line = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",,"), F.when(part % 3 == 0, "bad").otherwise(F.concat(part.cast("string"), F.lit("m"))), F.lit(",-1.5e1"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", features.line_numbers(line).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size("x").alias("n"), *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate("abc")])


@query("reported_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS seconds FROM orders")
def reported_times(spark, sf_dir: str) -> DataFrame:
    """The time that a program's output reports, of outputs made of orders; every ninth reports none."""
    said = F.concat(F.lit("run 3.5 of 10\n"), F.when(F.col("o_orderkey") % 9 == 0, "no result 1.25\n").otherwise(F.concat(F.lit("Tempo médio: "), F.format_string("%.2f", "o_totalprice"), F.lit(" s (max 9.99)\n"))), F.lit("bye"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", features.reported_number(said).alias("seconds"))


@query("spread_table_rate", f"{SQL_CELLS}, t AS (SELECT scenario, r, c, slope, fuel, (q % 120) / 1e2 AS f, [0.02e0, 0.05e0, 0.15e0, 0.12e0, 0.08e0, 0.10e0, 0.08e0, 0.03e0, 0.04e0, 0.06e0, 0.05e0, 0.10e0, 0.20e0] AS k FROM cells) SELECT scenario, r, c, round(CASE WHEN f < 0.001e0 THEN 0e0 ELSE k[greatest(1, least(13, CAST(floor(f * 12) AS INTEGER) + 1))] * (1 + 0.4e0 * (5e0 / 10) + 0.1e0 * (slope / 1e2)) END, 8) AS rate, fuel IN (0, 91, 92, 93, 98, 99) AS never FROM t")
def spread_table_rate(spark, sf_dir: str) -> DataFrame:
    rate = features.table_rate(F.col("q") % 120 / 100.0, F.col("slope").cast("double"), F.lit(5.0))
    return cells(spark, sf_dir).select("scenario", "r", "c", F.round(rate, 8).alias("rate"), F.col("fuel").isin(0, 91, 92, 93, 98, 99).alias("never"))


_PROFILE = "SELECT scenario, layer, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(var_pop(v), 5) AS var, round(100e0 * count(*) FILTER (WHERE v = 0) / count(*), 6) AS pct_zero, count(DISTINCT v) AS n_unique, bool_or(isnan(v)) AS any_nan FROM l GROUP BY ALL"


@query("layer_profile_full", f"{_SQL_LONG} {_PROFILE}")
def layer_profile_full(spark, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _long(spark, sf_dir).groupBy("scenario", "layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.var_pop("v"), 5).alias("var"), F.round(100 * F.count_if(v == 0) / F.count("*"), 6).alias("pct_zero"), F.count_distinct("v").alias("n_unique"), F.bool_or(F.isnan("v")).alias("any_nan"))


# The range that a layer's values are expected in.
RANGES = {"q": (1.0, 99.0), "fuel": (0.0, 99.0), "slope": (0.0, 45.0), "elevation": (-150.0, 4500.0)}


@query("layer_flags", f"{_SQL_LONG}, k(layer, lo, hi) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {a}e0, {b}e0)' for n, (a, b) in RANGES.items())}), m AS (SELECT layer, min(v) AS least, max(v) AS most FROM l GROUP BY layer) SELECT layer, concat_ws('|', CASE WHEN most > hi + 1e-6 THEN 'max above ' || CAST(CAST(hi AS INTEGER) AS VARCHAR) END, CASE WHEN least < lo - 1e-6 THEN 'min below ' || CAST(CAST(lo AS INTEGER) AS VARCHAR) END) AS flags, most <= 1.0001e0 AS normalized FROM m JOIN k USING (layer)")
def layer_flags(spark, sf_dir: str) -> DataFrame:
    wanted = F.create_map(*[x for n, (a, b) in RANGES.items() for x in (F.lit(n), F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")))])
    m = _long(spark, sf_dir).groupBy("layer").agg(F.min("v").alias("least"), F.max("v").alias("most")).withColumn("k", F.element_at(wanted, F.col("layer")))
    said = lambda word, x: F.concat(F.lit(word), x.cast("int").cast("string"))
    flags = F.concat_ws("|", F.when(F.col("most") > F.col("k.hi") + 1e-6, said("max above ", F.col("k.hi"))), F.when(F.col("least") < F.col("k.lo") - 1e-6, said("min below ", F.col("k.lo"))))
    return m.select("layer", flags.alias("flags"), (F.col("most") <= 1.0001).alias("normalized"))


@query("fuel_codes", f"{SQL_CELLS} SELECT scenario, array_to_string(list_sort(list(DISTINCT fuel)), ',') AS codes FROM cells GROUP BY scenario")
def fuel_codes(spark, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("scenario").agg(F.array_join(F.transform(F.array_sort(F.collect_set("fuel")), lambda x: x.cast("string")), ",").alias("codes"))


# Scenarios are nations with a split; those whose key is a line number have a cube, and labels where quantities fall.
@query("scenario_cube_label", f"{SQL_CELLS}, s AS (SELECT n_nationkey AS scenario, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM nation), lb AS (SELECT scenario, r, c, q AS toa FROM cells WHERE q > 0 AND scenario <> 6), ok AS (SELECT scenario FROM lb GROUP BY scenario HAVING max(toa) > 1) SELECT s.name, split, count(*) AS n, CAST(sum(toa) AS BIGINT) AS total, round(sum(toa / 86400e0), 6) AS days FROM s JOIN cells USING (scenario) JOIN lb USING (scenario, r, c) JOIN ok USING (scenario) WHERE split = 'train' GROUP BY ALL")
def scenario_cube_label(spark, sf_dir: str) -> DataFrame:
    """Scenarios of the training split with their cubes and labels; those without either, or never burning, fall away."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("scenario"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "test").otherwise("train").alias("split")).where("split = 'train'")
    cube = cells(spark, sf_dir)
    label = cube.where("q > 0 and scenario <> 6").select("scenario", "r", "c", F.col("q").alias("toa"))
    burning = label.groupBy("scenario").agg(F.max("toa").alias("last")).where("last > 1").select("scenario")
    rows = cube.select("scenario", "r", "c").join(label, ["scenario", "r", "c"]).join(names, "scenario").join(burning, "scenario", "left_semi")
    return rows.groupBy("name", "split").agg(F.count("*").alias("n"), F.sum("toa").cast("long").alias("total"), F.round(F.sum(F.col("toa") / 86400), 6).alias("days"))


@query("predictions", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(86400e0, greatest(0e0, (l_discount - 0.02e0) * 12) * 86400), 4) AS load, round(1 / (1 + exp(-(l_tax - 0.04e0) * 50)), 8) AS share, l_quantity > 0 AS burned, CASE WHEN l_quantity <= -9990 THEN -9999e0 ELSE l_quantity END AS raw FROM lineitem")
def predictions(spark, sf_dir: str) -> DataFrame:
    load = F.least(F.lit(86400.0), F.greatest(F.lit(0.0), (F.col("l_discount") - 0.02) * 12) * 86400)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(load, 4).alias("load"), F.round(features.sigmoid((F.col("l_tax") - 0.04) * 50), 8).alias("share"), (F.col("l_quantity") > 0).alias("burned"), F.when(F.col("l_quantity") <= -9990, -9999.0).otherwise(F.col("l_quantity")).alias("raw"))


@query("fire_masks", f"{SQL_CELLS}, t AS (SELECT scenario, max(q) AS tmax FROM cells GROUP BY scenario) SELECT scenario, k AS tenths, count(*) FILTER (WHERE q > 0 AND q <= tmax * k / 1e1) AS reached, count(*) FILTER (WHERE q > 0 AND q <= tmax * k / 1e1 AND q >= tmax * k / 1e1 - 0.05e0 * tmax) AS front FROM cells JOIN t USING (scenario), (SELECT unnest(range(1, 11)) AS k) GROUP BY ALL")
def fire_masks(spark, sf_dir: str) -> DataFrame:
    """Cells reached and cells of the front at tenths of the last arrival; quantities stand for arrival times."""
    rows = cells(spark, sf_dir)
    last = rows.groupBy("scenario").agg(F.max("q").alias("tmax"))
    at = F.col("tmax") * F.col("tenths") / 10
    reached = (F.col("q") > 0) & (F.col("q") <= at)
    rows = rows.join(last, "scenario").select("scenario", "q", "tmax", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("tenths"))
    return rows.groupBy("scenario", "tenths").agg(F.count_if(reached).alias("reached"), F.count_if(reached & (F.col("q") >= at - 0.05 * F.col("tmax"))).alias("front"))


for _axis, _other in (("r", "c"), ("c", "r")):

    @query(
        f"strips_{_axis}_7",
        f"""{SQL_CELLS}, ld AS (SELECT scenario, r, c, CASE WHEN scenario = 5 THEN 0 WHEN {_axis} BETWEEN 20 AND 22 THEN q * 1000 ELSE q END AS load FROM cells), m AS (SELECT scenario, {_axis}, sum(load) AS load FROM ld GROUP BY ALL),
s AS (SELECT *, sum(load) OVER (PARTITION BY scenario ORDER BY {_axis}) AS run, sum(load) OVER (PARTITION BY scenario) AS tot FROM m),
e AS (SELECT scenario, CASE WHEN max(tot) <= 0 THEN part * {SIZE} // 7 ELSE count(*) FILTER (WHERE 7 * run < tot * part) END AS edge FROM s, (SELECT unnest(range(1, 7)) AS part) GROUP BY scenario, part),
d AS (SELECT scenario, list_sort(list_distinct(list(edge) || [0, {SIZE}])) AS e FROM e GROUP BY scenario), x AS (SELECT scenario, e || list_resize([{SIZE}], greatest(0, 8 - len(e)), {SIZE}) AS e FROM d),
y AS (SELECT scenario, k, e[k + 1] AS lo, e[k + 2] AS hi FROM (SELECT scenario, e, unnest(range(0, len(e) - 1)) AS k FROM x)) SELECT scenario, CAST(k AS INTEGER) AS leaf, CAST(lo AS INTEGER) AS lo, CAST(CASE WHEN hi <= lo THEN least(lo + 1, {SIZE}) ELSE hi END AS INTEGER) AS hi FROM y""",
    )
    def strips(spark, sf_dir: str, axis: str = _axis) -> DataFrame:
        load = F.when(F.col("scenario") == 5, 0).when(F.col(axis).between(20, 22), F.col("q") * 1000).otherwise(F.col("q"))
        return partition.strips(cells(spark, sf_dir).withColumn("load", load), 7, ["scenario"], axis, SIZE)


# Strategies on the true load: even, burnable cells, a prediction, and the load itself.
_STRATEGIES = {"oracle": "q", "points": "CASE WHEN fuel BETWEEN 1 AND 13 THEN 1 ELSE 0 END", "predicted": "q - q % 20", "uniform": "1"}
_PARTS = (2, 4, 8, 16, 32)
_SQL_SWEEP = SQL_CELLS + "".join(
    f", ld_{s}_{n} AS (SELECT scenario, r, c, CAST({sql} AS BIGINT) AS load FROM cells), rt_{s}_{n} AS (WITH {partition.sql_kd(n, SIZE, f'ld_{s}_{n}')} SELECT scenario, '{s}' AS strategy, {n} AS n, max(x) / nullif(CAST(sum(x) AS DOUBLE), 0) AS t FROM (SELECT kd.scenario, path, sum(q) AS x FROM kd JOIN cells USING (scenario, r, c) GROUP BY ALL) GROUP BY ALL)"
    for s, sql in _STRATEGIES.items()
    for n in _PARTS
) + ", rt AS (" + " UNION ALL ".join(f"SELECT * FROM rt_{s}_{n}" for s in _STRATEGIES for n in _PARTS) + "), mean AS (SELECT strategy, n, round(avg(t), 6) AS relative_time, count(*) AS scenarios FROM rt GROUP BY ALL)"


def _sweep(spark, sf_dir: str) -> DataFrame:
    """All strategies and counts of parts are split together, as keys of one k-d split; counts are held to 2..32."""
    ways = F.array(*[F.struct(F.lit(s).alias("strategy"), F.greatest(F.lit(2), F.least(F.lit(32), F.lit(n))).alias("n"), F.expr(v).cast("long").alias("load")) for s, v in _STRATEGIES.items() for n in _PARTS])
    split = partition.kd_split(cells(spark, sf_dir).select("scenario", "r", "c", "q", F.inline(ways)), "n", SIZE, ["scenario", "strategy", "n"])
    by = ["scenario", "strategy", "n"]
    times = split.groupBy(*by, "path").agg(F.sum("q").alias("load")).groupBy(*by).agg((F.max("load") / F.sum("load").cast("double")).alias("t"))
    return times.groupBy("strategy", "n").agg(F.round(F.avg("t"), 6).alias("relative_time"), F.count("*").alias("scenarios"))


@query("strategy_sweep", f"{_SQL_SWEEP} SELECT * FROM mean")
def strategy_sweep(spark, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query("strategy_json", "SELECT o_orderpriority AS strategy, '{' || string_agg('\"' || n || '\":' || v, ',' ORDER BY n) || '}' AS json FROM (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS n, count(*) AS v FROM orders GROUP BY ALL) GROUP BY ALL")
def strategy_json(spark, sf_dir: str) -> DataFrame:
    """Metrics of strategies by n as JSON; here counts of orders by priority and year."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("strategy"), F.year("o_orderdate").alias("n")).agg(F.count("*").alias("v"))
    return to_json(rows, "v")


# Rectangles are customers, in the scenario of their key.
@query("rectangle_sums", f"{SQL_CELLS}, b AS (SELECT c_custkey AS id, CAST(1 + c_custkey % 7 AS INTEGER) AS scenario, CAST(c_custkey % 50 AS INTEGER) AS r0, CAST(c_custkey % 50 + 1 + c_custkey * 3 % 14 AS INTEGER) AS r1, CAST(c_custkey * 7 % 50 AS INTEGER) AS c0, CAST(c_custkey * 7 % 50 + 1 + c_custkey * 5 % 14 AS INTEGER) AS c1 FROM customer) SELECT id, b.scenario, r0, r1, c0, c1, CAST(coalesce(sum(q), 0) AS BIGINT) AS total FROM b LEFT JOIN cells ON cells.scenario = b.scenario AND r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY ALL")
def rectangle_sums(spark, sf_dir: str) -> DataFrame:
    k, whole = F.col("c_custkey"), lambda x: x.cast("int")
    boxes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), whole(1 + k % 7).alias("scenario"), whole(k % 50).alias("r0"), whole(k % 50 + 1 + k * 3 % 14).alias("r1"), whole(k * 7 % 50).alias("c0"), whole(k * 7 % 50 + 1 + k * 5 % 14).alias("c1"))
    by_row = cells(spark, sf_dir).withColumn("s", F.sum("q").over(W.partitionBy("scenario", "r").orderBy("c")))
    prefix = by_row.select("scenario", "r", "c", F.sum("s").over(W.partitionBy("scenario", "c").orderBy("r")).alias("total"))
    return regions.rectangle_sums(prefix, boxes, ["scenario"]).withColumn("total", F.col("total").cast("long"))


@query("patches_5", f"{SQL_CELLS}, o AS (SELECT scenario, r, c, a.range AS dr, b.range AS dc FROM cells, range(-2, 3) a, range(-2, 3) b), t AS (SELECT *, CASE WHEN r + dr < 0 THEN -r - dr WHEN r + dr >= {SIZE} THEN 2 * {SIZE} - 2 - r - dr ELSE r + dr END AS pr, CASE WHEN c + dc < 0 THEN -c - dc WHEN c + dc >= {SIZE} THEN 2 * {SIZE} - 2 - c - dc ELSE c + dc END AS pc FROM o) SELECT t.scenario, t.r, t.c, string_agg(CAST(q AS VARCHAR), ',' ORDER BY dr, dc) AS patch FROM t JOIN cells ON cells.scenario = t.scenario AND cells.r = pr AND cells.c = pc GROUP BY ALL")
def patches_5(spark, sf_dir: str) -> DataFrame:
    rows = regions.patches(cells(spark, sf_dir), 5, SIZE, ["scenario"], "q")
    return rows.select("scenario", "r", "c", F.array_join(F.transform("patch", lambda x: x.cast("string")), ",").alias("patch"))


@query("resampled_45", f"{SQL_CELLS}, k AS (SELECT range AS k, (range + 0.5e0) * {SIZE} / 45 - 0.5e0 AS x FROM range(45)), w AS (SELECT k, i, sum(w) AS w FROM (SELECT k, least({SIZE - 1}, greatest(0, CAST(floor(x) AS INTEGER))) AS i, 1 - (x - floor(x)) AS w FROM k UNION ALL SELECT k, least({SIZE - 1}, greatest(0, CAST(floor(x) AS INTEGER) + 1)), x - floor(x) FROM k) GROUP BY ALL) SELECT scenario, CAST(a.k AS INTEGER) AS r, CAST(b.k AS INTEGER) AS c, round(sum(a.w * b.w * q), 6) AS q FROM cells JOIN w a ON a.i = r JOIN w b ON b.i = c GROUP BY ALL")
def resampled_45(spark, sf_dir: str) -> DataFrame:
    rows = regions.resampled(cells(spark, sf_dir), SIZE, 45, ["scenario"], "q")
    return rows.select("scenario", "r", "c", F.round("q", 6).alias("q"))


@query("ignition_search_4", f"{SQL_CELLS} SELECT scenario, r, c, CAST(abs(r - 32) + abs(c - 32) AS INTEGER) AS steps FROM cells WHERE fuel BETWEEN 1 AND 13 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY abs(r - 32) + abs(c - 32), r, c) = 1")
def ignition_search_4(spark, sf_dir: str) -> DataFrame:
    steps = F.abs(F.col("r") - 32) + F.abs(F.col("c") - 32)
    best = cells(spark, sf_dir).where(burnable(F.col("fuel"))).groupBy("scenario").agg(F.min(F.struct(steps.alias("steps"), "r", "c")).alias("m"))
    return best.select("scenario", "m.r", "m.c", F.col("m.steps").cast("int").alias("steps"))


@query("agreement", f"{SQL_CELLS}, a AS (SELECT scenario, r, c FROM cells WHERE q > 0), b AS (SELECT scenario, r, c FROM cells WHERE fuel BETWEEN 1 AND 13), x AS (SELECT scenario, a.r IS NOT NULL AS one, b.r IS NOT NULL AS two FROM a FULL JOIN b USING (scenario, r, c)) SELECT scenario, count(*) FILTER (WHERE one AND two) AS both, count(*) FILTER (WHERE one) AS first, count(*) FILTER (WHERE two) AS second, round(1e0 * count(*) FILTER (WHERE one AND two) / count(*), 8) AS agreement FROM x GROUP BY ALL")
def agreement(spark, sf_dir: str) -> DataFrame:
    """How far two burned areas agree, cell by cell: cells with a quantity, and cells that burn."""
    rows = cells(spark, sf_dir)
    side = lambda cond, name: rows.where(cond).select("scenario", "r", "c", F.lit(True).alias(name))
    met = side("q > 0", "one").join(side("fuel between 1 and 13", "two"), ["scenario", "r", "c"], "full_outer")
    one, two = (F.coalesce(F.col(c), F.lit(False)) for c in ("one", "two"))
    return met.groupBy("scenario").agg(F.count_if(one & two).alias("both"), F.count_if(one).alias("first"), F.count_if(two).alias("second"), F.round(F.count_if(one & two) / F.count("*"), 8).alias("agreement"))


# Run times are line items: an order is a scenario, a line number a configuration, the price its time; not all have run.
@query("runtime_wide", "SELECT l_orderkey AS scenario, round(avg(l_extendedprice) FILTER (WHERE l_linenumber = 1), 4) AS seq, round(avg(l_extendedprice) FILTER (WHERE l_linenumber = 2), 4) AS omp_2, round(avg(l_extendedprice) FILTER (WHERE l_linenumber = 3), 4) AS omp_4, round(1000 * avg(l_extendedprice) FILTER (WHERE l_linenumber = 4), 1) AS cuda_ms FROM lineitem GROUP BY ALL")
def runtime_wide(spark, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("scenario")).pivot("l_linenumber", [1, 2, 3, 4]).agg(F.avg("l_extendedprice"))
    return wide.select("scenario", *[F.round(F.col(k), 4).alias(n) for k, n in (("1", "seq"), ("2", "omp_2"), ("3", "omp_4"))], F.round(1000 * F.col("4"), 1).alias("cuda_ms"))


@query("runtime_extrema", "SELECT l_linenumber AS config, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS fastest, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS slowest, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag <> 'R') AS succeeded FROM lineitem GROUP BY ALL")
def runtime_extrema(spark, sf_dir: str) -> DataFrame:
    rows, x = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.struct("l_extendedprice", "l_orderkey")
    return rows.groupBy(F.col("l_linenumber").alias("config")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.min_by("l_orderkey", x).alias("fastest"), F.max_by("l_orderkey", x).alias("slowest"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_returnflag") != "R").alias("succeeded"))


@query("runtime_means", "WITH o AS (SELECT l_orderkey, avg(l_extendedprice) FILTER (WHERE l_linenumber = 1) AS seq, avg(l_extendedprice) FILTER (WHERE l_linenumber = 2) AS omp FROM lineitem GROUP BY ALL) SELECT round(avg(coalesce(seq, 0)), 4) AS seq_missing_as_0, round(avg(omp), 4) AS omp, count(*) FILTER (WHERE seq IS NULL) AS missing FROM o")
def runtime_means(spark, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").pivot("l_linenumber", [1, 2]).agg(F.avg("l_extendedprice"))
    return wide.agg(F.round(F.avg(F.coalesce("1", F.lit(0.0))), 4).alias("seq_missing_as_0"), F.round(F.avg("2"), 4).alias("omp"), F.count_if(F.col("1").isNull()).alias("missing"))


@query("policy_deltas", "WITH p AS (SELECT l_suppkey AS scenario, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS a, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS b, count(*) FILTER (WHERE l_linestatus = 'O') AS ra, count(*) FILTER (WHERE l_linestatus = 'F') AS rb FROM lineitem GROUP BY ALL) SELECT scenario, round(100 * (a - b) / a, 6) AS gain, round(100e0 * (ra - rb) / greatest(ra, 1), 6) AS saved FROM p")
def policy_deltas(spark, sf_dir: str) -> DataFrame:
    """How one policy does against another in time and in changes; here line items that are open and filled, by supplier."""
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("scenario")).pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_extendedprice").alias("t"), F.count("l_linestatus").alias("n"))
    ra, rb = (F.coalesce(F.col(c), F.lit(0)) for c in ("O_n", "F_n"))
    return p.select("scenario", F.round(100 * (F.col("O_t") - F.col("F_t")) / F.col("O_t"), 6).alias("gain"), F.round(100.0 * (ra - rb) / F.greatest(ra, F.lit(1)), 6).alias("saved"))


@query("load_since_repartition", "WITH s AS (SELECT user_id, ts, event_id, value, count(*) FILTER (WHERE event_type = 'error') OVER w AS epoch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, epoch, round(sum(value) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id), 4) AS load FROM s")
def load_since_repartition(spark, sf_dir: str) -> DataFrame:
    """The load that has come together since the last change; changes are errors among a user's events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    order = lambda *by: W.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    epochs = rows.withColumn("epoch", F.count_if(F.col("event_type") == "error").over(order("user_id")))
    return epochs.select("user_id", "event_id", "epoch", F.round(F.sum("value").over(order("user_id", "epoch")), 4).alias("load"))


@query("model_parameters", "SELECT CAST(a AS INTEGER) AS window, 96864 + 128 * (a - 6) * (a - 6) * 256 + 256 + 257 AS parameters FROM (VALUES (9), (12), (15), (18), (21)) v(a)")
def model_parameters(spark, sf_dir: str) -> DataFrame:
    a = F.col("window").cast("long")
    return spark.createDataFrame([(k,) for k in (9, 12, 15, 18, 21)], "window int").select("window", (96864 + 128 * (a - 6) * (a - 6) * 256 + 256 + 257).alias("parameters"))
