"""Clean-up of features on keys beyond those of the small tables, against DuckDB."""

import duckdb
import pytest

from cellweave import registry


def both(spark, folder, rows):
    """The query's rows and the SQL's, of orders with these keys and customers."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, '5-LOW' AS o_orderpriority FROM (VALUES {', '.join(map(str, rows))}) t(o_orderkey, o_custkey)")
    con.execute(f"COPY orders TO '{folder}/orders.parquet' (FORMAT parquet)")
    got = [tuple(x) for x in registry.QUERIES["feature_cleanup"](spark, str(folder)).select("id", "acres", "name", "day").collect()]
    want = con.execute(f"SELECT id, acres, name, day FROM ({registry.SQL['feature_cleanup']})").fetchall()
    return sorted(got), sorted(want)


def test_areas_just_below_a_half_round_down(spark, tmp_path):
    # 68604000 / 4046.86 is 16952.4026034999975, whose nearest double prints as 16952.4026035.
    got, want = both(spark, tmp_path, [(661_112, 68_604), (662_884, 68_604), (8, 68_605), (16, 899_999)])
    assert got == want
    assert dict(x[:2] for x in got)[661_112] == 16952.402603


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Pacific/Apia"])
def test_days_of_any_year_in_any_time_zone(spark, tmp_path, zone):
    keys = [0, 3_768, 2_921_320, 2_921_324, 8_999_996, 104_999_992, -11_576, -700_000, -731_080, -731_204, -800_000, -1_200_000]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, want = both(spark, tmp_path, [(k, 7) for k in keys])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want
    assert {x[0]: x[3] for x in got}[2_921_324] == "10000-01-02"
