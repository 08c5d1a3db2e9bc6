"""Every query of the library that has SQL, against DuckDB on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from cellweave import registry


def rows_of(frame):
    def plain(v):
        return None if v is None or str(v) in ("<NA>", "nan", "NaT") else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, ([plain(v) for v in row] for row in frame.values.tolist())))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want, got = con.execute(registry.SQL[name]).df(), registry.QUERIES[name](spark, small).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert len(want) == len(got) and not math.isnan(len(got))
    assert rows_of(got) == rows_of(want)
