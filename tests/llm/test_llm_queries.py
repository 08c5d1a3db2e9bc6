"""Queries of this subpackage with SQL against DuckDB, and the embedding operator against all pairs."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from cellweave.llm import neighbours, queries


def rows_of(frame):
    def plain(v):
        return None if v is None or str(v) in ("<NA>", "nan", "NaT") else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, ([plain(v) for v in row] for row in frame.values.tolist())))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want, got = con.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, small).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == rows_of(want)


def test_near_vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r.label for r in rows]), np.array([r.vec_id for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    component = ids.copy()
    while True:
        new = np.minimum(component, np.where(hit, component[None, :], np.iinfo(np.int64).max).min(1))
        if (new == component).all():
            break
        component = new
    got = {r.vec_id: r for r in neighbours.op9_nn_descent(spark, small).collect()}
    assert len(got) == len(ids)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (n, c, c == i) for i, n, c in zip(ids.tolist(), hit.sum(1).tolist(), component.tolist(), strict=True))
