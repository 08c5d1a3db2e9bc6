"""NN-descent on tight groups of more vectors than a list holds, which only their links to each other join."""

import numpy as np

import pytest
from pyspark.sql import functions as F

from cellweave.llm import neighbours


def tight_groups(n_groups: int, size: int, cosine: float, seed: int = 5) -> np.ndarray:
    """Groups of near copies in a row; the middles of neighbours are `cosine` apart, those of others less."""
    rng = np.random.default_rng(seed)
    plane = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    angle = np.arccos(cosine) * np.arange(n_groups)
    middle = np.cos(angle)[:, None] * plane[0] + np.sin(angle)[:, None] * plane[1]
    return np.repeat(middle, size, 0) + 1e-4 * rng.standard_normal((n_groups * size, 64))


def check(spark, x: np.ndarray):
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.98
    np.fill_diagonal(hit, False)
    rows = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(rows).collect()}
    assert len(got) == n
    assert {r.component_id for r in got.values()} == {0}
    assert [got[k].n_links for k in range(n)] == hit.sum(1).tolist()
    assert [k for k in range(n) if got[k].kept] == [0]


def test_two_tight_groups_are_one_component(spark):
    check(spark, tight_groups(2, 20, 0.985))


def test_a_row_of_tight_groups_is_one_component(spark):
    check(spark, tight_groups(5, 30, 0.985))


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_links_by_blocks(spark, block):
    """Counts of links within components by blocks of any size: a tight group, a row of groups, a cloud, a small one."""
    rng = np.random.default_rng(2)
    cloud = rng.standard_normal(64) + 0.12 * rng.standard_normal((90, 64))
    parts = {1: tight_groups(1, 80, 0.985), 2: tight_groups(4, 20, 0.985, 6), 3: cloud, 4: tight_groups(1, 3, 0.985, 7)}
    rows, want = [], {}
    for component, x in parts.items():
        count = rng.integers(1, 4, len(x))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        hit = unit @ unit.T >= 0.98
        np.fill_diagonal(hit, False)
        for k in range(len(x)):
            rows.append((1000 * component + k, x[k].tolist(), int(count[k]), component))
            want[1000 * component + k] = int(hit[k] @ count)
    table = spark.createDataFrame(rows, "node long, v array<double>, count long, component long")
    got = neighbours._links_in_components(table.drop("component"), table.select("node", "component"), 0.98, block)
    assert {r.node: r.n for r in got.collect() if r.n} == {k: n for k, n in want.items() if n}


def test_a_tight_group_is_never_compared(spark):
    x = tight_groups(1, 200, 0.985)
    table = spark.createDataFrame([(1, k, v, 1, k // 10) for k, v in enumerate(x.tolist())], "component long, node long, v array<double>, count long, block long")
    judged = neighbours._judged(neighbours._cones(table), 0.98)
    assert judged.count() == 20 * 21 // 2 and judged.where("not all").isEmpty()
    assert judged.agg(F.sum("total_a")).first()[0] == 10 * 210
