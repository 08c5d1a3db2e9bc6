"""Components of one task's edges, and of many tasks', against a plain union of sets."""

import random

import pytest

from cellweave.llm import graph


def brute(edges):
    least = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.mark.parametrize("batch", [1 << 20, 40])
def test_components(spark, monkeypatch, batch):
    monkeypatch.setattr(graph, "BATCH", batch)
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(30)] + [(100, 101 + k) for k in range(40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    edges += [(7, 7), (900, 900), (None, 3), (5, None), (-4, 30), (100, 101)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = brute(edges)
    assert {x.node: x.component for x in graph.components(table).collect()} == want
    more = [(2, 150), (500, 501)]
    labels = graph.relabelled(graph.relabelled(None, table), spark.createDataFrame(more, "a long, b long"))
    assert {x.node: x.component for x in labels.collect()} == brute(edges + more)
    assert graph.components(table.limit(0)).count() == 0
