"""The order of a search from the middle, against the search itself."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from cellweave.functions import search

WAYS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]


@pytest.mark.parametrize(("ways", "turn"), [(8, search.turn_of_8), (4, search.turn_of_4)])
@pytest.mark.parametrize("middle", [(4, 4), (0, 3), (8, 1)])
def test_turns(spark, ways, turn, middle):
    size, seen, order, queue = 9, set(), [], deque([middle])
    while queue:
        cell = queue.popleft()
        if cell in seen:
            continue
        seen.add(cell)
        order.append(cell)
        queue += [(cell[0] + dr, cell[1] + dc) for dr, dc in WAYS[:ways] if 0 <= cell[0] + dr < size and 0 <= cell[1] + dc < size]
    cells = spark.createDataFrame([(r, c) for r in range(size) for c in range(size)], "r int, c int")
    got = cells.orderBy(turn(F.col("r") - middle[0], F.col("c") - middle[1])).collect()
    assert [tuple(x) for x in got] == order
