"""Reply trees with branches against a recursion."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.llm import chat


def trees():
    """Rows (conv, node, parent, role, text, score): combs, stars, random trees, orphans, parents that come later, ties."""
    rng, rows = random.Random(4), []
    for k in range(60):  # a comb: a chain whose every turn also has a reply that ends there
        rows.append(("comb", 2 * k, 2 * k - 2 if k else None, "user" if k % 2 else "assistant", f"chain {k}", 0.5))
        rows.append(("comb", 2 * k + 1, 2 * k, "assistant", f"tooth {k}", float(k % 3)))
    rows += [("star", 0, None, "user", "middle", 1.0), *(("star", k, 0, "assistant", f"ray {k}", 2.0) for k in range(1, 9))]
    for k in range(40):
        rows.append(("random", k, rng.randrange(k) if k and rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["a<b", "[INST]", "\\l", "", None, "é\n"]), rng.choice([-1.0, 0.25, 3.0])))
    rows += [("orphans", 5, 3, "user", "its parent is missing", 1.0), ("orphans", 6, 6, "user", "its own parent", 0.0), ("orphans", 7, 9, "assistant", "its parent comes later", 4.0), ("orphans", 9, 5, "assistant", "a reply", 1.0)]
    return rows


def by_recursion(rows):
    """{conv: [(leaf, total, [(role, text) from the root])]}, best branch first."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        up = {n: r[2] for n, r in own.items() if r[2] is not None and r[2] in own and r[2] < n}

        def path(n, own=own, up=up):
            return ([*path(up[n])] if n in up else []) + [own[n]]

        leaves = [n for n in own if n not in up.values()]
        found = [(n, sum(r[5] for r in path(n)), [(r[3], r[4] or "") for r in path(n)]) for n in leaves]
        out[conv] = sorted(found, key=lambda x: (-x[1], x[0]))
    return out


@pytest.mark.parametrize("branches", [1, 3, None])
def test_branches_against_recursion(spark, branches):
    rows, want = trees(), by_recursion(trees())
    nodes = spark.createDataFrame(rows, "conv string, node long, parent long, role string, text string, score double").withColumn("conv_id", F.col("conv")).withColumn("text", F.coalesce("text", F.lit("")))
    got = chat.format_trees(nodes, branches).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(got) == sum(len(v[:branches]) for v in want.values())
    for r in got:
        leaf, _, turns = want[r.conv_id][r["rank"] - 1]
        assert (r.leaf, [tuple(t) for t in r.turns]) == (leaf, turns)
        said = [chat_text for role, chat_text in turns if role == "assistant"]
        assert len(r.loss_spans) == len(said)
        for span, text in zip(r.loss_spans, said, strict=True):
            written = r.formatted[span.start : span.end]
            for plain, mark in reversed(chat.ESCAPES):
                written = written.replace(mark, plain)
            assert written == text


def test_only_chosen_branches_meet_their_texts(spark):
    """A long text at the root of many branches is joined to the chosen one alone."""
    rows = [("c", 0, None, "user", "x" * 1000, 0.0), *(("c", k, 0, "assistant", "y", float(k)) for k in range(1, 200))]
    nodes = spark.createDataFrame(rows, "conv string, node long, parent long, role string, text string, score double").withColumn("conv_id", F.lit(1))
    got = chat.format_trees(nodes, 1).collect()
    assert [(r.leaf, r["rank"], len(r.formatted) > 1000) for r in got] == [(199, 1, True)]
