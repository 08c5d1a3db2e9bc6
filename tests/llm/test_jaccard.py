"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

from cellweave.llm import jaccard

SCHEMA = "doc_id long, text string, class string, source string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """{doc_id: (n_shingles, component_id)} by comparing every pair of distinct sets that share a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    holders = {}
    for i, own in sets:
        for g in own:
            holders.setdefault(g, set()).add(i)
    by_id = dict(sets)
    for i, own in sets:
        for j in {x for g in own for x in holders[g] if x > i}:
            n = len(own & by_id[j])
            if 100 * n >= 75 * (len(own) + len(by_id[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(own), find(i)) for i, own in sets}


def result(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.document_components(docs).collect()}


def test_driver_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_groups_of_near_copies(spark):
    """Copies of copies at about the threshold, exact copies and passages that many texts share."""
    rng = random.Random(5)
    shared = " ".join(f"p{k}" for k in range(12))
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(60):
            text = base[:]
            for _ in range(rng.randrange(4)):
                text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                base = text
            rows.append((len(rows), " ".join(text) + (" " + shared if rng.random() < 0.3 else "")))
    rows += [(len(rows) + k, rows[k * 3][1]) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "k", None) for i, t in rows], SCHEMA)
    assert result(docs) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, " \n\t"), (7, "ä " * 30), (8, "ä " * 50), (9, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert result(docs) == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (1, 9)}
    assert jaccard.document_components(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, None), (3, None), (4, "x y z"), (None, "only null ids here now")]
    docs = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], SCHEMA)
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("1", "a b c d e f"), ("3", ""), ("3", ""), ("4", "x y z"), ("None", "only null ids here now")]


def test_divide_skip_counts():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    query = sets[0]
    least = np.array([jaccard.required(np.int64(len(s)), np.int64(len(query))) for s in sets])
    got = jaccard.t_occurrence(query, np.concatenate(sets), np.repeat(np.arange(30), [len(s) for s in sets]), least)
    overlap = np.array([len(np.intersect1d(s, query)) for s in sets])
    assert (got == np.where(overlap >= least, overlap, 0)).all()
