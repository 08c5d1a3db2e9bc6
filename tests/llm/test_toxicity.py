"""The classifier chain against one trained apart, by plain proximal steps in NumPy, with out-of-fold probabilities."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import toxicity

WORDS = [f"plain{k}" for k in range(40)]
BAD = ["idiotic", "stupidly", "moronic"]
JUNK = ["click", "buynow", "zzzz"]


def corpus(n=260):
    rng, docs, labels = random.Random(9), [], []
    for k in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        words = rng.choices(WORDS, k=rng.randint(8, 20)) + (rng.choices(BAD, k=2) if toxic else []) + (rng.choices(JUNK, k=3) if junk else [])
        words += rng.choices(BAD, k=1) if junk and rng.random() < 0.5 else []  # junk holds insults at random
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


def features(text):
    """Words and their beginnings, as sets of (kind, bytes)."""
    words = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())]
    return {("word", w) for w in words} | {(k, w[:k]) for w in words for k in toxicity.STEMS}


def solve(x, dense, y, l1=4e-4, steps=20_000):
    """The weights that minimise the chain's objective: weighted log loss, L1 on scaled binary columns, L2 on dense ones."""
    n, d = x.shape
    scale = 1 / np.sqrt(np.maximum(x.mean(0), 1e-3))
    a = np.hstack((x * scale, dense, np.ones((n, 1))))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    w, step = np.zeros(a.shape[1]), 1 / (0.25 * weight.max() * np.linalg.norm(a, 2) ** 2 / n + 1e-4)
    ridge = np.concatenate((np.zeros(d), np.full(dense.shape[1], 1e-4), [0]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - step * (a.T @ (weight * (p - y)) / n + ridge * w)
        w[:d] = np.sign(w[:d]) * np.maximum(np.abs(w[:d]) - step * l1, 0)
    return lambda x, dense: 1 / (1 + np.exp(-np.clip(np.hstack((x * scale, dense, np.ones((len(x), 1)))) @ w, -30, 30)))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.p_junk, r.p_toxic) for r in toxicity.score_toxicity(table, marks).collect()}
    folds = {r.doc_id: r.fold for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.N_FOLDS)).alias("fold")).collect()}
    return docs, labels, got, folds


def test_chain_against_one_trained_apart(scored):
    docs, labels, got, folds = scored
    held = [features(t) for _, t in docs]
    y = {"junk": np.array([1 - q for _, q, _ in labels], float), "toxic": np.array([t for _, _, t in labels], float)}
    counts = {}
    for h in held:
        for f in h:
            counts[f] = counts.get(f, 0) + 1
    vocabulary = set()
    for c in toxicity.CHAIN:
        share = y[c].mean()
        for f, df in counts.items():
            with_c = sum(y[c][k] for k, h in enumerate(held) if f in h)
            if df >= toxicity.LEAST_DOCS and abs(with_c - df * share) / np.sqrt(df * share * (1 - share)) >= toxicity.LEAST_Z:
                vocabulary.add(f)
    names = sorted(vocabulary, key=repr)
    x, fold, none = np.array([[float(f in h) for f in names] for h in held]), np.array([folds[i] for i, _ in docs]), np.zeros((len(docs), 0))
    out_of_fold = np.zeros(len(docs))
    for j in range(toxicity.N_FOLDS):
        model = solve(x[fold != j], none[fold != j], y["junk"][fold != j])
        out_of_fold[fold == j] = model(x[fold == j], none[fold == j])
    p_junk = solve(x, none, y["junk"])(x, none)
    p_toxic = solve(x, out_of_fold[:, None], y["toxic"])(x, p_junk[:, None])
    mine = np.array([got[i] for i, _ in docs])
    assert np.abs(mine[:, 0] - p_junk).mean() < 0.02 and np.abs(mine[:, 1] - p_toxic).mean() < 0.02
    assert ((mine[:, 1] >= 0.5) == (p_toxic >= 0.5)).mean() > 0.98


def test_decides_well(scored):
    docs, labels, got, _ = scored
    toxic = np.array([t for _, _, t in labels]) > 0
    said = np.array([got[i][1] for i, _ in docs]) >= 0.5
    assert said[toxic].mean() > 0.9 and said[~toxic].mean() < 0.05


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(k, "some words here") for k in range(6)] + [(None, None)], "doc_id long, text string")
    for labels in ([], [(k, 1, 0) for k in range(6)], [(k, None, 1) for k in range(6)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert not any(r.is_toxic for r in toxicity.score_toxicity(docs, table).collect())
        assert toxicity.clean_documents(docs, table).count() == 7
