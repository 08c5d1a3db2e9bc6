"""The pipeline's stages against brute force, with the user's columns and their values kept."""

import re

import numpy as np
import pytest

from cellweave.llm import mixing, toxicity, words

from test_edges import leaks
from test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text):
    """Words and their beginnings of 4, 5 and 6 bytes, told apart by kind, by plain Python."""
    out = set()
    for w in ALNUM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        out |= {(0, w), *((k, w[:k]) for k in toxicity.STEMS)}
    return out


def hashed(feature):
    kind, word = feature
    h = words.hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    return int((words.mix(h, kind) if kind else h)[0])


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "concat('n', doc_id) n_words", "concat('t', doc_id) p_toxic", "concat('c', doc_id) class", "concat('m', doc_id) mix", "concat('x', doc_id) c0")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        out.append(docs.collect())
    return out


def test_own_columns_keep_their_values(stages):
    for rows in stages:
        assert rows and all((r.n_words, r.p_toxic, r["class"], r.mix, r.c0) == tuple(f"{x}{r.doc_id}" for x in "ntcmx") for r in rows)
    assert [set(r.asDict()) for r in (stages[3][0], stages[0][0])] == [set(stages[0][0].asDict())] * 2


def test_toxicity_is_the_chain(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    vocabulary, weights = toxicity.train_chain(docs, labels)
    places = {int(h): k for k, h in enumerate(vocabulary)}
    kept = []
    for r in stages[0]:
        own, p = sorted({places[h] for h in map(hashed, features(r.text)) if h in places}), []
        for w in weights:
            z = sum(w[k] for k in own) + sum(a * b for a, b in zip(w[len(places) : -1], p, strict=True)) + w[-1]
            p.append(1 / (1 + np.exp(-max(-30, min(30, z)))))
        if p[1] < toxicity.THRESHOLD:
            kept.append(r.doc_id)
    assert sorted(kept) == sorted(r.doc_id for r in stages[1])
    true = {r.doc_id: r.toxic for r in labels.collect()}
    said = {r.doc_id for r in stages[0]} - set(kept)
    assert sum(true[i] == (i in said) for i in true) >= 0.9 * len(true)


def test_one_document_of_each_group_stays(stages):
    groups = brute([(r.doc_id, r.text) for r in stages[1]])
    assert sorted(r.doc_id for r in stages[2]) == sorted(i for i, (n, c) in groups.items() if n == 0 or c == i)


def test_no_leak_stays(spark, small, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = [r.doc_id for r in stages[2] if leaks(r.text, items)[1] == 0]
    assert sorted(r.doc_id for r in stages[3]) == sorted(want)


def test_mix_takes_targets(spark, stages):
    sizes, taken = {}, {}
    for rows, out, count in ((stages[3], sizes, lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), (stages[4], taken, lambda r: r.mix_words)):
        for r in rows:
            out[r.source] = out.get(r.source, 0) + count(r)
    total, left, target = sum(sizes.values()), set(sizes), {}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        rest = total - sum(3 * sizes[s] for s in sizes if s not in left)
        each = rest / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * each > 3 * sizes[s]}
        if not over:
            break
        left -= over
    target = {s: weight[s] * each if s in left else 3 * sizes[s] for s in sizes}
    assert taken.keys() <= target.keys() and all(abs(taken.get(s, 0) - t) <= 1 for s, t in target.items())


def test_mix_of_equal_rows_loses_none(spark):
    """Ten equal rows in each of two sources give what the mix takes, however little that is."""
    rows = [(None, "w x y", s) for s in "ab" for _ in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in mixing.mixed_documents(docs, weights=(1, 19)).collect():
        got.setdefault(r.source, []).append(r.mix_words)
    assert sum(got["a"]) == 3 and sum(got["b"]) == 57 and len(got["b"]) == 10
