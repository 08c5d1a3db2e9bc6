"""Importance resampling against dictionaries of features, and CRCs against zlib."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from cellweave.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def by_hand(docs, target, least_words=20):
    """(doc_id, n_words, n_features, weight, score, rank) of each row, in order of rows."""
    own = [(i, *features(t)) for i, t in docs]
    corpus, wanted = collections.Counter(), collections.Counter()
    for _, _, f in own:
        corpus.update(f)
    for t in target:
        wanted.update(features(t)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in rows]


def test_crcs():
    words = [b"", b"a", b"to", b"x" * 63, b"y" * 64, b"z" * 65, b"long" * 5000, "é日本".encode(), b"7"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    crc = resampling.word_crcs(data, start, end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    pairs = [(a, b) for a in range(len(words)) for b in range(len(words))]
    left, right = np.array(pairs).T
    assert resampling.pair_crcs(crc[left], crc[right], (end - start)[right]).tolist() == [zlib.crc32(words[a] + b" " + words[b]) for a, b in pairs]


def test_edges_against_hand(spark):
    words = " ".join(f"W{k % 37}é" for k in range(60))
    rows = [(1, None), (2, ""), (3, "?! ..."), (4, words), (5, words), (5, words), (None, words + " more"), (6, "one two"), (7, "big " * 400_000), (8, "x" * 100_000 + " tail"), (9, words.upper()), *((20 + k, f"{words} {k} and {k * 7}") for k in range(30))]
    target = ["W1é W2é and", None, "", "big news"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' stream", "1 rank", "2 c0", "3 docs", "4 bucket")
    got = resampling.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 doc_id"))
    assert got.columns == ["doc_id", "stream", "c0", "docs", "bucket", *resampling.RESULTS]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[c] for c in ("doc_id", *resampling.RESULTS)) for r in got.collect()), key=key) == sorted(by_hand(rows, target), key=key)
    assert resampling.importance_resample(docs.limit(0), docs.limit(0)).count() == 0
    drawn = resampling.drawn_documents(docs, docs.limit(0))
    assert set(drawn.columns) == set(docs.columns) and all(r.text for r in drawn.collect())


@pytest.mark.parametrize("buckets", [0, 1 << 17])
def test_buckets_of_16_bits(spark, buckets):
    with pytest.raises(ValueError, match="16 bits"):
        resampling.streams(spark.createDataFrame([("a",)], "text string"), buckets)


def test_query(spark, medium):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    want = {r[0]: (r[0], *r[2:]) for r in by_hand(docs, [r.text for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()])}
    got = resampling.op12_importance_resampling(spark, medium).collect()
    assert {r.doc_id: tuple(r) for r in got} == want and len(got) == len(docs)
