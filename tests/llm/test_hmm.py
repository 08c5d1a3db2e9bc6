"""The hidden Markov model against sums over all state paths, and counts that don't depend on segments."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import hmm


def model(symbols=5, states=3):
    rng = np.random.default_rng(3)
    share = rng.random(symbols)
    emit, move = share[:, None] * (0.5 + rng.random((symbols, states))), rng.random((states, states))
    return hmm.Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_sums_over_all_paths():
    m, text = model(), np.array([0, 3, 1, 4, 2])
    total = 0.0
    for path in itertools.product(range(3), repeat=len(text)):
        p = m.start[path[0]] * m.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= m.move[path[t - 1], path[t]] * m.emit[text[t], path[t]]
        total += p
    assert np.isclose(hmm.likelihoods(m, text[:, None], np.array([5]))[0], np.log10(total))


def test_counts_do_not_depend_on_segments(monkeypatch):
    m, rng = model(), np.random.default_rng(4)
    texts = [rng.integers(0, 5, n) for n in (17, 17, 9, 1, 30)]
    found = []
    for held in (5, 40, 1 << 18):
        monkeypatch.setattr(hmm, "HELD", held)
        start, move, emit, log = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
        for _, padded, lengths in hmm.batches_of(texts):
            log += hmm.expect(m, padded, lengths, start, move, emit)
        found.append(np.concatenate((start, move.ravel(), emit.ravel(), [log])))
    assert np.allclose(found[0], found[2]) and np.allclose(found[1], found[2])
    assert np.isclose(found[2][:3].sum(), 5) and np.isclose(found[2][12:27].sum(), sum(map(len, texts)))


def test_base_score_and_counts(spark):
    import math
    import re

    rows = [(k, t) for k, t in enumerate(["a b c a", "", None, "B c d", "z z z", "a é a", "new words here", "a b", "q" * 500 + " a", "c"])]
    want, train = {}, Counter()
    for k, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        want[k] = [w for w in words] + [None]
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update(want[k])
    n, v = sum(train.values()), len(train)
    got = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


@pytest.mark.parametrize("n_symbols", [0, 3, 100])
def test_training_and_scores_against_plain_recursions(spark, monkeypatch, n_symbols):
    """Thirty texts, string ids, a word never seen: a plain Baum-Welch over the symbols gives the likelihoods and scores."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(12)]
    rows = [(f"d{k}", " ".join(rng.choice(words, 14, p=np.arange(1, 13) / 78))) for k in range(28)] + [("d28", ""), ("d30", "w1 neverseen w2 neverseen")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 row", "2 symbols", "3 word", "4 c", "5 others")
    kept, train = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *args: kept.append((args, train(*args))) or kept[0][1])
    got = {r.doc_id: r for r in hmm.score_texts(docs, states=3, iterations=4, n_symbols=n_symbols).collect()}
    (_, sizes, n_tail, _, _), (_, logs) = kept[0]
    assert len(logs) == 4 and all(b >= a for a, b in itertools.pairwise(logs))

    texts, held = dict(rows), [i for i, _ in rows if not got[i].held_out]
    seen = Counter(w for i in held for w in texts[i].split())
    hashed = {w: int(next(iter(hmm.texts_to_words(pa.array([w]))))[0]) for w in seen}
    order = sorted(seen, key=lambda w: (-seen[w], hashed[w]))[: len(sizes) - 2]
    assert [seen[w] for w in order] == sizes[:-2].tolist() and len(order) <= n_symbols and n_tail == len(seen) - len(order)
    n_rest = sum(seen.values()) - sum(seen[w] for w in order)
    coded = {i: [order.index(w) if w in order else len(order) + 1 for w in t.split()] + [len(order)] for i, t in rows}
    part = 0.5 + np.random.default_rng(1).random((len(sizes), 3))
    emit = np.array(sizes)[:, None] * part / part.sum(1, keepdims=True)
    start, move = np.ones(3), np.where(np.eye(3, dtype=bool), 0.98, 0.01) * 1e6
    for turn in range(5):
        emit = emit + 1 / 3
        emit[-1] += n_tail / 3
        emit, start, move = emit / emit.sum(0), (start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True)
        alphas = {}
        for i, text in coded.items():
            a = [start * emit[text[0]]]
            for x in text[1:]:
                a.append((a[-1] @ move) * emit[x])
            alphas[i] = a
        if turn == 4:
            break
        new_emit, new_start, new_move, log = np.zeros_like(emit), np.zeros(3), np.zeros((3, 3)), 0.0
        for i in held:
            text, a = coded[i], alphas[i]
            p, beta = a[-1].sum(), np.ones(3)
            log += np.log10(p)
            for t in range(len(text) - 1, -1, -1):
                new_emit[text[t]] += a[t] * beta / p
                if t:
                    new_move += np.outer(a[t - 1], emit[text[t]] * beta) * move / p
                    beta = move @ (emit[text[t]] * beta)
                else:
                    new_start += a[0] * beta / p
        assert np.isclose(log, logs[turn], rtol=1e-5)
        emit, start, move = new_emit, new_start, new_move
    for i, t in rows:
        shares = sum(np.log10((seen[w] + 1) / (n_rest + n_tail + 1)) for w in t.split() if w not in order)
        assert np.isclose(got[i].score, np.log10(alphas[i][-1].sum()) + shares, rtol=1e-4)
    assert got["d30"].n_tokens == 5


def test_without_training_rows(spark):
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    docs = spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")
    for r in hmm.score_texts(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and np.isclose(r.score, 3 * np.log10(0.5)) and r.base_score == 0
