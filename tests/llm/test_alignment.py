"""Alignment of tokenizers against a walk over both token lists, text by text."""

import collections
import hashlib
import random

import pytest
import sentencepiece
import tokenizers

from cellweave.llm import alignment

LETTERS = alignment._letters()


@pytest.fixture(scope="module")
def plain():
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


def walk(texts, plain):
    """What align_tokenizers gives for each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    first, links, counts = [], [], collections.Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a, b = (f(t) if t else [] for f in plain)
        if not t or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            first.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        own, groups, x, y, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
        while x < len(a):
            own.append((a[x][0], b[y][0]))
            end_a, end_b = at_a + len(a[x][1]), at_b + len(b[y][1])
            if end_a <= end_b:
                ga.append(str(a[x][0]))
                x, at_a = x + 1, end_a
            if end_b <= end_a:
                gb.append(str(b[y][0]))
                y, at_b = y + 1, end_b
            if end_a == end_b:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        first.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        counts.update(own)
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(*f[:4], sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), f[4]) for f, own in zip(first, links, strict=True)]


TEXTS = [None, "", " ", "<|endoftext|> and <s></s><unk>", "a▁b", "\x00a", " " * 5000 + "x", "a" * 50_000, "\n" * 3000, "é😀 ﬁ Ａ日本", "same text twice", "same text twice", "word " * 30_000, "\r\n\t don't I'll 1234567 __init__"]


@pytest.mark.parametrize("hot_pairs", [1 << 18, 5])
def test_against_walk(spark, plain, hot_pairs):
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "'x' n_a", "1 links", "2 _key", "3 pair", "4 more", "5 c0")
    got = {r.doc_id: r for r in alignment.align_tokenizers(docs, hot_pairs=hot_pairs).collect()}
    assert len(got) == len(TEXTS)
    for k, want in enumerate(walk(TEXTS, plain)):
        r = got[k or None]
        assert tuple(r[c] for c in alignment.RESULTS) == want, TEXTS[k]
        assert (r.links, r["_key"], r.pair, r.more, r.c0) == (1, 2, 3, 4, 5)
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0


def test_groups_themselves(spark):
    docs = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    row = alignment.aligned(docs, groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count("|") == row.n_groups


def test_fast_and_slow_encoders_agree():
    """Texts of spaces, marks, contractions, digits and letters of many kinds, and every 97th code point."""
    tools = alignment._tools(open(alignment.BYTE_BPE, "rb").read(), open(alignment.PIECES, "rb").read())
    rng, pool = random.Random(3), "\t\n\r \xa0\x85\u200b\u2028\u3000\u1680'stLl.1\xb2\u0661Aa\u0301\U0001f600\ufe0f\u200d\u4e00\xe9"
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 24))) for _ in range(2000)]
    texts += [f"ab{chr(c)}cd {chr(c)}e 1{chr(c)}2  {chr(c)}{chr(c)}" for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    assert all(tools.encode_a(t) == tools.slow.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_splitter_that_gives_up(plain):
    tools = alignment._tools(open(alignment.BYTE_BPE, "rb").read(), open(alignment.PIECES, "rb").read())
    assert sum(len(tools.a_bytes[0][tools.a_bytes[1][i] :][: tools.a_bytes[2][i]]) for i in tools.encode_a(" " * 1_200_000 + "x")) == 1_200_002


def test_query(spark, small, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], walk([r.text for r in docs], plain), strict=True))
    got = alignment.op11_tokenizer_alignment(spark, small).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)
