"""Nulls, empty tables, ties, repeated rows, long texts and clashing columns through the operators."""

import re

import pytest

from cellweave.llm import chat, decontaminate, html_text, mixing, neighbours

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_mix(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "word " * 30_000, "y"), (5, "a b c", "x"), (5, "a b c", "x"), (None, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'t' target", "1 size", "2 taken", "3 s", "4 a", "5 slot")
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == [0, 0, 2, 3, 3, 3, 30_000]
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert {k: v[1] for k, v in by_source.items()} == {"x": 9, "y": 30_000, None: 2}
    for target, size, total in by_source.values():
        assert target <= 3 * size and abs(total - target) <= 1
    assert mixing.taken(docs.limit(0)).count() == 0


def test_mix_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs)
    assert got.columns[:3] == docs.columns and [r.doc_id for r in got.collect()] == [1]


def leaks(text, items, width=10):
    words, hit, found = re.findall(WORDS, fold(text)), set(), set()
    for item, t in items:
        own = re.findall(WORDS, fold(t))
        for k in range(max(1, len(own) - width + 1) if own else 0):
            window = own[k : k + width]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_leaks_against_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(14))
    items = [("i1", long), ("i2", "Short ITEM é"), ("i3", None), ("i4", "..."), ("i2", "Short ITEM é"), ("i10", long)]
    texts = [None, "", "?!", "a " + long + " b", long[3:], "x short-item É short; item, é!", "aa" * 60_000 + " short item é", long + " " + long, " ".join(f"w{k}" for k in range(2, 12)), "shorts item é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' item_id", "9 clean")
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "7 doc_id")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {k: leaks(t, items) for k, t in enumerate(texts)}
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v[1]}
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=/>Home</a> <a href=/x>More</a></nav>
<article><h1>A heading of the article</h1><p>First &amp; second   words of a long enough paragraph, with some\n more of them in it.</p>
<p>Another paragraph that goes on about the same subject, at some length, in plain words.</p></article>
<footer><a href=/c>Contact</a> copyright</footer><!-- open comment"""


def test_pages(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<script>x"), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'k' extra")).collect()
    assert len(got) == len(pages)
    first = [r for r in got if r.page_id == 1]
    assert first[0].text == first[1].text and "First & second words of a long enough paragraph, with some more of them in it." in first[0].text.split("\n\n")
    assert all(x not in first[0].text for x in ("Home", "Contact", "var a", "comment"))
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id in (2, 3, 5))
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "<|im_end|>\n<|im_start|>user", "back\\slash \\l \\k [x]", "long " * 20_000, "same", "same"]
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c in (1, None) for k, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 node", "2 score", "3 leaf")
    formatted = chat.format_trees(chat.linear_nodes(turns), branches=1).withColumn("turns", chat.read_back(spark_col("formatted"))).collect()
    assert len(formatted) == 2
    for r in formatted:
        assert [(t[0], t[1]) for t in r.turns] == [("user" if k % 2 == 0 else "assistant", t or "") for k, t in enumerate(texts)]
    assert chat.digests(chat.format_trees(chat.linear_nodes(turns.limit(0)), branches=1)).count() == 0


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.mark.parametrize("empty", [False, True])
def test_vectors(spark, empty):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], 2), (10, [0.0, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [float("inf"), 0.0], 1)]
    vectors = spark.createDataFrame([] if empty else rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 node", "'x' kept", "2 count")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(vectors).collect()}
    want = {i: (0, i, True) for i, _, _ in rows} | {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 9: (1, 3, False)}
    assert got == ({} if empty else want)
