"""Columns that bear the operators' own names, and long, null, empty, equal and repeated texts, through every operator that
returns rows with their columns."""

import pytest

from cellweave.llm import alignment, decontaminate, html_text, licenses, mixing, resampling, toxicity

TEXTS = ["MIT or not: fine words here", "MIT or not: fine words here", None, "", "word and word again " * 60_000, "stupid idiot words that are bad", "short item é"]
#: Names of columns inside the operators, and of their results.
NAMES = ("scanned", "_scanned", "_n", "_units", "_dir", "c0", "c1", "c2", "above", "said", "near", "distance", "docs", "stream", "slot", "s", "a", "_key", "pair", "links", "rank", "_at", "weight", "n_hit", "p_toxic", "declared", "m")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k if k < 6 else 5, t, f"src/{k % 2}/f{k}.py", f"s{k % 3}") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, source string")
    docs = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 0, 0), (5, 0, 1), (5, 0, 1), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("i", "short item é"), (None, None), ("j", "")], "item_id string, text string")
    return docs, labels, bench


OPERATORS = {
    "op1": (lambda d, labels, bench: licenses.scan_licenses(d), set(licenses.RESULTS) | {"text"}),
    "op1 declared": (lambda d, labels, bench: licenses.declared(d), set(licenses.RESULTS) | {"text"}),
    "op2": (lambda d, labels, bench: mixing.mixed_documents(d), set()),
    "op4": (lambda d, labels, bench: decontaminate.find_leaks(d, bench), set(decontaminate.FOUND.names)),
    "op4 clean": (lambda d, labels, bench: decontaminate.clean_documents(d, bench), set()),
    "op5": (lambda d, labels, bench: toxicity.score_toxicity(d, labels), {"p_junk", "p_toxic", "is_toxic"}),
    "op5 clean": (lambda d, labels, bench: toxicity.clean_documents(d, labels), set()),
    "op7": (lambda d, labels, bench: html_text.extract(d.withColumnRenamed("text", "html")), {"text", "n_chars"}),
    "op11": (lambda d, labels, bench: alignment.align_tokenizers(d), set(alignment.RESULTS) | {"text"}),
    "op12": (lambda d, labels, bench: resampling.importance_resample(d, bench), set(resampling.RESULTS) | {"text"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_names_keep_their_values(tables, name):
    docs, labels, bench = tables
    run, replaced = OPERATORS[name]
    out = run(docs, labels, bench)
    kept = [n for n in NAMES if n not in replaced]
    assert set(kept) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert all(r[n] == n for r in rows for n in kept)
    whole = "clean" not in name and name != "op2"
    assert sorted(r.path for r in rows) == sorted(f"src/{k % 2}/f{k}.py" for k in range(len(TEXTS))) if whole else 0 < len(rows) <= len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(tables, name):
    docs, labels, bench = tables
    run, _ = OPERATORS[name]
    assert run(docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0


def test_tags(spark):
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "SPDX-License-Identifier: GPL-2.0-only", "# SPDX-License-Identifier: Zlib\nx = 1", "/* SPDX-License-Identifier: Apache-2.0 */"]
    docs = spark.createDataFrame([(k, f"a{k}/LICENSE.txt" if k == 1 else f"a{k}/x.c", t) for k, t in enumerate(texts)] + [(9, "a1/deep/y.c", "int y;")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.declared, r.license, r.inherited_from) for r in licenses.scan_licenses(docs).collect()}
    assert got.pop(2)[0] in (None, "NOASSERTION")  # an identifier without a template is no other licence
    assert got == {0: ("MIT", "MIT", None), 1: ("GPL-2.0", "GPL-2.0", None), 3: ("Apache-2.0", "Apache-2.0", None), 9: (None, "GPL-2.0", "a1")}


def test_automaton_of_a_large_benchmark():
    """Windows of 200,000 distinct words: two states for each word of a window at most."""
    words = [f"w{k}" for k in range(200_000)]
    machine = decontaminate.Machine([(str(k), " ".join(words[k : k + 10])) for k in range(0, len(words), 50)], 10)
    assert machine.states.get_stats()["nodes_count"] <= 20 * 4000 + 1
    assert machine.matches([b"x", *(w.encode() for w in words[150_000:150_012]), b"y"]) == [(1, 10, "150000")]
