"""The pipeline over tables without rows, without labels or benchmark, with nulls, repeats and clashing columns."""

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 97}" for k in range(50_000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, "some plain words that make a short text of their own", None, "a", 5),
    (4, "some plain words that make a short text of their own", "de", None, 5),
    (5, LONG, "en", "b", 9),
    (6, LONG + " and a little more", "en", "b", 9),
    (None, "a text without an id stays as any other does", "fr", "c", 1),
    (7, "an item of the benchmark that is held whole by this text as a leak", "en", "c", 1),
]


@pytest.fixture
def tables(spark, tmp_path):
    def write(docs, labels, bench, more=""):
        table = spark.createDataFrame(docs, DOCS)
        table = table.selectExpr("*", "'mine' AS _scanned", "1 AS slot", "2 AS mix_words") if more else table
        table.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return f"file://{tmp_path}"

    return write


def test_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables([], [], [])).count() == 0


def test_no_labels_and_no_benchmark(spark, tables):
    got = corpus_pipeline.run(spark, tables(ROWS, [], []))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    # Texts without words give the mix nothing; of copies one stays.
    assert {r.doc_id for r in got.collect()} == {3, 5, 7, None}


def test_labels_and_benchmark_of_odd_rows(spark, tables):
    labels = [(1, 1, 0), (3, 1, 0), (None, 0, 1), (99, 0, 1), (5, None, None)]
    bench = [("x", "an item of the benchmark that is held whole by this text"), ("y", None), (None, ""), ("x", "an item of the benchmark that is held whole by this text")]
    got = corpus_pipeline.run(spark, tables(ROWS, labels, bench, "more"))
    rows = got.collect()
    assert {r.doc_id for r in rows} == {3, 5, None} and all(r["_scanned"] == "mine" and r.slot == 1 for r in rows)
