"""Toxicity by a classifier chain: logistic models in sequence, each fed the earlier categories' probabilities.

The first category of the chain is low quality, the second toxicity: junk text is where spurious insult words occur.
Later models train on out-of-fold probabilities of the earlier ones, so that they see them as they are on new text.
Features are which of a bounded vocabulary's words and word beginnings (4, 5 and 6 bytes) a text holds, whole texts
always; beginnings catch a stem that takes many endings. Training takes a bounded sample of
labelled documents (`most_rows`), which is the one bounded thing here; every document is scored.

Defined results: a null or empty text has no features and gets the models' intercepts; labels that are null, or whose
document is missing, are not used; several labels of a document count as the largest; without labelled rows of both
kinds a category's probability is 0 (documents stay); documents are returned row for row with their own columns, of
which score_toxicity replaces those named like its results; several rows of a labelled document are examples of their
own; ids of any type will do; an empty table gives an empty table; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, keep
from .words import ALNUM, hashes, mix, slices, spans

CHAIN = ("junk", "toxic")
N_FOLDS, MOST_ROWS, MOST_WORDS, LEAST_DOCS, LEAST_Z, THRESHOLD = 5, 6_000, 1024, 4, 4.0, 0.5


STEMS = (4, 5, 6)


def held_words(column: pa.Array, vocabulary: np.ndarray | None) -> Iterator[np.ndarray]:
    """For each text its distinct features: sorted places in the sorted vocabulary of hashes, or the hashes themselves."""
    for lo, hi, data, offsets in slices(column):
        start, end, bounds = spans(data, offsets, ALNUM)
        kinds = [hashes(data, start, end), *(mix(hashes(data, start, np.minimum(end, start + k)), k) for k in STEMS)]
        words, bounds = np.stack(kinds, 1).ravel(), bounds * len(kinds)
        if vocabulary is None:
            for k in range(hi - lo):
                yield np.unique(words[bounds[k] : bounds[k + 1]])
            continue
        at = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
        known = np.flatnonzero(vocabulary[at] == words) if len(vocabulary) else np.zeros(0, np.int64)
        place, cut = at[known], np.searchsorted(known, bounds)
        for k in range(hi - lo):
            yield np.unique(place[cut[k] : cut[k + 1]])


def fit_logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_cols: int, l1: float = 4e-4, steps: int = 200) -> np.ndarray:
    """Weights of n_cols binary features, the dense columns and the intercept, by FISTA; L1 on the binary ones.

    rows, cols: which features are on in which example. Nesterov steps of a fixed length from a bound of the curvature.
    """
    n, extra = len(y), dense.shape[1]
    w = np.zeros(n_cols + extra + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    df = np.bincount(cols, minlength=n_cols)
    scale = 1 / np.sqrt(np.maximum(df / n, 1e-3))  # rare words move as fast as common ones
    v, before, t = w.copy(), w.copy(), 1.0
    per_row = np.bincount(rows, weights=scale[cols] ** 2, minlength=n) + (dense**2).sum(1) + 1
    step = 4 / np.sqrt(np.mean(per_row**2))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    for _ in range(steps):
        z = np.bincount(rows, weights=(v[:n_cols] * scale)[cols], minlength=n) + dense @ v[n_cols:-1] + v[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.concatenate((np.bincount(cols, weights=g[rows], minlength=n_cols) * scale, dense.T @ g + 1e-4 * v[n_cols:-1], [g.sum()]))
        w = v - step * grad
        w[:n_cols] = np.sign(w[:n_cols]) * np.maximum(np.abs(w[:n_cols]) - step * l1, 0)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, before, t = w + (t - 1) / ahead * (w - before), w, ahead
    w[:n_cols] *= scale
    return w


def _labelled(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """doc_id, text and a 0/1 column for each category, for at most most_rows documents, chosen by hash."""
    good = labels.where("doc_id is not null and quality is not null and toxic is not null")
    good = good.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("junk"), F.max("toxic").cast("int").alias("toxic"))
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most_rows bounds what is broadcast


def train_chain(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, n_folds: int = N_FOLDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vocabulary (sorted word hashes) and each category's weights."""
    spark = docs.sparkSession
    sample = _labelled(docs, labels, most_rows)
    id_ = docs.schema["doc_id"].dataType.simpleString()

    def texts_to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w.view(np.int64) for w in held_words(b.column(1), None)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "junk", "toxic", "words"])

    sample = keep(sample.mapInArrow(texts_to_words, f"doc_id {id_}, junk int, toxic int, words array<long>"), "labelled")
    # Words whose presence goes with a category, by the z score of its share among the documents that hold them.
    base = sample.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in CHAIN]).first()
    if not base["n"]:
        drop(sample)
        return np.zeros(0, np.uint64), []
    by_word = keep(sample.select("junk", "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in CHAIN]).where(F.col("df") >= LEAST_DOCS), "words")
    kept: set[int] = set()
    for c in CHAIN:
        share = min(max(float(base[c]), 1e-9), 1 - 1e-9)
        z = F.abs(F.col(c) - F.col("df") * F.lit(share)) / F.sqrt(F.col("df") * F.lit(share * (1 - share)))
        kept |= {r.word for r in by_word.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(MOST_WORDS).select("word").collect()}
    vocabulary = np.sort(np.array(list(kept), np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(vocabulary)

    def to_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            places = []
            for words in b.column(3):
                w = np.asarray(words.values).view(np.uint64)
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                places.append(np.sort(at[known[at] == w]).astype(np.int32) if len(known) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "junk", "toxic", "places"])

    rows = sample.mapInArrow(to_places, f"doc_id {id_}, junk int, toxic int, places array<int>").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(n_folds)).cast("int"))
    rows = keep(rows, "features")
    drop(sample, by_word)
    weights: list[np.ndarray] = []
    folds: list[np.ndarray] = []  # for each category, a model without each fold
    for k, category in enumerate(CHAIN):
        earlier = spark.sparkContext.broadcast(folds[:])

        # Model j < n_folds is trained without fold j, model n_folds on all; each is one group of at most most_rows rows.
        models = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(n_folds)))).where("model <> fold")
        fitted = {r.model: np.array(r.w) for r in models.groupBy("model").applyInArrow(_fitter(k, category, earlier, shared), "model int, w array<double>").collect()}
        earlier.destroy()
        weights.append(fitted[n_folds])
        folds.append(np.array([fitted.get(j, fitted[n_folds]) for j in range(n_folds)]))
    drop(rows)
    shared.destroy()
    return vocabulary, weights


def _fitter(k: int, category: str, earlier, vocabulary):
    """What trains one model of category k on the examples of one group."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        places, fold, y = table.column("places").combine_chunks(), np.asarray(table.column("fold")), np.asarray(table.column(category)).astype(float)
        at = np.repeat(np.arange(len(y)), np.diff(np.asarray(places.offsets)))
        cols, n_cols = np.asarray(places.flatten()), len(vocabulary.value)
        dense = np.zeros((len(y), 0))
        for models in earlier.value[:k]:  # out of fold: each example by the model that has not seen its fold
            dense = np.column_stack((dense, logits(at, cols, dense, models[fold], n_cols)))
        if y.size and 0 < y.mean() < 1:
            w = fit_logistic(at, cols, dense, y, n_cols)
        else:
            w = np.zeros(n_cols + k + 1)
            w[-1] = 30.0 if y.size and y.mean() == 1 else -30.0
        return pa.table({"model": table.column("model")[:1], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    return fit


def logits(at: np.ndarray, cols: np.ndarray, dense: np.ndarray, w: np.ndarray, n_cols: int) -> np.ndarray:
    """Probabilities, of examples with a model each (w has a row an example) or with one for all."""
    n, w = len(dense), np.atleast_2d(w)
    each = np.arange(n) if len(w) > 1 or n == 1 else np.zeros(n, int)
    each = each if len(w) > 1 else np.zeros(n, int)
    z = np.bincount(at, weights=w[each[at], cols], minlength=n) if len(cols) else np.zeros(n)
    return 1 / (1 + np.exp(-np.clip(z + (w[each, n_cols:-1] * dense).sum(1) + w[each, -1], -30, 30)))


MARKS = [T.StructField("p_junk", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("is_toxic", T.BooleanType())]


def _scored(docs: DataFrame, text: str, chain: tuple[np.ndarray, list[np.ndarray]], threshold: float) -> DataFrame:
    """docs with p_junk, p_toxic and is_toxic of the column `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    own = [k for k, n in enumerate(docs.columns) if n not in {m.name for m in MARKS}]
    schema = T.StructType([docs.schema[k] for k in own] + MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        for b in batches:
            held = list(held_words(b.column(b.num_columns - 1), vocabulary))
            at, cols = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
            p = np.zeros((len(held), 0))
            for w in weights:
                p = np.column_stack((p, logits(at, cols, p, w, len(vocabulary))))
            p = p if weights else np.zeros((len(held), len(CHAIN)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= threshold)], schema.names)

    base = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return base.select(*[f"c{k}" for k in own], F.col(f"c{docs.columns.index(text)}").alias("scanned")).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """docs with p_junk, p_toxic and is_toxic (p_toxic >= threshold)."""
    return _scored(docs, "text", train_chain(docs, labels, **params), threshold)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """docs without those that the chain finds toxic; their columns go by other names through the scan."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    scored = _scored(docs.toDF(*names), names[docs.columns.index("text")], train_chain(docs, labels, **params), threshold)
    return scored.where("not is_toxic").select(*names).toDF(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "p_junk", "p_toxic", "is_toxic")


SQL: dict[str, str] = {}
