"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target's texts.

Each run of 1 to 2 words falls into one of 10,000 buckets by its CRC. Documents become packed streams of uint16 buckets
with document offsets, written once; counts come from streams that are sorted and run-length encoded piece by piece, and
from sums of those runs over all pieces. A bucket's gain is the log of its smoothed share in the target over that in the
corpus; a document's weight is the mean of the gains that its stream gathers. Gumbel noise from a hash of the document's
id makes the highest scores a draw without replacement.

Defined results: a null or wordless text has no features, weight 0 and is never drawn, nor is one of fewer words than
`least_words`; ids that are null hash as an empty id and come last among ties; rows that repeat an id are rows of their
own with the same noise; an empty corpus gives an empty table; an empty target gives gains of the smoothing alone; a word
or text of any length counts whole; other columns are kept, those named like results (n_words, n_features, weight, score,
rank) are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import ranked
from .scratch import drop, keep
from .words import ALNUM, slices, spans

BUCKETS, SEED, PERCENT, LEAST_WORDS, SCALE = 10_000, 7, 25, 20, 1000
#: Bytes of text in a packed stream, unless one text alone is longer; words of more bytes than these go one by one.
PACKED, LONG_WORD = 1 << 21, 64
RESULTS = ("n_words", "n_features", "weight", "score", "rank")

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FULL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """CRC-32 of a byte with the reversed polynomial of zip files."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


_TABLE = _byte_table()


def _shift_tables(bits: int = 40) -> list[np.ndarray]:
    """For each k, four tables (one a byte of a CRC) of that CRC moved on by 2^k zero bytes: a linear map, so its square
    is itself read through itself."""
    byte = np.arange(256, dtype=np.uint32)
    one = np.stack([_TABLE[byte]] + [byte << np.uint32(8 * (k - 1)) for k in (1, 2, 3)])
    out = [one]
    while len(out) < bits:
        last = out[-1]
        out.append(_apply(last, last.ravel()).reshape(4, 256))
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


_SHIFTS = _shift_tables()


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of the folded bytes: byte after byte over all words that go on, longest words first."""
    length = end - start
    out = np.zeros(len(start), np.uint32)
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]])
    short = np.flatnonzero(length <= LONG_WORD)
    order = short[np.argsort(-length[short].astype(np.int16), kind="stable")]
    first, size = start[order], length[order]
    crc = np.full(len(order), _FULL, np.uint32)
    going = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # words longer than k
    for k, n in enumerate(going.tolist()):
        crc[:n] = _TABLE[(crc[:n] ^ data[first[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc ^ _FULL
    return out


def pair_crcs(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of left word, space, right word, from the words' own and the right word's length in bytes."""
    crc = left ^ _FULL
    crc = (_TABLE[(crc ^ np.uint32(32)) & 255] ^ (crc >> np.uint32(8))) ^ _FULL
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        at = np.flatnonzero((length >> k) & 1)
        crc[at] = _apply(_SHIFTS[k], crc[at])
    return crc ^ right


def bucket_stream(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and the buckets of all features, text after text."""
    folded = _FOLDED[data]
    start, end, bounds = spans(folded, offsets, ALNUM)
    words = np.diff(bounds)
    features = np.maximum(2 * words - 1, 0)
    crc = word_crcs(folded, start, end)
    row = np.repeat(np.arange(len(words)), words)
    # A word stands at twice its number, less one for each text with words before its own; its pair stands behind it.
    at = 2 * np.arange(len(crc)) - (np.cumsum(words > 0) - (words > 0))[row]
    together = np.flatnonzero(row[1:] == row[:-1])
    out = np.zeros(int(features.sum()), np.uint16)
    out[at] = crc % np.uint32(buckets)
    out[at[together] + 1] = pair_crcs(crc[together], crc[together + 1], (end - start)[together + 1]) % np.uint32(buckets)
    return words, features, out


def streams(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """A row for each piece of the corpus: docs (the other columns of its documents as structs), n_words and n_features of
    each, and stream, their features' buckets as packed uint16."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed into 16 bits")
    names = [c for c in docs.columns if c != text]
    row = T.StructType([docs.schema[c] for c in names])
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("docs", T.ArrayType(row)), T.StructField("n_words", longs), T.StructField("n_features", longs), T.StructField("stream", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.StructArray.from_arrays(b.columns[:-1], fields=[b.schema.field(k) for k in range(len(names))])
            for lo, hi, data, offsets in slices(b.column(len(names)), PACKED):
                words, features, stream = bucket_stream(data, offsets, buckets)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(rows.slice(lo, hi - lo)), one(pa.array(words, pa.int64())), one(pa.array(features, pa.int64())), pa.array([stream.astype("<u2").tobytes()], pa.binary())], schema.names)

    return docs.select(*names, F.col(text)).mapInArrow(run, schema)


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all streams hold in each bucket; each task sends a row for each bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for piece in b.column(0):
                stream = np.sort(np.frombuffer(piece.as_buffer(), "<u2"), kind="stable")  # a radix sort
                if len(stream):
                    first = np.flatnonzero(np.concatenate(([True], stream[1:] != stream[:-1])))
                    total[stream[first]] += np.diff(np.concatenate((first, [len(stream)])))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Of each bucket the floor of scale times the log of its smoothed share in the target over that in the corpus."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """A row for each document of the streams: its columns, n_words, n_features and weight."""
    row = packed.schema["docs"].dataType.elementType
    schema = T.StructType(row.fields + [T.StructField(c, T.LongType()) for c in RESULTS[:3]])
    shared = packed.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            for k in range(b.num_rows):
                docs, words, features = (b.column(j).slice(k, 1).flatten() for j in range(3))
                n = np.asarray(features)
                met = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(met):
                    stream = np.frombuffer(b.column(3)[k].as_buffer(), "<u2")
                    weight[met] = np.add.reduceat(gain[stream], (np.cumsum(n) - n)[met]) // n[met]
                yield pa.RecordBatch.from_arrays([*docs.flatten(), words, features, pa.array(weight)], schema.names)

    return packed.mapInArrow(run, schema)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with n_words, n_features, weight, score and rank: 1, 2, 3 and on for the documents drawn,
    by score and then the smaller id; null for the others.

    `percent` of the documents with at least `least_words` words are drawn.
    """
    kept = [c for c in docs.columns if c != text and c not in RESULTS]
    names = [f"c{k}" for k in range(len(kept))]
    packed = keep(streams(docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], F.col(text).alias("text")), buckets), "streams")
    gain = gains(bucket_counts(packed, buckets), bucket_counts(streams(target.select(F.col("text")), buckets), buckets))
    key = F.col(names[kept.index(id_)])
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-SCALE * F.log(-F.log((noise + 0.5) / 4294967296)))
    scored = keep(weighed(packed, gain).withColumn("score", F.col("weight") + gumbel), "scored")
    drop(packed)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    placed = ranked(able, [F.desc("score"), key.asc_nulls_last()], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    full = placed.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return full.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *RESULTS)


def drawn_documents(docs: DataFrame, target: DataFrame, id_: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The drawn documents with all their columns and their rank, which replaces a column of that name. Ids are taken as
    keys: rows that repeat an id are drawn together, by the best of them."""
    best = importance_resample(docs.select(id_, text), target, id_=id_, text=text, **params).where("rank is not null")
    best = best.groupBy(F.col(id_).alias("_key")).agg(F.min("rank").alias("_rank"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    met = docs.toDF(*names).join(best, F.col(names[docs.columns.index(id_)]).eqNullSafe(F.col("_key")))
    return met.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != "rank"], F.col("_rank").alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


SQL: dict[str, str] = {}
