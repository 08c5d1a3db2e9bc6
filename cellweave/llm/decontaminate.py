"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

A text is normalised to its words (digits, ASCII letters folded to lower case, non-ASCII characters). Each word that the
benchmark knows is a pair of characters, all others share one that no window holds; the automaton runs over these pairs
once, so that it has two states for each word of a window and not one for each byte. The words that a match covers are
mapped back to code points of the original text. Windows are runs of `width` words of an item; a shorter item is one window.

Defined results: a null or wordless text has no words, hits or items; an item without words has no window; items that
repeat a window all count; repeated item ids count once; a null item id counts as the empty string; an empty benchmark
leaves every document clean; documents are returned row for row with their own columns, of which find_leaks replaces
those named like its results; a text of any length is scanned as a whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM

_CLEAN = bytes((c + 32 if 65 <= c < 91 else c) if ALNUM[c] else 32 for c in range(256))
_WORD = bytes(255 if ALNUM[c] else 32 for c in range(256))
#: Bytes of windows at most: a benchmark of a million words. Its automaton takes 15 times as much while it is built in a
#: Python worker, 0.94 GB (235 MB measured at a quarter of it).
MOST_BYTES = 1 << 26
#: Stands for a word that no window holds.
UNKNOWN = "\0\0"

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


def windows(items: Iterator[tuple[str, str | None]], width: int) -> Iterator[tuple[tuple[bytes, ...], str]]:
    """(window, item id); a window is its words."""
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            yield tuple(words[k : k + width]), item


class Machine:
    """The automaton and the pairs of characters of the benchmark's words: a first of about as many as there are seconds, so
    that a state has few successors, from alphabets of their own, so that no match begins within a word."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        known = dict.fromkeys(w for _, text in items for w in words_of(text))
        base = math.isqrt(len(known)) + 1
        self.letters = {w: chr(1 + k // base) + chr(1 + base + k % base) for k, w in enumerate(known)}
        owners: dict[str, set[str]] = {}
        for window, item in windows(iter(items), width):
            owners.setdefault("".join(map(self.letters.__getitem__, window)), set()).add(item)
        self.states = ahocorasick.Automaton()
        while owners:
            window, ids = owners.popitem()
            self.states.add_word(window, (len(window) // 2, tuple(sorted(ids))))
        self.states.make_automaton()

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, number of words, item id) of each occurrence of a window."""
        if not words or not len(self.states):
            return []
        pair = self.letters.get
        line = "".join([pair(w, UNKNOWN) for w in words])
        return [(end // 2 + 1 - n, n, item) for end, (n, ids) in self.states.iter(line) for item in ids]


_built: dict[str, Machine] = {}


def _machine(key: str, shared) -> Machine:
    """The machine of a broadcast, built once in a Python worker, which keeps the last one."""
    if key not in _built:
        _built.clear()
        _built[key] = Machine(*shared.value)
    return _built[key]


def resolve(text: str | None, total: int, found: list[tuple[int, int, str]]) -> tuple[int, int, list[str], list[dict]]:
    """Words, words hit, item ids sorted as strings, and the hit runs as code point offsets of the text."""
    if not found:
        return total, 0, [], []
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, [w for w, _, _ in found], 1)
    np.add.at(cover, [w + n for w, n, _ in found], -1)
    hit = np.cumsum(cover[:-1]) > 0
    data = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(data.translate(_WORD), np.uint8) == 255
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    start, end = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
    runs = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    return total, int(hit.sum()), sorted({i for _, _, i in found}), [{"start": a, "end": b} for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_bytes: int = MOST_BYTES, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, item_ids and hit_spans (runs of hit words as code point offsets of the text).

    The items are broadcast, every Python worker builds the automaton of all their windows once, every task scans its
    texts once. A benchmark of more than most_bytes of windows is refused: its automaton would not fit a worker.
    """
    spark = docs.sparkSession
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("text")).distinct()
    for r in rows.toLocalIterator():
        items.append((r.item, r.text))
        size += sum(sum(map(len, window)) + len(window) for window, _ in windows(iter(items[-1:]), width))
        if size > most_bytes:
            raise ValueError(f"the benchmark has more than {most_bytes} bytes of windows, too many for one automaton")
    shared, key = spark.sparkContext.broadcast((items, width)), uuid.uuid4().hex
    base = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    own = [k for k, n in enumerate(docs.columns) if n not in FOUND.names]
    schema = T.StructType([docs.schema[k] for k in own] + FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, shared)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            results = []
            for cell in batch.column(batch.num_columns - 1):
                words = words_of(text := cell.as_py())
                results.append(resolve(text, len(words), machine.matches(words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[k] for r in results], kind) for k, kind in enumerate(kinds))], schema.names)

    scanned = base.select(*[f"c{k}" for k in own], F.col(f"c{docs.columns.index(text)}").alias("scanned"))
    return scanned.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without the documents that hold a benchmark window; their columns go by other names, as none is replaced."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    found = find_leaks(docs.toDF(*names), benchmark, text=names[docs.columns.index("text")], **params)
    return found.where("n_hit = 0").select(*names).toDF(*docs.columns)


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = {
    "op4_benchmark_decontamination": r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
dg AS (SELECT doc_id, l, k, array_to_string(w[k : k + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM dw, lens WHERE len(w) >= l)),
hits AS (SELECT DISTINCT dg.doc_id, dg.k, dg.l, win.item FROM dg JOIN win ON dg.l = win.l AND dg.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
}
