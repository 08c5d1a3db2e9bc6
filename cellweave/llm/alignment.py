"""Alignment of two tokenizers: where both end a token, which tokens overlap, and which pairs go together most.

A batch's texts are laid end to end as bytes. The ends of A's and of B's tokens are counted once at each byte; bytes where
both end cut groups, bytes where either ends close one link of the A and the B token that hold them, and differences of
running sums at the documents' offsets give each document its own figures. Links stay with their documents as packed
codes, one written table; pairs are counted over all of it. A document then sums its links' counts: those of the most
frequent pairs, a table of bounded size, where it stands, those of all others by a join on the pair.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for byte has no tokens,
zeros and an empty digest; special tokens' strings are plain text; rows stay row for row with their own columns, of which
those named like results are replaced; repeated rows count each; an empty table gives an empty table; pairs that tie for
the highest count of their B id are all its best; a text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import keep

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text aligned at once, unless one text alone is longer; pairs whose counts are sent to every task.
BATCH, HOT_PAIRS = 1 << 20, 1 << 18
# Fixed value: how the byte-level vocabulary splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULTS = (*COUNTS, "n_best", "count_sum", "groups_sha256")


def _letters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all entries, and each one's first byte and length."""
    length = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(length) - length, length


def _gather(flat: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The entries of these ids, end to end."""
    data, start, length = flat
    n = length[ids]
    return data[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        letters = _letters()
        known = json.loads(byte_bpe)
        special = {t["id"] for t in known["added_tokens"]}
        entries = {i: bytes(letters[c] for c in word) for word, i in known["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={e: i for i, e in entries.items()}, special_tokens={})  # ids are in order of merges
        self.slow = tokenizers.Tokenizer.from_buffer(byte_bpe)
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.n_a, self.n_b = max(entries, default=0) + 1, self.b.get_piece_size()
        self.a_bytes = _flat([entries.get(i, b"") for i in range(self.n_a)])
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = _flat([piece(i) for i in range(self.n_b)])
        self.digits = _flat([b"%d," % i for i in range(max(self.n_a, self.n_b))])

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(" " + text)
        except BaseException as e:  # its splitter gives up on some runs of millions of characters, with an exception of its own
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow.encode(" " + text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def _tools(byte_bpe: bytes, pieces: bytes) -> Tokenizers:
    """Loaded once a Python worker."""
    return Tokenizers(byte_bpe, pieces)


def _concatenated(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has."""
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), n


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over runs of n values each, which may be none."""
    total = np.concatenate(([0], np.cumsum(values)))
    return np.diff(total[np.concatenate(([0], np.cumsum(n)))])


def encoded(texts: list[str], tools: Tokenizers) -> tuple[np.ndarray, list, list]:
    """Which texts both tokenizers give back, and those texts' ids of A and of B."""
    a, b = [tools.encode_a(t) for t in texts], tools.b.encode(texts, num_threads=1)
    whole = [(" " + t).encode() for t in texts]
    size = np.array([len(w) for w in whole], np.int64)
    good = np.ones(len(texts), bool)
    for lists, flat in ((a, tools.a_bytes), (b, tools.b_bytes)):
        ids, n = _concatenated(lists)
        good &= _sums(flat[2][ids], n) == size
    for lists, flat in ((a, tools.a_bytes), (b, tools.b_bytes)):  # of equal length now, so that bytes stand below each other
        at = np.flatnonzero(good)
        ids, _ = _concatenated([lists[k] for k in at])
        wrong = _gather(flat, ids) != np.frombuffer(b"".join(whole[k] for k in at), np.uint8)
        good[at] = _sums(wrong, size[at]) == 0
    at = np.flatnonzero(good).tolist()
    return good, [a[k] for k in at], [b[k] for k in at]


def align_batch(texts: list[str], tools: Tokenizers) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each text n_a, n_b, n_groups and n_links, and its groups; then the links of all, as codes a * n_b + b."""
    counts, groups = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    good, a, b = encoded([texts[k] for k in some], tools)
    at = np.array(some, np.int64)[good]
    if not len(at):
        return counts, groups, np.zeros(0, np.int64)
    (a, n_a), (b, n_b) = _concatenated(a), _concatenated(b)
    end_a, end_b = np.cumsum(tools.a_bytes[2][a]), np.cumsum(tools.b_bytes[2][b])
    stop = end_a[np.cumsum(n_a) - 1]  # where each text ends
    ends_a, ends_b = np.bincount(end_a), np.bincount(end_b)  # both run to the last byte
    cut, either = (ends_a > 0) & (ends_b > 0), (ends_a > 0) | (ends_b > 0)
    cuts = np.cumsum(cut)
    counts[:, at] = n_a, n_b, np.diff(cuts[stop], prepend=0), np.diff(np.cumsum(either)[stop], prepend=0)
    last = np.flatnonzero(either)
    before = lambda ends: (np.cumsum(ends) - ends)[last]  # noqa: E731  tokens that ended before a link's last byte
    links = a[before(ends_a)] * tools.n_b + b[before(ends_b)]
    for k, text in zip(at.tolist(), _group_texts(a, b, (cuts - cut)[end_a], (cuts - cut)[end_b], np.cumsum(n_a + n_b), tools), strict=True):
        groups[k] = text
    return counts, groups, links


def _group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends: np.ndarray, tools: Tokenizers) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of each text, from the group of each token and the number of tokens up to each text's end."""
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
    ids = np.zeros(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    text = _gather(tools.digits, ids)  # each id with a comma behind it
    stop = np.cumsum(tools.digits[2][ids])
    text[stop[place_a[np.append(group_a[1:] != group_a[:-1], True)]] - 1] = ord("|")
    text[stop[place_b[np.append(group_b[1:] != group_b[:-1], True)]] - 1] = ord(";")
    edges, data = [0, *stop[ends - 1].tolist()], text.tobytes()
    return [data[lo : hi - 1].decode() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _batches(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of at most BATCH bytes of text, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BATCH, side="right")))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, text: str = "text", groups: bool = False) -> DataFrame:
    """docs without their text, with n_a, n_b, n_groups, n_links, groups_sha256 and links (packed codes of 32 bits, a * the
    size of B's vocabulary + b); with groups also the groups themselves. The two files are read here and sent to the tasks."""
    held = []
    for path in (byte_bpe, pieces):
        with open(path, "rb") as f:
            held.append(f.read())
    if _tools(*held).n_a * _tools(*held).n_b > 1 << 32:
        raise ValueError("pairs of these vocabularies do not fit 32 bits")
    shared = docs.sparkSession.sparkContext.broadcast(held)
    names = [c for c in docs.columns if c != text]
    extra = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())]
    extra += [T.StructField("groups", T.StringType())] if groups else []
    schema = T.StructType([docs.schema[c] for c in names] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(*shared.value)
        for b in batches:
            for lo, hi, texts in _batches(b.column(len(names))):
                counts, found, links = align_batch(texts, tools)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found]
                packed, edges = links.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(4 * counts[3])))
                own = [packed[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [*(c.slice(lo, hi - lo) for c in b.columns[:-1]), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())] if groups else columns, schema.names)

    return docs.select(*names, F.col(text)).mapInArrow(run, schema)


def _codes(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<u4")


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) of all documents' links: how often a pair is linked, and whether none of its B id is linked more
    often. A task sends each pair once for every 2^22 links it read; B's vocabulary bounds the table of highest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint32)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

        for b in batches:
            for cell in b.column(0):
                held.append(_codes(cell))
                size += len(held[-1])
                if size >= 1 << 22:
                    yield summed()
                    held, size = [], 0
        yield summed()

    counts = keep(links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = (F.col("pair") % n_b).alias("b")
    top = counts.groupBy(b).agg(F.max("n").alias("top"))  # a row for each id of B at most
    return counts.join(F.broadcast(top), counts["pair"] % n_b == top["b"]).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """docs without their text, with n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id),
    count_sum (over the links, how often their pair is linked in all documents) and groups_sha256.

    hot_pairs only says which counts travel to the links and which links travel to their counts.
    """
    own = [c for c in docs.columns if c != text and c not in RESULTS]
    names = [f"c{k}" for k in range(len(own))]
    found = aligned(docs.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)], F.col(text).alias("text")), byte_bpe, pieces)
    found = keep(found.withColumn("_key", F.monotonically_increasing_id()), "links", compression="zstd")
    with open(pieces, "rb") as f:
        n_b = sentencepiece.SentencePieceProcessor(model_proto=f.read()).get_piece_size()
    counts = keep(pair_counts(found, n_b), "counts")
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toPandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast((hot["pair"].to_numpy(np.uint32), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)))
    schema = T.StructType([found.schema[c] for c in (*names, "_key", *COUNTS, "groups_sha256")] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def here(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each link's place in the table of hot pairs, and whether it is in it."""
        pairs = shared.value[0]
        at = np.minimum(np.searchsorted(pairs, codes), max(0, len(pairs) - 1))
        return at, pairs[at] == codes if len(pairs) else np.zeros(len(codes), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = shared.value
        for b in batches:
            out = np.zeros((2, b.num_rows), np.int64)
            for k, cell in enumerate(b.column(b.num_columns - 1)):
                at, hit = here(_codes(cell))
                out[:, k] = best[at[hit]].sum(), n[at[hit]].sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out[0]), pa.array(out[1])], schema.names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                codes = _codes(cell)
                pair, times = np.unique(codes[~here(codes)[1]], return_counts=True)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), key, np.int64)), pa.array(pair.astype(np.int64)), pa.array(times.astype(np.int64))], ["_key", "pair", "times"])

    rare = found.select("_key", "links").mapInArrow(others, "_key long, pair long, times long").join(counts, "pair")
    rare = rare.groupBy("_key").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    near = found.select(*names, "_key", *COUNTS, "groups_sha256", "links").mapInArrow(sums, schema)
    full = near.join(rare, "_key", "left")
    total = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return full.select(*[F.col(n).alias(c) for c, n in zip(own, names, strict=True)], *COUNTS, total("n_best", "more_best"), total("count_sum", "more"), "groups_sha256")


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokenizers(docs).select("doc_id", *RESULTS)


SQL: dict[str, str] = {}
