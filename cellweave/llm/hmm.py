"""Hidden Markov language model: Baum-Welch over all training texts, exact scores by the scaled forward recursion.

Tokens are words with folded ASCII letters, then one end. The most frequent words, as many as a parameter says, and the
end are symbols with emissions of their own; the other words share the symbol of the tail, told apart by their exact
counts. Expected counts by symbol and state are summed in each task, then across partitions. Emissions are add-one
smoothed: each state gets an equal share of one more count a word, and of one word never seen, which stands in the tail.

Defined results: a null or empty text is the end alone; a null doc_id hashes as the empty text, which trains; repeated
rows count as often as they occur; without training rows every count is 0 and the model gives the end and the tail half each;
an empty table gives an empty table; other columns are ignored, whatever their names; ids of any type will do; a text of any
length is scored whole, its alphas held a segment at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep, release
from .words import NOT_SPACE, hashes, slices, spans

#: Words with emissions of their own (40 bytes each in the driver and every task); states; iterations; tokens of a batch;
#: positions held of a forward pass; words a task holds before it counts them.
SYMBOLS, STATES, ITERATIONS, BATCH, HELD, FLUSH = 1 << 19, 8, 3, 1 << 18, 1 << 18, 1 << 22
HELD_OUT, FOLDS = 2, 7
_U = np.uint64


def texts_to_words(column: pa.Array) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in slices(column):
        start, end, bounds = spans(data, offsets, NOT_SPACE)
        words = hashes(data, start, end)
        for k in range(hi - lo):
            yield words[bounds[k] : bounds[k + 1]]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of every word of the texts, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held) if held else np.zeros(0, _U), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "c"])

        for b in batches:
            for words in texts_to_words(b.column(0)):
                held.append(words)
                size += len(words)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return texts.mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> Column:
    """A condition on c that holds for the most frequent words, at most `most` of them.

    A histogram over bins of the count, of a bounded number, says from which bin on they are few enough; so no task sorts
    all words. Words of that bin's count are all in or all out.
    """
    bin_ = F.floor(F.log2("c") * 1024).cast("int")
    sizes = {r.b: r.n for r in counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return F.lit(False) if least is None else bin_ >= least


def encode(docs: DataFrame, word: np.ndarray, c: np.ndarray) -> DataFrame:
    """A row per text: row, doc_id, held_out, symbols, others, n_tokens, n_known, log_known.

    word, c: hashes and counts of the words that are symbols, the most frequent first. A symbol is such a word's place,
    then the end, then the tail; `others` holds the text's words of the tail and how often each occurs. n_known and
    log_known (sum of log10(c + 1)) leave those out. Symbols are held as their low 16 bits, then their high ones, which
    are mostly zero and pack well.
    """
    order = np.argsort(word)
    shared = docs.sparkSession.sparkContext.broadcast((word[order], order, np.log10(c + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, place_of, log_c = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            symbols, others, times, sizes = [], [], [], []
            for words in texts_to_words(b.column(2)):
                at = np.minimum(np.searchsorted(word, words), max(0, len(word) - 1))
                hit = word[at] == words if len(word) else np.zeros(len(words), bool)
                own = np.full(len(words) + 1, len(word) + 1, np.int32)
                own[:-1][hit] = place_of[at[hit]]
                own[-1] = len(word)
                rest, n = np.unique(words[~hit], return_counts=True)
                symbols.append(own.view(np.uint16).reshape(-1, 2).T.tobytes())
                others.append(rest.view(np.int64))
                times.append(n)
                sizes.append((row, len(words) + 1, int(hit.sum()), float(log_c[own[:-1][hit]].sum())))
                row += 1
            rows, n_tokens, n_known, log_known = zip(*sizes, strict=True) if sizes else ((),) * 4
            edges = pa.array(np.cumsum([0, *map(len, others)]).astype(np.int32))
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (others, times)]
            lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(x) for x in flat], ["word", "tf"]))
            columns = [pa.array(rows, pa.int64()), b.column(0), b.column(1), pa.array(symbols, pa.binary()), lists, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_known, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "symbols", "others", "n_tokens", "n_known", "log_known"])

    id_ = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_}, held_out boolean, symbols binary, others array<struct<word: long, tf: long>>, n_tokens long, n_known long, log_known double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


class Model:
    """start (S), move (S x S) and emit (symbols x S); rows of start and move sum to 1, columns of emit too."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, n_tail: int) -> Model:
        """From expected counts by first state, by move and by symbol; n_tail: words that the last symbol stands for."""
        start, move, emit = start + 0.1, move + 0.1, emit + 1 / len(start)
        emit[-1] += n_tail / len(start)
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32))


def batches_of(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which texts, longest first, symbols as steps x texts padded by -1, lengths), of about BATCH tokens or one text."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, BATCH // len(texts[order[lo]])))
        own = order[lo:hi]
        lengths = np.array([len(texts[k]) for k in own])
        padded = np.full((lengths[0], len(own)), -1, np.int64)
        for j, k in enumerate(own.tolist()):
            padded[: lengths[j], j] = texts[k]
        yield own, padded, lengths
        lo = hi


def forward(model: Model, emitted: np.ndarray, lengths: np.ndarray, lo: int, alpha: np.ndarray | None, saved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion from step lo over emitted (states x steps x texts): the last alpha (states x texts) and the
    scale of each step and text, 1 after a text's end. saved takes the alpha of every step."""
    n_states, steps, n_texts = emitted.shape
    move = np.ascontiguousarray(model.move.T)
    scales = np.ones((steps, n_texts))
    alpha = np.zeros((n_states, n_texts)) if alpha is None else alpha.copy()
    alive = np.searchsorted(-lengths, -np.arange(lo, lo + steps), side="left").tolist()  # texts longer than step t come first
    for t, n in enumerate(alive):
        if not n:
            break
        a = emitted[:, t, :n] * (model.start[:, None] if lo + t == 0 else move @ alpha[:, :n])
        a /= np.add.reduce(a, 0, out=scales[t, :n])
        alpha[:, :n] = a
        if saved is not None:
            saved[:, t, :n] = a
    return alpha, scales


def segments(n_steps: int, n_texts: int) -> list[tuple[int, int]]:
    """(first step, end) of runs of steps of which HELD positions are held at a time."""
    size = max(1, HELD // n_texts)
    return [(lo, min(n_steps, lo + size)) for lo in range(0, n_steps, size)]


def likelihoods(model: Model, padded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a batch."""
    emit, alpha, log = np.ascontiguousarray(model.emit.T), None, np.zeros(len(lengths))
    for lo, hi in segments(*padded.shape):
        alpha, scales = forward(model, emit.take(padded[lo:hi], 1), lengths, lo, alpha)
        log += np.log10(scales).sum(0)
    return log


def expect(model: Model, padded: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Adds the expected counts of a batch; alphas are kept of one segment of steps at a time. Returns the log10 likelihood."""
    n_states, n_texts, by_state = len(model.start), padded.shape[1], np.ascontiguousarray(model.emit.T)
    runs, alphas, total = segments(*padded.shape), [None], 0.0
    for lo, hi in runs[:-1]:  # the last segment is only run below
        alphas.append(forward(model, by_state.take(padded[lo:hi], 1), lengths, lo, alphas[-1])[0])
    beta, pairs = np.zeros((n_states, n_texts)), np.zeros((n_states, n_states))
    for (lo, hi), alpha in zip(reversed(runs), reversed(alphas), strict=True):
        emitted = by_state.take(padded[lo:hi], 1)
        saved, betas = np.zeros_like(emitted), np.zeros_like(emitted)
        _, scales = forward(model, emitted, lengths, lo, alpha, saved)
        total += float(np.log10(scales).sum())
        emitted /= scales
        alive = np.searchsorted(-lengths, -np.arange(lo, hi + 1), side="left").tolist()
        for t in range(hi - lo - 1, -1, -1):
            n = alive[t]
            beta[:, alive[t + 1] : n] = 1.0  # the texts that end here
            betas[:, t, :n] = beta[:, :n]
            if lo + t == 0:
                break
            back = emitted[:, t, :n] * beta[:, :n]
            pairs += (saved[:, t - 1, :n] if t else alpha[:, :n]) @ back.T
            np.matmul(model.move, back, out=back)
            beta[:, :n] = back
        betas *= saved
        at = np.flatnonzero(padded[lo:hi].ravel() >= 0)
        symbols = padded[lo:hi].ravel()[at]
        gamma = betas.reshape(n_states, -1).take(at, 1)
        gamma /= gamma.sum(0)
        for s in range(n_states):
            emit[:, s] += np.bincount(symbols, weights=gamma[s], minlength=len(emit))
        if lo == 0:
            start += gamma[:, :n_texts].sum(1)
    move += model.move * pairs
    return total


def texts_of(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Model]]:
    """Batches of texts for the recursions: which texts, symbols padded, lengths, the symbols that occur (padded ones are
    places among these), and the model with their emissions alone."""
    column = batch.column(batch.schema.get_field_index("symbols")).to_pylist()
    symbols = [np.frombuffer(x, np.uint16).reshape(2, -1).T.astype(np.uint16, order="C").view(np.int32)[:, 0] for x in column]
    place = np.zeros(len(model.emit), np.int64)
    for own, padded, lengths in batches_of(symbols):
        valid = padded >= 0
        here = np.flatnonzero(np.bincount(padded[valid], minlength=len(place)))
        place[here] = np.arange(len(here))
        padded = np.where(valid, place[padded], -1)
        yield own, padded, lengths, here, Model(model.start, model.move, model.emit[here].astype(float))


def expected_counts(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts by first state, by move and by symbol, and the log10 likelihood, summed over the texts: the E-step.

    A task sums its texts and sends a row for each symbol it met, then the sums without symbol under keys below 0."""
    states, n_symbols = len(model.start), len(model.emit)
    names = [f"n{s}" for s in range(states)]
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states)), 0.0
        for b in batches:
            for _, padded, lengths, here, local in texts_of(model, b):
                n = np.zeros(local.emit.shape)
                log += expect(local, padded, lengths, start, move, n)
                emit[here] += n
        met = np.flatnonzero(emit.any(1))
        sums = np.stack((start, np.eye(1, states)[0] * log, *move))
        keys = np.concatenate((np.arange(-len(sums), 0), met)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x.astype(np.float32)) for x in np.concatenate((sums, emit[met])).T)], ["key", *names])

    sent = coded.select("symbols").mapInArrow(count, "key int, " + ", ".join(f"{n} float" for n in names))
    table = sent.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    shared.destroy()
    out = np.zeros((2 + states + n_symbols, states))
    out[np.asarray(table.column("key")) + 2 + states] = np.stack([np.asarray(table.column(n)) for n in names], 1)
    return out[0], out[2 : 2 + states], out[2 + states :], float(out[1, 0])


def baum_welch(coded: DataFrame, counts: np.ndarray, n_tail: int, states: int, iterations: int) -> tuple[Model, list[float]]:
    """The model after some iterations over the coded texts, and the log10 likelihood before each. counts: of the symbols
    (words, end, tail); n_tail: words that differ in the tail."""
    part, logs = 0.5 + np.random.default_rng(1).random((len(counts), states)), []
    move = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(move, 0.98)
    model = Model.from_counts(np.ones(states), move * 1e6, counts[:, None] * part / part.sum(1, keepdims=True), n_tail)
    for _ in range(iterations):
        start, move, emit, log = expected_counts(coded, model)
        release(coded.sparkSession)
        logs.append(log)
        model = Model.from_counts(start, move, emit, n_tail)
    return model, logs


def score_texts(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, n_symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select("doc_id", (F.crc32(name.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"), "text")
    training = docs.where("not held_out")
    counts = keep(word_counts(training.select("text")), "counts")
    release(spark)
    n_docs = training.count()
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v = row.n + n_docs, row.v + (n_docs > 0)
    top = counts.where(frequent(counts, n_symbols)).toArrow()
    word, c = (np.asarray(top.column(k)).astype(np.int64) for k in range(2))
    word = word.view(_U)
    order = np.lexsort((word, -c))
    word, c = word[order], c[order]
    coded = keep(encode(docs, word, c), "coded")
    tail_n, tail_v = int(row.n - c.sum()), int(row.v - len(c))
    model, _ = baum_welch(coded.where("not held_out"), np.concatenate((c, [n_docs, tail_n])).astype(float), tail_v, states, iterations)
    shared = spark.sparkContext.broadcast(model)
    tail, tail_log = len(c) + 1, float(np.log10(tail_n + tail_v + 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            logs = np.zeros(b.num_rows)
            for own, padded, lengths, here, local in texts_of(model, b):
                in_tail = (padded >= 0) & (here[padded] == tail)
                logs[own] = likelihoods(local, padded, lengths) - tail_log * in_tail.sum(0)
            kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_known"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in kept), pa.array(logs)], [*kept, "log"])

    id_ = docs.schema["doc_id"].dataType.simpleString()
    scored = coded.drop("others").mapInArrow(score, f"row long, doc_id {id_}, held_out boolean, n_tokens long, n_known long, log_known double, log double")
    rest = coded.select("row", F.explode("others").alias("o")).select("row", "o.*").join(counts, "word")
    rest = rest.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log_more"))
    full = scored.join(rest, "row", "left").withColumn("log_more", F.coalesce("log_more", F.lit(0.0)))
    end = float(np.log10(n_docs + 1.0))
    base = F.col("log_known") + F.col("log_more") + end - F.col("n_tokens") * F.lit(float(np.log10(n_train + v + 1.0)))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("log") + F.col("log_more")).alias("score"),
    )


def op10_hmm_language_model(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL: dict[str, str] = {}
