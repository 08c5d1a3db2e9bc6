"""N-gram Jaccard join by T-occurrence search with DivideSkip, over inverted lists spread by token.

Texts with the same shingle set form a class, named by a 64-bit sum over the set. Two classes of n and m shingles link
when they share T = ceil(t (n + m) / (1 + t)) of them. Tokens are ordered from short to long inverted lists; a class
must then meet each partner in a short list: one of its first n - ceil(t n) + 1 tokens. So

1. list lengths: tokens are counted over all texts, in buckets of the hash range; the longest lists (a bounded table,
   it only sets the order, any order is right) are known to all tasks;
2. short lists: each class posts its first tokens; lists of two classes or more are kept, once for each set of members;
3. search: turns choose pairs that meet in a list and aren't connected yet. Parity sketches rule most of them out: the
   sketches of linked sets differ in at most n + m - 2 T bits. The others are grouped by one end, the query, in groups
   of bounded size; in each the query's lists over the group's classes are divided: the longest L are skipped, the
   short ones heap-merged, and classes that occur T - L times binary-probed in the long ones. The first turn pairs the
   least class of a list with the others. The next compare the sketches of all that are still apart, in blocks of near
   lengths. A block gives a forest of its nearest pairs, and its other pairs too where they are few; where they aren't,
   its list comes back in the next turn, and the last turn takes every pair of components that are apart even then. So
   no link between components is lost though copies of copies are never expanded into all pairs.

Defined results: a null, empty or wordless text has no shingle and links with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are of one class; null doc_ids take part, their own id is left null and never
names a component; a text of any length is read whole, and memory grows with the longest text's set; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import relabelled
from .scratch import drop, keep, partitions, release
from .words import NOT_SPACE, groups, hashes, mix, shingles, slices, spans

WIDTH, PERCENT = 5, 75
#: List lengths from which a list is long; how many of the longest are known to all tasks (12 bytes each); tokens
#: counted at once in a task; classes in a search group; tokens of a bucket, about; keys that are broadcast (8 bytes
#: each); turns of blocks, of which the last takes every pair.
LONG, MOST_LONG, FLUSH, GROUP, BUCKET, MOST_KEYS, TURNS = 8, 1 << 19, 1 << 22, 512, 1 << 20, 1 << 20, 4
#: Lists of more classes than this power of two are cut into slices of about as many.
SLICED = 16
_U = np.uint64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(column):
        start, end, bounds = spans(data, offsets, NOT_SPACE)
        yield from shingles(hashes(data, start, end), bounds, width)


def class_of(own: np.ndarray) -> int:
    """The name of a set: a 64-bit sum over its hashes, as a signed number."""
    return int((np.add.reduce(mix(own, 3), dtype=_U) ^ _U(len(own))).astype(np.int64)) if len(own) else 0


def required(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap with 100 * overlap >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def t_occurrence(query: np.ndarray, tokens: np.ndarray, owner: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many of the query's tokens each member holds, by DivideSkip; 0 where that is under least[member].

    tokens, owner: the members' sorted sets one after another. Lists are runs of the sorted tokens, members ascending.
    """
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    lo, hi = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    lo, hi = lo[hi > lo], hi[hi > lo]
    t = max(1, int(least.min()))
    if not len(lo):
        return np.zeros(len(least), np.int64)
    by_length = np.argsort(hi - lo, kind="stable")
    longest = int((hi - lo).max())
    n_long = min(t - 1, int(t / (0.0085 * math.log2(longest + 1) + 1)), len(lo))
    short, long = by_length[: len(lo) - n_long], by_length[len(lo) - n_long :]
    counts = np.zeros(len(least), np.int64)
    for member in heapq.merge(*(owner[lo[k] : hi[k]].tolist() for k in short)):
        counts[member] += 1
    candidates = np.flatnonzero(counts >= least - n_long) if n_long else np.flatnonzero(counts >= least)
    for k in long:  # each candidate's place in the long list, by binary search
        one = owner[lo[k] : hi[k]]
        at = np.minimum(np.searchsorted(one, candidates), len(one) - 1)
        counts[candidates] += one[at] == candidates
    out = np.zeros(len(least), np.int64)
    out[candidates] = np.where(counts[candidates] >= least[candidates], counts[candidates], 0)
    return out


def _batch(schema: list[tuple[str, pa.DataType]], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers as the byte planes of their steps: planes of small steps are zeros, which shuffles compress."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def long_lists(texts: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest lists: sorted 32-bit token prefixes and the log2 of their lengths, at most MOST_LONG of them.

    A task counts a set once, sends its tokens' upper 32 bits in buckets of the hash range; each bucket is counted on
    its own and returns its share of the bounded table.
    """
    per_bucket = max(1, MOST_LONG // n_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            bucket = (every.astype(_U) * _U(n_buckets)) >> _U(32)
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
            parts = [(k, _planes(every[cut[k] : cut[k + 1]])) for k in range(n_buckets) if cut[k + 1] > cut[k]]
            return _batch([("bucket", pa.int32()), ("tokens", pa.binary())], [[p[0] for p in parts], [p[1] for p in parts]])

        for b in batches:
            for own in shingle_sets(b.column(0)):
                name = class_of(own)
                if len(own) and name not in seen:
                    seen.add(name)
                    held.append((own >> _U(32)).astype(np.uint32))
                    size += len(own)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        yield flush()

    def longest(table: pa.Table) -> pa.Table:
        every = np.sort(np.concatenate([_from_planes(x.as_py(), np.uint32) for x in table.column("tokens")]))
        edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
        n, token = np.diff(edge), every[edge[:-1]]
        top = np.flatnonzero(n >= LONG)
        if len(top) > per_bucket:
            top = top[np.argsort(-n[top], kind="stable")[:per_bucket]]
        return pa.table({"tokens": pa.array([token[top].tobytes()], pa.binary()), "n": pa.array([n[top].astype(np.int64).tobytes()], pa.binary())})

    parts = texts.mapInArrow(count, "bucket int, tokens binary").groupBy("bucket").applyInArrow(longest, "tokens binary, n binary").collect()
    tokens = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p.tokens, np.uint32) for p in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p.n, np.int64) for p in parts)])
    order = np.argsort(tokens)
    return tokens[order], np.log2(n[order]).astype(np.uint8)


def short_lists(texts: DataFrame, longest: tuple[np.ndarray, np.ndarray], n_buckets: int, percent: int) -> DataFrame:
    """(list, sliced, classes): lists of two classes or more, one for each set of members; list is its number. A kept table.

    The list of a token over 2 ** SLICED long is cut into slices by class, each in a bucket and a row of its own.
    """
    shared = texts.sparkSession.sparkContext.broadcast(longest)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, names, size, seen = [], [], 0, set()
        known, power = shared.value

        def flush() -> pa.RecordBatch:
            token = np.concatenate(tokens) if tokens else np.zeros(0, _U)
            name = np.repeat(np.array(names, np.int64), [len(t) for t in tokens])
            upper = (token >> _U(32)).astype(np.uint32)
            spread = mix(token, 11)
            if len(known):  # each slice of a very long list goes to a bucket of its own
                at = np.minimum(np.searchsorted(known, upper), len(known) - 1)
                extra = np.where(known[at] == upper, np.maximum(power[at].astype(np.int64) - SLICED, 0), 0)
                many = np.flatnonzero(extra)
                slice_ = mix(name[many].view(_U), 13) & ((_U(1) << extra[many].astype(_U)) - _U(1))
                spread[many] = mix(spread[many] ^ slice_, 12)
            bucket = ((spread >> _U(32)) * _U(n_buckets)) >> _U(32)
            order = np.lexsort((token, bucket))
            token, name, bucket = token[order], name[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
            parts = [(k, _planes(token[cut[k] : cut[k + 1]]), name[cut[k] : cut[k + 1]].tobytes()) for k in range(n_buckets) if cut[k + 1] > cut[k]]
            return _batch([("bucket", pa.int32()), ("tokens", pa.binary()), ("classes", pa.binary())], [[p[k] for p in parts] for k in range(3)])

        for b in batches:
            for own in shingle_sets(b.column(0)):
                name = class_of(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                n = prefix(len(own), percent)
                first = _ordered(own, shared.value)[0][:n]
                tokens.append(first)
                names.append(name)
                size += n
                if size >= FLUSH:
                    yield flush()
                    tokens, names, size = [], [], 0
        yield flush()

    def lists(table: pa.Table) -> pa.Table:
        token = np.concatenate([_from_planes(x.as_py(), _U) for x in table.column("tokens")])
        name = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("classes")])
        order = np.lexsort((name, token))
        token, name = token[order], name[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])))
        token, name = token[fresh], name[fresh]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        n = np.diff(edge)
        upper = (token[edge[:-1]] >> _U(32)).astype(np.uint32)
        known, power = shared.value
        sliced = np.zeros(len(n), bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, upper), len(known) - 1)
            sliced = (known[at] == upper) & (power[at] > SLICED)
        name_sum = np.add.reduceat(mix(name.view(_U), 5), edge[:-1]) if len(name) else np.zeros(0, _U)
        first = token[edge[:-1]]
        number = np.where(sliced, mix(first ^ name_sum, 6), mix(name_sum, 7))
        use = np.flatnonzero((n > 1) | sliced)
        _, once = np.unique(number[use], return_index=True)
        use = use[once]
        members = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[use]))), pa.int32()), pa.array(name[np.repeat(edge[use], n[use]) + np.arange(n[use].sum()) - np.repeat(np.cumsum(n[use]) - n[use], n[use])]))
        return pa.table({"list": pa.array(number[use].view(np.int64)), "token": pa.array(first[use].view(np.int64)), "sliced": pa.array(sliced[use]), "classes": members})

    found = texts.mapInArrow(post, "bucket int, tokens binary, classes binary").groupBy("bucket").applyInArrow(lists, "list long, token long, sliced boolean, classes array<long>")
    found = found.groupBy("list").agg(F.first("token").alias("token"), F.first("sliced").alias("sliced"), F.first("classes").alias("classes"))
    # The slices of a token's list keep their token in common, as one list.
    out = keep(found.withColumn("list", F.when(F.col("sliced"), F.xxhash64("token")).otherwise(F.col("list"))).select("list", "sliced", "classes"), "lists")
    shared.destroy()
    return out


def _ordered(own: np.ndarray, longest: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The set from short to long lists, ties by hash, and how many of its tokens are in short lists."""
    known, power = longest
    if not len(known):
        return own, len(own)
    upper = (own >> _U(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(known, upper), len(known) - 1)
    length = np.where(known[at] == upper, power[at], 0)
    return (own[np.argsort(length, kind="stable")], int((length == 0).sum())) if length.any() else (own, len(own))


def needed_sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(class, n, tokens) of the classes asked for (class, key), from the texts (key, text) with their keys.

    Only texts with those keys are cut into words. The keys are broadcast where they are few, else joined.
    """
    keys = asked.select("key").distinct()
    keys = F.broadcast(keys) if asked.count() <= MOST_KEYS else keys

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = [("class", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())], set()
        rows, size = [], 0
        for b in batches:
            for own in shingle_sets(b.column(0)):
                name = class_of(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                rows.append((name, len(own), own.tobytes()))
                size += len(own)
                if size > 1 << 18:
                    yield _batch(schema, [list(x) for x in zip(*rows, strict=True)])
                    rows, size = [], 0
        if rows:
            yield _batch(schema, [list(x) for x in zip(*rows, strict=True)])

    found = texts.join(keys, "key", "left_semi").select("text").mapInArrow(sets, "class long, n long, tokens binary")
    return found.groupBy("class").agg(F.first(F.struct("n", "tokens")).alias("s")).select("class", "s.*")


def sketch(own: np.ndarray) -> bytes:
    """How many tokens fall on each place, odd or even, on 4 places a token or more (a power of two). The sketches of two
    sets differ in no more places than the sets in tokens; a sketch folds to half its places by exclusive or."""
    places = 1 << max(6, math.ceil(math.log2(4 * len(own))))
    return np.packbits(np.bincount((own & _U(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


class Sketches:
    """The sketches of some sets, in a matrix for each size, to be compared with one at a time."""

    def __init__(self, blobs: list[bytes], n: np.ndarray):
        self.n, self.size = n, np.array([len(b) for b in blobs])
        self.at = {s: np.flatnonzero(self.size == s) for s in np.unique(self.size).tolist()}
        self.bits = {s: np.frombuffer(b"".join(blobs[k] for k in at.tolist()), _U).reshape(len(at), s // 8) for s, at in self.at.items()}

    def near(self, blob: bytes, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Those that may link with a set of n tokens and this sketch, and how near they seem: 0 for equal sketches, up
        to 1 for as many differences as links allow."""
        own, out, shares = np.frombuffer(blob, _U), [], []
        for s, at in self.at.items():
            x, y = own, self.bits[s]
            while len(x) > y.shape[1]:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(x) < y.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            m = self.n[at]
            fits = (m * 100 >= n * percent) & (n * 100 >= m * percent)
            differ, most = np.bitwise_count(x ^ y).sum(1, dtype=np.int64), n + m - 2 * required(m, np.int64(n), percent)
            fits &= differ <= most
            out.append(at[fits])
            shares.append(differ[fits] / np.maximum(most[fits], 1))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0)
        at, share = np.concatenate(out), np.concatenate(shares)
        order = np.argsort(at)
        return at[order], share[order]


def forest(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which of the edges between a and b a least spanning forest takes, nearest first; edges are dropped in runs once
    their ends are joined."""
    _, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(ends.max() + 1 if len(ends) else 0)
    left = np.argsort(share, kind="stable")
    a, b, taken = ends[: len(a)], ends[len(a) :], []
    while len(left):
        run, left = left[:4096], left[4096:]
        for k in run.tolist():
            x, y = label[a[k]], label[b[k]]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                taken.append(k)
        left = left[label[a[left]] != label[b[left]]]
    return np.array(taken, np.int64)


def search(pairs: DataFrame, sets: DataFrame, percent: int, sketched: bool = False) -> DataFrame:
    """(query, class) of those pairs that link; with sketches, that they don't rule out.

    Groups are the pairs of one query, GROUP of them or so.
    """
    hot = keep(pairs.groupBy("query").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP), "hot")
    slices_ = F.ceil(F.coalesce("_n", F.lit(1)) / GROUP)
    pairs = pairs.join(hot, "query", "left").withColumn("slice", F.pmod(F.xxhash64("class"), slices_).cast("int")).drop("_n")
    members = pairs.join(sets, "class").select("query", "slice", "class", "n", "tokens", F.lit(False).alias("is_query"))
    queries = pairs.select("query", "slice").distinct().join(sets.withColumnRenamed("class", "query"), "query")
    queries = queries.select("query", "slice", F.col("query").alias("class"), "n", "tokens", F.lit(True).alias("is_query"))
    both = queries.unionByName(members).withColumn("group", F.xxhash64("query", "slice"))
    both = both.repartition(partitions(pairs.sparkSession), "group").sortWithinPartitions("group")
    schema = [("query", pa.int64()), ("class", pa.int64())]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in groups(batches, "group"):
            names, is_query, n, of = (np.asarray(table.column(c)) for c in ("class", "is_query", "n", "query"))
            blobs = table.column("tokens").to_pylist()
            for q in np.flatnonzero(is_query).tolist():
                own = np.flatnonzero(~is_query & (of == of[q]))
                if not len(own):
                    continue
                if sketched:
                    hit = own[Sketches([blobs[k] for k in own.tolist()], n[own]).near(blobs[q], int(n[q]), percent)[0]]
                else:
                    tokens = np.concatenate([np.frombuffer(blobs[k], _U) for k in own.tolist()])
                    hit = own[t_occurrence(np.frombuffer(blobs[q], _U), tokens, np.repeat(np.arange(len(own)), n[own]), required(n[own], n[q], percent)) > 0]
                a += [int(names[q])] * len(hit)
                b += names[hit].tolist()
            if len(a) > 10_000:
                yield _batch(schema, [a, b])
                a, b = [], []
        yield _batch(schema, [a, b])

    return both.select("group", "query", "class", "n", "tokens", "is_query").mapInArrow(probe, "query long, class long")


def length_of(n: str = "n", percent: int = PERCENT):
    """The number of a set's length: those of sets that may link are at most one apart."""
    return F.floor(F.log(F.col(n)) / math.log(100 / percent) + 1e-9).cast("int")


def search_apart(apart: DataFrame, sketches: DataFrame, percent: int, every: bool) -> DataFrame:
    """(query, class, first, list) of different components that share a list and that sketches don't rule out, a kept table.

    apart: (list, class, component, other, n): `other` outside the list's main component. Those meet all of the list that
    are of near length, in blocks of at most 2 * GROUP a side. A block gives the edges of a forest that spans its
    components, nearest pairs first (first is true), and all its pairs where they are few or where `every` is set; else
    a row with the list alone says that there are more.
    """
    near = F.array(*[F.col("size") + k for k in (-1, 0, 1)])
    rows = apart.withColumn("size", length_of("n", percent))
    left = rows.where("other").select("list", "class", "component", "other", "size", F.lit(True).alias("left"))
    right = rows.select("list", "class", "component", "other", F.explode(near).alias("size"), F.lit(False).alias("left"))
    both = left.unionByName(right)
    blocks = both.groupBy("list", "size").agg(F.ceil(F.count_if("left") / (2 * GROUP)).alias("a"), F.ceil(F.count_if(~F.col("left")) / (2 * GROUP)).alias("b")).where("a > 0")
    blocks = keep(blocks, "blocks")
    to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    both = both.join(blocks, ["list", "size"]).withColumn("own", F.pmod(F.xxhash64("class"), F.when(F.col("left"), F.col("a")).otherwise(F.col("b")))).withColumn("met", F.explode(F.when(F.col("left"), to("b")).otherwise(to("a"))))
    group = F.xxhash64("list", "size", F.when(F.col("left"), F.col("own")).otherwise(F.col("met")), F.when(F.col("left"), F.col("met")).otherwise(F.col("own")))
    both = both.select(group.alias("group"), "list", "class", "component", "other", "left").join(sketches, "class")
    both = both.repartition(partitions(apart.sparkSession), "group").sortWithinPartitions("group").select("group", "list", "class", "component", "other", "left", "n", "sketch")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("query", pa.int64()), ("class", pa.int64()), ("first", pa.bool_()), ("list", pa.int64())]
        out: list[tuple] = []
        for table in groups(batches, "group"):
            names, component, other, left, n = (np.asarray(table.column(c)) for c in ("class", "component", "other", "left", "n"))
            blobs = table.column("sketch").to_pylist()
            own = np.flatnonzero(~left)
            all_ = Sketches([blobs[k] for k in own.tolist()], n[own])
            one, two, shares = [], [], []
            for q in np.flatnonzero(left).tolist():
                hit, share = all_.near(blobs[q], int(n[q]), percent)
                hit = own[hit]
                new = (component[hit] != component[q]) & (~other[hit] | (names[hit] > names[q]))
                one.append(np.full(int(new.sum()), q))
                two.append(hit[new])
                shares.append(share[new])
            if not one:
                continue
            one, two = np.concatenate(one), np.concatenate(two)
            nearest = np.zeros(len(one), bool)
            nearest[forest(component[one], component[two], np.concatenate(shares))] = True
            if not every and len(one) > 4 * table.num_rows:
                out.append((None, None, False, int(table.column("list")[0].as_py())))
                one, two, nearest = one[nearest], two[nearest], nearest[nearest]
            out += zip(names[one].tolist(), names[two].tolist(), nearest.tolist(), [None] * len(one), strict=True)
            if len(out) > 10_000:
                yield _batch(schema, list(zip(*out, strict=True)))
                out = []
        if out:
            yield _batch(schema, list(zip(*out, strict=True)))

    found = both.mapInArrow(probe, "query long, class long, first boolean, list long")
    found = keep(found.groupBy("query", "class", "list").agg(F.max("first").alias("first")), "likely")
    drop(blocks)
    return found


def _apart(posts: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """posts (list, class) of those lists that hold several components: (list, class, component, other, n), a kept table.

    The main component of a list is its commonest; `other` says whether a class is outside of it.
    """
    named = posts.join(labels, posts["class"] == labels["node"], "left").select("list", "class", F.coalesce("component", "class").alias("component"))
    per = named.groupBy("list", "component").agg(F.count("*").alias("k"))
    main = keep(per.groupBy("list").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("main")).where("parts > 1").select("list", "main"), "main")
    several = named.join(main, "list").join(sketches.select("class", "n"), "class")
    out = keep(several.select("list", "class", "component", (F.col("component") != F.col("main")).alias("other"), "n"), "apart")
    drop(main)
    return out


def class_rows(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs with class (0: no shingle), n (its shingles), key (of the text) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(class_of(s), len(s), sketch(s) if len(s) else b"") for s in shingle_sets(b.column(b.num_columns - 1))]
            marks = [pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), *marks], [*names, "key", "class", "n", "sketch"])

    rows = docs.select(*names, F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, rows.drop("text").schema.add("class", "long").add("n", "long").add("sketch", "binary"))


def similar_components(docs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, component), a kept table: for every class that links with another, the least class it reaches.

    rows: class_rows of docs, kept.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(4 * partitions(spark), tokens // BUCKET)
    lists = short_lists(texts.select("text"), long_lists(texts.select("text"), n_buckets), n_buckets, percent)
    posts = lists.select("list", F.explode("classes").alias("class"))
    sketches = keep(rows.where("n > 0").join(posts.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first(F.struct("n", "key", "sketch")).alias("s")).select("class", "s.*"), "sketches")
    release(spark)

    def linked(likely: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """The labels after the links among likely pairs (query, class)."""
        involved = keep(likely.select(F.explode(F.array("query", "class")).alias("class")).distinct().join(sketches.select("class", "key"), "class"), "involved")
        if involved.isEmpty():
            drop(involved)
            return labels
        sets = keep(needed_sets(texts, involved), "sets")
        links = keep(search(likely, sets, percent), "links")
        labels = relabelled(labels, links, "query", "class")
        drop(involved, sets, links)
        release(spark)
        return labels

    # The least class of each list, of all slices of one, against the others.
    whole = lists.where("not sliced").select(F.array_min("classes").alias("query"), "classes")
    hubs = lists.where("sliced").groupBy("list").agg(F.min(F.array_min("classes")).alias("query"))
    cut = lists.where("sliced").join(hubs, "list").select("query", "classes")
    pairs = whole.unionByName(cut).select("query", F.explode("classes").alias("class")).where("query <> class").distinct()
    likely = keep(search(pairs, sketches.withColumnRenamed("sketch", "tokens"), percent, sketched=True), "likely")
    labels = linked(likely, None)
    drop(likely)
    if labels is None:
        labels = keep(spark.createDataFrame([], "node long, component long"), "labels")
    apart = _apart(posts, labels, sketches)
    for turn in range(TURNS):
        found = None if apart.isEmpty() else search_apart(apart, sketches, percent, turn == TURNS - 1)
        if found is None:
            break
        labels = linked(found.where("first").select("query", "class"), labels)
        ends = found.where("not first and query is not null").select("query", "class")
        for end in ("query", "class"):
            ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        rest = keep(ends.where("coalesce(_query, query) <> coalesce(_class, class)").select("query", "class"), "rest")
        labels = linked(rest, labels)
        dense = keep(found.where("query is null").select("list").distinct(), "dense")
        again = None if dense.isEmpty() else _apart(posts.join(dense, "list", "left_semi"), labels, sketches)
        drop(found, rest, dense, apart)
        release(spark)
        if again is None:
            apart = None
            break
        apart = again
    drop(lists, sketches, *([apart] if apart is not None else []))
    return labels


def document_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two kept tables: (doc_id, key, class, n) for each row of docs (doc_id, text), and (class, component) of its classes."""
    rows = keep(class_rows(docs, "doc_id"), "classes")
    labels = similar_components(docs, rows, percent)
    every = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    every = every.join(labels, every["class"] == labels["node"], "left").select("class", F.coalesce("component", "class").alias("component"), "least")
    out = keep(every, "components")
    drop(labels)
    return rows.select("doc_id", "key", "class", "n"), out


def document_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, class, n_shingles, component_id for each row of docs."""
    rows, classes = document_classes(docs.select("doc_id", "text"), percent)
    names = keep(classes.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    by_class = keep(classes.join(names, "component").select("class", "component_id"), "by_class")
    drop(names)
    full = rows.where("n > 0").join(by_class, "class").select("doc_id", "class", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", "class", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the least doc_id (null last), with its own columns; texts without shingles
    all stay. Of rows that agree in doc_id and text one stays."""
    rows, classes = document_classes(docs.select("doc_id", "text"), percent)
    rows = rows.where("n > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "class", "key")
    best = rows.join(classes.select("class", "component"), "class").groupBy("component").agg(F.min(F.struct(order.alias("order"), "doc_id", "key")).alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.key").alias("_key"))
    many = rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies")).where("copies > 1")
    best = keep(best.join(many, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")), "left").select("_id", "_key", F.col("copies").isNotNull().alias("_many")), "kept")
    drop(classes)
    # Columns go by numbers of their own here, so that none of the user's names is in the way.
    names = [f"c{k}" for k in range(len(docs.columns))]
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own = docs.toDF(*names)
    empty = F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    same = id_.eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))
    full = own.where(~empty).withColumn("_k", F.xxhash64(text))
    single = full.join(best.where("not _many"), same, "left_semi").select(*names)
    rest = F.to_json(F.struct(F.lit(0), *[n for n in names if n != names[docs.columns.index("text")]]))
    one = full.join(best.where("_many"), same).groupBy("_id", "_key").agg(F.min_by(F.struct(*names), rest).alias("row")).select("row.*")
    return single.unionByName(one).unionByName(own.where(empty)).toDF(*docs.columns)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return document_components(docs).select("doc_id", "n_shingles", "component_id")


SQL: dict[str, str] = {}
