"""Probabilistic suffix tree over words: contexts of variable length, kept by divergence.

The root's distribution is that of single tokens, add-0.1 smoothed.  A context (the last one to
DEPTH words) is examined if it and a symbol after it occur LEAST times in the training texts, and
kept if its next symbols diverge from those of the context without its first word by more
than chance (a likelihood-ratio test).  A kept context discounts the counts of the symbols that
follow it LEAST times and leaves the rest to the shorter context, so each state is a
distribution over all tokens:

    P(x | s) = max(count(s x) - D, 0) / count(s) + rest(s) * P(x | s without its first word)

A token is scored in the longest kept state that its predecessors end with.  As log P(x | s) is
log P(x | shorter) + log rest(s), and for a counted pair (s, x) some more, a text's score is the sum of
what its words, its contexts and its pairs add: each is looked up on its own.

The floor is a count, not a share, so the tree grows with the corpus.  Pairs are counted in packed blocks by
ranges of their hash, each a small sort; contexts and pairs that count are Spark tables, the test and the
probabilities are joins and sums by context.  What LEAST rules out (a pair whose context or whose shorter pair
is rarer) is dropped before the shuffle by a filter of the level before, which lets some too many through and
never one too few.  Shuffles are let go as soon as the table they made is written, levels as soon as the states are.

Only the HEAD most frequent words and the most frequent states are broadcast, with a filter of all states.  A chunk of
texts asks for all others in packed blocks by ranges of the key; states and words are dealt to the same ranges, which
answer with what they add to each text of the chunk, and the chunk adds that up.  No row is made for a state in a
text.  None of this changes a result.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end per text; null and empty
texts are the end alone.  Words are known by a 64-bit hash.  A null id is never held
out.  Repeated rows count and are scored repeatedly.  Without training texts
every token has the probability 1 that the formula gives.
"""

from __future__ import annotations

import contextlib
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import (
    LARGE, U64, batch_of, mixed, per_row, pieces, positions, row_sums, span_hashes, spans, stored, texts,
)

#: Words of the longest context; occurrences from which contexts and pairs count.
DEPTH = 4
LEAST = 3
DISCOUNT = 0.5
SMOOTH = 0.1
#: Words that are broadcast, and states per word of these.
HEAD, STATES = 1 << 18, 4
#: States of one range; keys that a chunk of texts asks for, about, and its rows at most (their numbers take 16 bits).
PER_RANGE = 1 << 18
HELD_ASKED, ROWS = 1 << 20, 1 << 16
#: The hash that stands for the end of a text.
END = U64(0x5EED0FE1D0FD0C5E)
#: Distinct counts that a task holds before it hands them on; pairs likewise, and those meant for one block.
HELD = 1 << 21
HELD_PAIRS, BLOCK_PAIRS = 1 << 20, 1 << 19
#: A filter's blocks: bits of one, keys meant for one, at most so many (64 MB).
BLOCK, PER_BLOCK, BLOCKS = 1 << 15, 1 << 11, 1 << 14

_NEXT = U64(0xD6E8FEB86659FD93)
#: Masks of a word's first 0 to 8 bytes; bytes of a word from which its hash is made in another way.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG = 64
_SIZES = mixed(np.arange(1, LONG + 2, dtype=U64))


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text, and the texts' bounds."""
    data, offsets = texts(column)
    # Comparisons of bytes (below their range they wrap round) are quicker than tables.
    starts, ends = spans((data != 0x20) & (data - np.uint8(0x09) > 0x0D - 0x09), offsets)
    first = per_row(starts, offsets)
    bounds = first + np.arange(len(first))
    hashes = np.empty(bounds[-1], U64)
    is_end = np.zeros(len(hashes), bool)
    is_end[bounds[1:] - 1] = True
    hashes[is_end] = END
    hashes[~is_end] = _word_hashes(data | ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5)), starts, ends)
    return hashes, bounds


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], which no byte outside changes: by eight bytes at a time up to LONG, which is
    quicker for words than sums over all bytes."""
    eights = np.ndarray(len(data), U64, np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    sizes = ends - starts
    hashes = mixed(_SIZES[np.minimum(sizes, LONG)] + (eights[starts] & _FIRST[np.minimum(sizes, 8)]))
    for at in range(8, LONG, 8):
        left = np.flatnonzero(sizes > at)
        if not len(left):
            return hashes
        some = eights[starts[left] + at] & _FIRST[np.minimum(sizes[left] - at, 8)]
        hashes[left] = mixed(hashes[left] * _NEXT + some)
    left = np.flatnonzero(sizes > LONG)
    hashes[left] = span_hashes(data, starts[left], ends[left])
    return hashes


def grams(hashes: np.ndarray, bounds: np.ndarray, most: int):
    """For lengths 1 to ``most``: hash of the words that end at each token, and whether its text
    has so many."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    own = hashes
    for length in range(1, most + 1):
        yield own, place >= length - 1
        own = appended(before(own), own)


def before(values: np.ndarray) -> np.ndarray:
    """The value at the token before; the first has none."""
    return np.concatenate([np.zeros(1, values.dtype), values])[: len(values)]


def appended(context: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Hash of a context's words and the symbol after them; ``short`` is that of all but the first (after one word, the symbol)."""
    return mixed(context * _NEXT + short)


def _added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one of each, and the sum of their counts (1 if none are given)."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        sums = np.diff(np.append(at, len(keys)))
    else:
        sums = np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return keys[at], order[at], sums


class Counter:
    """Adds up counts by key; hands on what it holds when that is too much."""

    def __init__(self):
        self.clear()

    def add(self, keys: np.ndarray) -> None:
        keys, _, counts = _added(keys)
        self.parts.append((keys, counts))
        self.n += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, _, counts = _added(*[np.concatenate(c) for c in zip(*self.parts)])
        self.parts, self.n = [(keys, counts)], len(keys)
        return self.parts[0]

    def full(self) -> bool:
        if self.n > HELD:
            self.merged()
        return self.n > HELD // 2

    def clear(self) -> None:
        self.parts, self.n = [], 0


def _long(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


@contextlib.contextmanager
def _shuffles_let_go(df: DataFrame):
    """Jobs run inside delete their shuffles when they end; the session's own setting comes back after."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        spark.conf.set(name, before)


def _delete(table: DataFrame) -> None:
    """Remove the folder of a stored table that nothing reads any more."""
    files, spark = table.inputFiles(), table.sparkSession
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def counted(texts_: DataFrame) -> DataFrame:
    """(k, c): how often each token occurs in the whole of ``texts_`` (one column)."""
    kind = pa.schema([("k", pa.int64()), ("c", pa.int64())])

    def run(batches):
        counter = Counter()

        def held():
            keys, counts = counter.merged()
            return batch_of(kind, [_long(keys), counts])

        for piece in pieces(batches, 0, LARGE):
            counter.add(tokens(piece.column(0))[0])
            if counter.full():
                yield held()
                counter.clear()
        if counter.n:
            yield held()

    return texts_.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


class Filter:
    """Which keys may be in a table: none of its keys is refused, few others are let through."""

    def __init__(self, keys: DataFrame):
        """Of the one column of ``keys``; a group fills whole blocks."""
        count, width = keys.count(), 0
        while 1 << width < min(BLOCKS, count / PER_BLOCK):
            width += 1
        self.blocks, self.shift = 1 << width, U64(64 - width)
        dealt = min(width, 8)
        size = (BLOCK << width) >> dealt
        kind = pa.schema([("range", pa.int64()), ("block", pa.binary())])

        def packed(held):
            return batch_of(kind, [*_blocks(np.sort(np.concatenate(held)), dealt, head=True)])

        def run(batches):
            held, n = [], 0
            for batch in batches:
                held.append(_unsigned(batch.column(0).to_numpy()))
                n += batch.num_rows
                if n > HELD_ASKED:
                    yield packed(held)
                    held, n = [], 0
            if n:
                yield packed(held)

        def fill(table: pa.Table) -> pa.Table:
            own = np.zeros(size, bool)
            for block in table["block"].to_pylist():
                found = _keys(block, len(block) // 8)
                for i in range(3):
                    own[self._place(found, i) - table["range"][0].as_py() * size] = True
            return pa.Table.from_batches([batch_of(kind, [table["range"][:1].combine_chunks(), [np.packbits(own, bitorder="little").tobytes()]])])

        ddl = "range long, block binary"
        filled = keys.mapInArrow(run, ddl).groupBy("range").applyInArrow(fill, ddl).toArrow()
        self.bits = np.zeros(self.blocks * BLOCK // 8, np.uint8)
        for number, bits in zip(filled["range"].to_pylist(), filled["block"].to_pylist()):
            self.bits[number * size // 8 : (number + 1) * size // 8] = np.frombuffer(bits, np.uint8)

    def _place(self, keys: np.ndarray, i: int) -> np.ndarray:
        """Bit ``i`` of three: the block follows from the first bits of a key, the place there from others."""
        block = keys >> self.shift if self.blocks > 1 else U64(0)
        return (block * U64(BLOCK) + ((keys >> U64(15 * i)) & U64(BLOCK - 1))).view(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = self._bit(self._place(keys, 0))
        for i in (1, 2):  # most keys that are not there fail the first time
            left = np.flatnonzero(found)
            found[left] = self._bit(self._place(keys[left], i))
        return found

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).view(bool)


class Tree:
    """The model: training tokens ``n`` and types ``v``, the most frequent words, and for contexts
    of i + 1 words ``states[i]``: tables of the kept contexts and of the pairs, see _level."""

    def __init__(self, n: int, v: int, heads: tuple[np.ndarray, np.ndarray], head: int):
        self.n, self.v, self.room = n, v, head
        order = np.argsort(heads[0])
        self.frequent, self.frequent_count = heads[0][order], heads[1][order]
        self.states: list[tuple[DataFrame, DataFrame]] = []

    @functools.cached_property
    def levels(self) -> list[dict[str, np.ndarray]]:
        """The kept states as sorted arrays, for a look at small trees."""
        out = []
        for contexts, pairs in self.states:
            own = contexts.toArrow()
            kept = pairs.filter("more is not null").select("key", "share").toArrow()
            own, kept = [[t.column(i).to_numpy() for i in range(2)] for t in (own.select(["ctx", "rest"]), kept)]
            level = {}
            for (at, name), (key, value) in zip((("contexts", "rest"), ("pairs", "shares")), (own, kept)):
                order = np.argsort(_unsigned(key))
                level |= {at: _unsigned(key)[order], name: value[order]}
            out.append(level)
        return out


def _unsigned(values) -> np.ndarray:
    return np.ascontiguousarray(values).view(U64)


def _shares(tree: Tree, context: np.ndarray, symbol: np.ndarray, length: int) -> np.ndarray:
    """P(frequent symbol | kept context of ``length`` words, one at most)."""
    value = (tree.frequent_count[symbol] + SMOOTH) / (tree.n + SMOOTH * (tree.v + 1))
    for level in tree.levels[:length]:
        at, kept = positions(level["contexts"], context)
        pair, there = positions(level["pairs"], appended(context, tree.frequent[symbol]))
        extra = np.where(there, level["shares"][pair], 0.0)
        value = np.where(kept, extra + level["rest"][at] * value, value)
    return value


def _head(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, as many as ``most`` takes, from a small histogram of counts."""
    bucket = F.floor(F.log2(count) * 4)
    tops, floor = 0, None
    for b, rows in sorted(table.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        tops += rows
        if tops > most:
            break
        floor = b
    return table.filter(bucket >= floor if floor is not None else F.lit(False))


def learn(texts_: DataFrame, depth: int = DEPTH, head: int = HEAD) -> tuple[Tree, DataFrame]:
    """The tree from all of ``texts_`` (one column) and the table of all tokens' counts."""
    with _shuffles_let_go(texts_):
        vocabulary = stored(counted(texts_), "suffix-tree")
        n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        rows = _head(vocabulary, "c", head).toArrow()
        tree = Tree(n, v, tuple(rows.column(c).to_numpy().astype(kind) for c, kind in (("k", U64), ("c", np.int64))), head)
        # Sequences of one word more at each level: their hash, count, P(last | others).
        p = (F.col("c") + F.lit(SMOOTH)) / F.lit(n + SMOOTH * (v + 1))
        known = vocabulary.filter(F.col("c") >= LEAST).select(F.col("k").alias("key"), "c", p.alias("p"))
        most = max(n // BLOCK_PAIRS, 4 * int(texts_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        for length in range(1, depth + 1):
            contexts, known = _level(texts_, known, length, most.bit_length(), length == depth)
            if known.isEmpty():
                _delete(contexts)
                _delete(known)
                break
            tree.states.append((contexts, known))
    return tree, vocabulary


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, all first bytes, then all second ones: the high ones are mostly zero, and
    the shuffle's compression takes them out."""
    return np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(block: bytes, n: int) -> np.ndarray:
    """The ``n`` sorted keys that a block begins with."""
    return np.frombuffer(block, np.uint8, 8 * n).reshape(8, n).T.copy().view(U64).ravel().cumsum(dtype=U64)


def _blocks(keys: np.ndarray, bits: int, *columns: np.ndarray, head: bool = False) -> tuple[np.ndarray, list[bytes]]:
    """Ranges (the first ``bits`` bits) of sorted keys and what stands there, packed: the keys if at the ``head``, then the columns."""
    ranges = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    first = _steps if head else lambda _: b""
    return ranges[cuts[:-1]], [b"".join([first(keys[a:b]), *(c[a:b].tobytes() for c in columns)]) for a, b in zip(cuts[:-1], cuts[1:])]


def _columns(block: bytes, *kinds, head: bool = False) -> list[np.ndarray]:
    """The columns of a packed block, and the keys at its ``head`` before them."""
    sizes = [np.dtype(kind).itemsize for kind in kinds]
    n = len(block) // (sum(sizes) + 8 * head)
    at, out = 8 * n * head, [_keys(block, n)] if head else []
    for kind, width in zip(kinds, sizes):
        out.append(np.frombuffer(block, kind, n, at))
        at += width * n
    return out


def _pairs(shared, length: int, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and shorter pair of the pairs that may occur LEAST times."""
    *_, (own, fine) = grams(hashes, bounds, length)
    some = shared.value.has(own) & fine
    some[1:] &= some[:-1]
    # A text's first token has nothing before it.
    some[bounds[:-1][np.diff(bounds) > 0]] = False
    return before(own)[some], own[some]


def _dealt(shared, length: int, bits: int):
    """Task function: texts to packed blocks (range of the pairs' hash, pairs with their counts)."""
    kind = pa.schema([("range", pa.int64()), ("pairs", pa.binary())])

    def packed(held):
        context, short = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        keys, at, counts = _added(appended(context, short))
        return batch_of(kind, [*_blocks(keys, bits, context[at], short[at], counts.astype(np.uint32))])

    def run(batches):
        held, n = [], 0
        for piece in pieces(batches, 0, LARGE):
            held.append(_pairs(shared, length, *tokens(piece.column(0))))
            n += len(held[-1][0])
            if n > HELD_PAIRS:
                yield packed(held)
                n = 0
        if n:
            yield packed(held)

    return run


def _frequent():
    """Group function: the blocks of one range to the pairs (key, ctx, short, c) that occur LEAST times."""
    kind = pa.schema([(x, pa.int64()) for x in ("key", "ctx", "short", "c")])

    def run(table: pa.Table) -> pa.Table:
        parts = [_columns(block, U64, U64, np.uint32) for block in table["pairs"].to_pylist()]
        context, short, counts = [np.concatenate(c) for c in zip(*parts)]
        keys, at, counts = _added(appended(context, short), counts)
        often = counts >= LEAST
        at = at[often]
        return pa.Table.from_batches([batch_of(kind, [_long(keys[often]), _long(context[at]), _long(short[at]), counts[often]])])

    return run


def _level(texts_: DataFrame, known: DataFrame, length: int, bits: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Count and test the contexts of ``length`` words.

    ``known`` has the sequences of so many words that occur LEAST times.  Returns the kept contexts (ctx, total,
    rest) and the pairs that occur LEAST times (key, c, p, share, more), of which those after a kept context have
    ``share`` and ``more``: what log10 P grows by beside log10 rest.  The ``last`` level has only these.
    """
    shared = texts_.sparkSession.sparkContext.broadcast(Filter(known.select("key")))
    blocks = texts_.mapInArrow(_dealt(shared, length, bits), "range long, pairs binary")
    pairs = blocks.groupBy("range").applyInArrow(_frequent(), "key long, ctx long, short long, c long")
    expected = known.select(F.col("key").alias("short"), F.col("p").alias("expected")).hint("shuffle_hash")
    pairs = stored(pairs.join(expected, "short").select("key", "ctx", "c", "expected"), "suffix-tree")
    shared.unpersist()
    sums = pairs.groupBy("ctx").agg(
        F.count("*").alias("free"), F.sum("c").alias("seen"), F.sum("expected").alias("covered"),
        F.sum(F.col("c") * F.log(F.col("c") / F.col("expected"))).alias("against"),
    )
    sums = sums.join(known.select(F.col("key").alias("ctx"), F.col("c").alias("total")), "ctx")
    # Log-likelihood ratio of the counted pairs and of all other symbols taken together.
    gain = F.col("against") - F.col("seen") * F.log("total")
    left = (F.col("total") - F.col("seen")).cast("double")
    other = F.when(left > 0, left * F.log(left / F.col("total") / F.greatest(1 - F.col("covered"), F.lit(1e-12)))).otherwise(0.0)
    diverges = 2 * (gain + other) > F.col("free") + 4 * F.sqrt(2 * F.col("free"))
    taken = (F.col("seen") - F.lit(DISCOUNT) * F.col("free")) / F.col("total")
    contexts = stored(sums.filter(diverges).select("ctx", "total", (1 - taken).alias("rest")), "suffix-tree")
    both = pairs.join(contexts, "ctx", "inner" if last else "left")
    share = (F.col("c") - F.lit(DISCOUNT)) / F.col("total")
    lower = F.col("rest") * F.col("expected")
    p = F.coalesce(share + lower, F.col("expected"))
    made = stored(both.select("key", "c", p.alias("p"), share.alias("share"), F.log10(p / lower).alias("more")), "suffix-tree")
    _delete(pairs)
    return contexts, made


def _salt(length: int, pair: bool) -> np.ndarray:
    return mixed(np.array([2 * length + pair], U64))


def _states(tree: Tree) -> DataFrame | None:
    """(k, c, v): what each kept context and each pair after one adds to log10 P."""
    out = None
    for i, (contexts, pairs) in enumerate(tree.states):
        salts = [int(_long(_salt(i + 1, pair))[0]) for pair in (False, True)]
        own = contexts.select(F.col("ctx").bitwiseXOR(F.lit(salts[0])).alias("k"), F.col("total").alias("c"), F.log10("rest").alias("v"))
        own = own.union(pairs.filter("more is not null").select(F.col("key").bitwiseXOR(F.lit(salts[1])), "c", "more"))
        out = own if out is None else out.union(own)
    return out


class Lookup:
    """What the tasks that score need: the frequent words and states, and which states there are."""

    def __init__(self, tree: Tree, states: DataFrame | None):
        self.depth = len(tree.states)
        # A word outside the head counts as never seen here; what its count adds comes from the table.
        self.frequent, of = tree.frequent, tree.n + SMOOTH * (tree.v + 1)
        self.base, self.absent = np.log10((tree.frequent_count + SMOOTH) / of), np.log10(SMOOTH / of)
        if states is not None:
            top = _head(states, "c", STATES * tree.room).toArrow()
            keys = _unsigned(top["k"].to_numpy())
            order = np.argsort(keys)
            self.keys, self.values = keys[order], top["v"].to_numpy()[order]
            self.filter = Filter(states.select("k"))
            # The frequent words as contexts.
            own = self.frequent ^ _salt(1, False)
            at, self.sure = positions(self.keys, own)
            self.rest, self.kept = np.where(self.sure, self.values[at] if len(self.keys) else 0.0, 0.0), self.filter.has(own)


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
)
_KEPT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
#: What is dealt to the ranges of the states and (below zero) of the words: the tables, the keys that a chunk of texts asks
#: for, and the chunk's rows, which only pass.
_DEALT = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("block", pa.binary())])
_DEALT_DDL = "range long, chunk long, block binary"
_TABLE, _ROWS = -1, 1 << 40


def _range(ranges: np.ndarray, words: bool) -> np.ndarray:
    return -1 - ranges if words else ranges


def _tables(words: bool, bits: int):
    """Task function: (key, value) to packed blocks by ranges of the key."""

    def packed(held):
        keys, values = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(keys)
        ranges, blocks = _blocks(keys[order], bits, values[order], head=True)
        return batch_of(_DEALT, [_range(ranges, words), np.full(len(ranges), _TABLE), blocks])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((_unsigned(batch.column(0).to_numpy()), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > HELD_ASKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


class Chunk:
    """Rows that a task has scored by the head, and the keys whose values they lack."""

    def __init__(self, number: int):
        self.number, self.rows, self.n, self.asked = number, [], 0, 0
        self.keys: dict[bool, list] = {True: [], False: []}

    def add(self, rows: pa.RecordBatch, **asked: tuple[np.ndarray, np.ndarray]) -> None:
        """Rows, and by ``words`` and ``states`` the keys with the rows (from 0) that ask."""
        for name, (keys, own) in asked.items():
            self.keys[name == "words"].append((keys, (own + self.n).astype(np.uint16)))
            self.asked += len(keys)
        self.rows.append(rows)
        self.n += rows.num_rows

    def packed(self, bits: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _KEPT) as stream:
            for rows in self.rows:
                stream.write_batch(rows)
        ranges, blocks = [np.array([_ROWS + self.number])], [sink.getvalue().to_pybytes()]
        for words, held in self.keys.items():
            keys, own = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(keys)
            at, own = _blocks(keys[order], bits, own[order], head=True)
            ranges.append(_range(at, words))
            blocks += own
        return batch_of(_DEALT, [np.concatenate(ranges), np.full(len(blocks), self.number), blocks])


def _score(shared, bits: int):
    """Task function: texts (doc_id, held_out, text) to their rows, scored by the head, and the keys they ask the tables for."""

    def run(batches):
        tree: Lookup = shared.value
        chunk = Chunk(TaskContext.get().partitionId() << 20)
        for piece in pieces(batches, 2, LARGE):
            for at in range(0, piece.num_rows, ROWS):
                part = piece.slice(at, ROWS)
                if chunk.n and (chunk.n + part.num_rows > ROWS or chunk.asked > HELD_ASKED):
                    yield chunk.packed(bits)
                    chunk = Chunk(chunk.number + 1)
                rows, asked = _by_head(tree, part)
                chunk.add(rows, **asked)
        if chunk.n:
            yield chunk.packed(bits)

    return run


def _by_head(tree: Lookup, piece: pa.RecordBatch) -> tuple[pa.RecordBatch, dict]:
    """Rows of the texts, and what they ask the tables for."""
    hashes, bounds = tokens(piece.column(2))
    row = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
    # Sorted keys find their places in the tables from near to near.
    order = np.argsort(hashes)
    word, known = np.empty(len(hashes), np.int64), np.empty(len(hashes), bool)
    word[order], known[order] = positions(tree.frequent, hashes[order])
    base = row_sums(np.where(known, tree.base[word] if len(tree.base) else 0.0, tree.absent), bounds)
    added, keys, places = np.zeros(len(hashes)), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    last = np.zeros(len(hashes), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    after, sure, rare = (np.zeros(len(hashes), bool) for _ in range(3))
    for length, (words, fine) in enumerate(grams(hashes, bounds, tree.depth + 1) if tree.depth else ()):
        # These words are a context of the token after them, and a pair of the last with the others, if these are a state.
        # What is no pair after a context that surely is one is rare, and so is all that holds it.
        rare = rare | before(rare)
        for level, pair in [(length, True)] * (length > 0) + [(length + 1, False)] * (length < tree.depth):
            some = np.flatnonzero(fine & ~rare & (after if pair else ~last))
            if not pair:
                after, sure = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
            if not length and len(tree.base):
                own = some[known[some] & tree.kept[word[some]]]
                after[own + 1], sure[own + 1] = True, tree.sure[word[own]]
                added[own] = tree.rest[word[own]]
                own = own[~tree.sure[word[own]]]
                keys.append(words[own] ^ _salt(level, pair))
                places.append(own)
                some = some[~known[some]]
            key = words[some] ^ _salt(level, pair)
            order = np.argsort(key)
            key, some = key[order], some[order]
            there = tree.filter.has(key)
            if pair:
                gone = some[~there]
                rare[gone[sure[gone]]] = True
            key, some = key[there], some[there]
            at, there = positions(tree.keys, key)
            if not pair:
                after[some + 1] = True
                sure[some[there] + 1] = True
            added[some[there]] += tree.values[at[there]]
            keys.append(key[~there])
            places.append(some[~there])
    keys, places = np.concatenate(keys), np.concatenate(places)
    other = np.flatnonzero(~known)
    rows = [piece.column(0), piece.column(1), np.diff(bounds), row_sums(known, bounds), base, base + row_sums(added, bounds)]
    return batch_of(_KEPT, rows), {"words": (hashes[other], row[other]), "states": (keys, row[places])}


def _answered(table: pa.Table) -> pa.Table:
    """Group function: one range of a table and of what is asked of it, to the sums that each chunk's rows get."""
    place, chunks, blocks = table["range"][0].as_py(), table["chunk"].to_numpy(), table["block"].to_pylist()
    if place >= _ROWS:
        return table
    parts = [_columns(block, np.float64, head=True) for chunk, block in zip(chunks, blocks) if chunk == _TABLE]
    keys, values = [np.concatenate(c) for c in zip(*parts)] if parts else (np.zeros(0, U64), np.zeros(0))
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    out = []
    for chunk, block in zip(chunks, blocks):
        if chunk != _TABLE:
            asked, own = _columns(block, np.uint16, head=True)
            at, there = positions(keys, asked)
            own = own[there].astype(np.int64)
            times = np.bincount(own)
            rows = np.flatnonzero(times)
            found = [np.bincount(own, values[at[there]] if len(keys) else None)[rows], np.diff(rows, prepend=0).astype(np.uint16)]
            if place < 0:
                found.append(times[rows].astype(np.uint32))
            out.append((chunk, b"".join(x.tobytes() for x in found)))
    return pa.Table.from_batches([batch_of(_DEALT, [np.full(len(out), place), [x[0] for x in out], [x[1] for x in out]])])


def _summed(table: pa.Table) -> pa.Table:
    """Group function: the rows of one chunk with all that the tables add to them."""
    more: dict[bool, list] = {True: [], False: []}
    for place, block in zip(table["range"].to_pylist(), table["block"].to_pylist()):
        if place >= _ROWS:
            rows = pa.ipc.open_stream(block).read_all().combine_chunks()
        else:
            more[place < 0].append(_columns(block, np.float64, np.uint16, *[np.uint32] * (place < 0)))
    known, base, score_ = (rows.column(c).to_numpy().copy() for c in ("n_known", "base", "score"))
    for words, parts in more.items():
        for sums, steps, *times in parts:  # a part has no row twice
            own = steps.cumsum(dtype=np.int64)
            score_[own] += sums
            if words:
                base[own] += sums
                known[own] += times[0]
    return pa.Table.from_batches([batch_of(_KEPT, [*(rows.column(i).combine_chunks() for i in range(3)), known, base, score_])])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, tree: Tree, vocabulary: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Scores of ``docs`` (doc_id, held_out, text); ``states`` if they are stored already."""
    spark = docs.sparkSession
    with _shuffles_let_go(docs):
        if states is None and tree.states:
            states = stored(_states(tree), "suffix-tree")
        most = max((0 if states is None else states.count()) // PER_RANGE, int(spark.conf.get("spark.sql.shuffle.partitions")))
        bits = max(1, most.bit_length())
        shared = spark.sparkContext.broadcast(Lookup(tree, states))
        dealt = docs.select("doc_id", "held_out", "text").mapInArrow(_score(shared, bits), _DEALT_DDL)
        own = vocabulary.select("k", (F.log10(F.col("c") + F.lit(SMOOTH)) - F.log10(F.lit(SMOOTH))).alias("v"))
        dealt = dealt.union(own.mapInArrow(_tables(True, bits), _DEALT_DDL))
        if states is not None:
            dealt = dealt.union(states.select("k", "v").mapInArrow(_tables(False, bits), _DEALT_DDL))
        answers = dealt.groupBy("range").applyInArrow(_answered, _DEALT_DDL)
        rows = stored(answers.groupBy("chunk").applyInArrow(_summed, _KEPT_DDL), "suffix-tree")
        shared.unpersist()
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )


def digest(docs: DataFrame) -> DataFrame:
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    tree, vocabulary = learn(marked.filter(~F.col("held_out")).select("text"))
    states = None
    if tree.states:
        states = stored(_states(tree), "suffix-tree")
        for table in itertools.chain(*tree.states):
            _delete(table)
    return score(marked, tree, vocabulary, states)
