"""Collocations by vertical partitioning: suffix subtrees of depth three, built group by group.

Texts (A-Z lower-cased, null is empty) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``; everything is per language, null is ``und``.  A suffix is a word with the two
words after it in its piece.

* The prefixes of the subtrees are words.  Their counts (one pass over all texts) cut the space
  of prefix hashes into consecutive groups of at most ``budget`` suffixes each.
* A prefix of more suffixes than that is extended by its next word, and one that is still too frequent by
  the third: extended prefixes are dealt by their own hash.  Equal suffixes are added up in the tasks
  that read the texts, so however frequent a prefix of three words is, it is one leaf.
* A group's suffixes travel as packed blocks (own dictionary of words, narrow numbers).  Each group sorts its suffixes into a
  subtree and reads all counts from the leaves' totals.

Words with fewer than LEAST occurrences cannot stand in a phrase with so many and end a suffix.  They are refused
by a filter that lets a few too many through and none too few: their phrases then fall below LEAST.

The phrases' parts get their counts by joins, scores are exact (decimals), the ranking is done in
salted parts first.  Words are known by 64-bit hashes of language and word; strings come back from the counted
words.  Rows repeated count repeatedly; ids do not matter; without phrases the result is empty.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import LARGE, LOWER, U64, batch_of, mixed, per_row, pieces, ragged, span_hashes, spans, stored, texts
from ohmwatch.llm.suffix_tree import Filter, appended

#: Occurrences from which a phrase is a candidate; share (percent) of a longer one that absorbs it; rows per language.
LEAST = 10
ABSORBED = 50
TOP = 2000
#: Suffixes of a group; groups at most (then they grow).
BUDGET, GROUPS = 1 << 20, 1 << 20
#: Distinct words or suffixes that a task holds before it hands them on.
HELD = 1 << 21
#: Parts of a language that are ranked apart before the whole.
SALTS = 64

# The bytes that end a piece, and those between words.
PIECE_ENDS = tuple(b".,;:!?\x0a\x0b\x0c\x0d")
GAPS = (0x09, 0x20)

_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_INSIDE = ~_ENDS
_INSIDE[list(GAPS)] = False


def words(lang, text):
    """Bytes, starts and ends of all words, their keys (language and word), their rows, and whether
    the next word follows in the same piece."""
    data, offsets = texts(text)
    data = LOWER[data]
    starts, ends = spans(_INSIDE[data], offsets)
    first = per_row(starts, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names, cuts = texts(lang)
    own = span_hashes(names, cuts[:-1], cuts[1:])
    keys = appended(own[row], span_hashes(data, starts, ends))
    piece = np.cumsum(_ENDS[data])[starts] if len(starts) else starts
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    return data, starts, ends, keys, row, joined


def _unique(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one of each, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
    return keys[at], order[at], sums


class _Sums:
    """Counts by key with the columns that go with a key, added up as they come."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys, counts, columns) -> bool:
        """True when it holds so much that it should be emptied."""
        keys, at, counts = _unique(keys, counts)
        self.parts.append((keys, counts, [c.take(pa.array(at)) if isinstance(c, pa.Array) else c[at] for c in columns]))
        self.n += len(keys)
        if self.n > HELD:
            self.parts = [self.merged()]
            self.n = len(self.parts[0][0])
        return self.n > HELD // 2

    def merged(self):
        keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in range(2))
        columns = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*(p[2] for p in self.parts))]
        keys, at, counts = _unique(keys, counts)
        return keys, counts, [c.take(pa.array(at)) if isinstance(c, pa.Array) else c[at] for c in columns]

    def taken(self):
        out = self.merged()
        self.parts, self.n = [], 0
        return out


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _count_words(batches):
    kind = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])

    def out():
        keys, counts, (lang, word) = held.taken()
        return batch_of(kind, [_long(keys), lang, word, counts])

    held = _Sums()
    for piece in pieces(batches, 1, LARGE):
        data, starts, ends, keys, row, _ = words(piece.column(0), piece.column(1))
        keys, at, counts = _unique(keys, np.ones(len(keys), np.int64))
        size = ends[at] - starts[at]
        raw = data[ragged(starts[at], size)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        word = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw))
        if held.add(keys, counts, [piece.column(0).take(pa.array(row[at])), word]):
            yield out()
    if held.n:
        yield out()


def _following(keys: np.ndarray, joined: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of two words or more: first, second and third word, 0 where the suffix has ended."""
    joined = joined & fine
    joined[:-1] &= fine[1:]
    at = np.flatnonzero(joined)
    third = np.concatenate([keys, np.zeros(2, U64)])[at + 2]
    third[~np.concatenate([joined, [False]])[at + 1]] = 0
    return keys[at], keys[at + 1], third


def pack_block(columns: tuple[np.ndarray, ...], counts: np.ndarray) -> bytes:
    """Three columns of word keys and their counts: a dictionary of the words, then numbers as narrow as they go."""
    known, place = np.unique(np.concatenate(columns), return_inverse=True)
    wide, deep = (next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w)) for most in (len(known), int(counts.max())))
    head = struct.pack("<QQBB", len(known), len(counts), wide, deep)
    return head + known.astype("<u8").tobytes() + place.astype(f"<u{wide}").tobytes() + counts.astype(f"<u{deep}").tobytes()


def unpack_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_known, n, wide, deep = struct.unpack_from("<QQBB", raw)
    at = struct.calcsize("<QQBB")
    known = np.frombuffer(raw, "<u8", n_known, at)
    place = np.frombuffer(raw, f"<u{wide}", 3 * n, at + 8 * n_known)
    counts = np.frombuffer(raw, f"<u{deep}", n, at + 8 * n_known + wide * 3 * n)
    first, second, third = known[place].reshape(3, n)
    return first, second, third, counts.astype(np.int64)


class Groups:
    """Which group a suffix belongs to.

    ``bounds`` cut the hashes of single words; ``hot`` words are extended to two, ``hot_pairs`` to three
    words, and dealt by hash into ``pair_groups`` and ``triple_groups``.
    """

    def __init__(self, bounds, hot, pair_groups, hot_pairs, pair_counts, triple_groups):
        self.bounds, self.hot, self.pair_groups = bounds, hot, pair_groups
        self.hot_pairs, self.pair_counts, self.triple_groups = hot_pairs, pair_counts, triple_groups

    def of(self, first, second, third) -> np.ndarray:
        out = np.searchsorted(self.bounds, first, "right").astype(np.int64)
        hot = np.flatnonzero(np.isin(first, self.hot))
        if len(hot):
            pair = appended(first[hot], second[hot])
            out[hot] = len(self.bounds) + 1 + (pair % U64(self.pair_groups)).astype(np.int64)
            more = np.isin(pair, self.hot_pairs)
            triple = appended(pair[more], third[hot[more]])
            out[hot[more]] = len(self.bounds) + 1 + self.pair_groups + (triple % U64(max(1, self.triple_groups))).astype(np.int64)
        return out


def _deal(shared_filter, shared_groups):
    kind = pa.schema([("group", pa.int64()), ("block", pa.binary())])

    def run(batches):
        groups: Groups = shared_groups.value

        def out():
            _, counts, columns = held.taken()
            group = groups.of(*columns)
            order = np.argsort(group, kind="stable")
            group, counts, columns = group[order], counts[order], [c[order] for c in columns]
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(cuts[1:], len(group))
            for lo in range(0, len(cuts), 256):
                own = list(zip(cuts[lo : lo + 256].tolist(), ends[lo : lo + 256].tolist()))
                blocks = [pack_block(tuple(c[s:e] for c in columns), counts[s:e]) for s, e in own]
                yield batch_of(kind, [group[[s for s, _ in own]], blocks])

        held = _Sums()
        for piece in pieces(batches, 1, LARGE):
            _, _, _, keys, _, joined = words(piece.column(0), piece.column(1))
            columns = _following(keys, joined, shared_filter.value.has(keys))
            if len(columns[0]) and held.add(appended(appended(columns[0], columns[1]), columns[2]), np.ones(len(columns[0]), np.int64), columns):
                yield from out()
        if held.n:
            yield from out()

    return run


_PHRASES = pa.schema([(x, pa.int64()) for x in ("w1", "w2", "w3", "pair", "tail", "a", "pair_count")])
_PHRASES_DDL = ", ".join(f"{x} long" for x in _PHRASES.names)


def subtree(first, second, third, counts, hot_pairs, pair_counts, least: int) -> list[np.ndarray]:
    """Phrases of ``least`` occurrences in the tree of these suffixes: the columns of _PHRASES; w3 is 0 for two words."""
    order = np.lexsort((third, second, first))
    first, second, third, counts = first[order], second[order], third[order], counts[order]
    n = len(order)
    new_pair, new_leaf = np.ones(n, bool), np.ones(n, bool)
    new_pair[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    new_leaf[1:] = new_pair[1:] | (third[1:] != third[:-1])
    leaf, node = np.flatnonzero(new_leaf), np.flatnonzero(new_pair)
    leaf_total, node_total = np.add.reduceat(counts, leaf), np.add.reduceat(counts, node)
    pair = appended(first[node], second[node])
    # A prefix of three words has its pair's leaves in other groups too.
    whole = np.ones(len(node), bool)
    if len(hot_pairs):
        at = np.minimum(np.searchsorted(hot_pairs, pair), len(hot_pairs) - 1)
        whole = hot_pairs[at] != pair
        node_total = np.where(whole, node_total, pair_counts[at])
    parent = np.cumsum(new_pair)[leaf] - 1
    keep = np.flatnonzero((leaf_total >= least) & (third[leaf] != 0))
    at, up = leaf[keep], parent[keep]
    short = np.flatnonzero(whole & (node_total >= least))
    own = node[short]
    zero = np.zeros(len(short), U64)
    return [
        np.concatenate([first[own], first[at]]), np.concatenate([second[own], second[at]]), np.concatenate([zero, third[at]]),
        np.concatenate([pair[short], pair[up]]), np.concatenate([zero, appended(second[at], third[at])]),
        np.concatenate([node_total[short], leaf_total[keep]]), np.concatenate([node_total[short], node_total[up]]),
    ]


def _grow(shared_groups, least: int):
    def run(table: pa.Table) -> pa.Table:
        groups: Groups = shared_groups.value
        parts = [unpack_block(raw.as_py()) for raw in table.column("block")]
        columns = subtree(*[np.concatenate(c) for c in zip(*parts)], groups.hot_pairs, groups.pair_counts, least)
        return pa.table([pa.array(_long(c.astype(U64)), pa.int64()) for c in columns], schema=_PHRASES)

    return run


def _count_pairs(shared_hot, shared_filter):
    """Task function: pairs after the hot words, as (w1, w2, pair, c)."""
    kind = pa.schema([(x, pa.int64()) for x in ("w1", "w2", "pair", "c")])

    def run(batches):
        held = _Sums()

        def out():
            keys, counts, columns = held.taken()
            return batch_of(kind, [*[_long(c) for c in columns], _long(keys), counts])

        for piece in pieces(batches, 1, LARGE):
            _, _, _, keys, _, joined = words(piece.column(0), piece.column(1))
            first, second, _ = _following(keys, joined, shared_filter.value.has(keys))
            some = np.isin(first, shared_hot.value)
            first, second = first[some], second[some]
            if len(first) and held.add(appended(first, second), np.ones(len(first), np.int64), [first, second]):
                yield out()
        if held.n:
            yield out()

    return run


def _unsigned(values) -> np.ndarray:
    return np.ascontiguousarray(values).view(U64)


def _bounds(frequent: DataFrame, hot: DataFrame, total: int, budget: int) -> np.ndarray:
    """Hashes that cut the words' hashes into runs of at most ``budget`` occurrences, from sums over equal slices."""
    bits = min(22, max(1, int(np.ceil(np.log2(max(2, 8 * total / budget))))))
    slices = frequent.join(hot.select("key"), "key", "left_anti").groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slice"))
    rows = slices.agg(F.sum("c").alias("c")).orderBy("slice").toArrow()
    cuts, own = [], 0
    for slice_, c in zip(rows["slice"].to_pylist(), rows["c"].to_pylist()):
        if own and own + c > budget:
            cuts.append(slice_ << (64 - bits))
            own = 0
        own += c
    return np.array(cuts, U64)


def phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All phrases of two and three words with ``least`` occurrences, as (w1, w2, w3, pair, tail, a, pair_count): word keys, key and
    count of the first two words, key of the last two; and the counted words (key, lang, word, c)."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = own.mapInArrow(_count_words, "key long, lang string, word string, c long")
    vocabulary = stored(counted.groupBy("key", "lang", "word").agg(F.sum("c").alias("c")), "collocations-words")
    frequent = vocabulary.filter(F.col("c") >= least)
    total = frequent.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // GROUPS))
    allowed = spark.sparkContext.broadcast(Filter(frequent.select("key")))

    # Fewer than total / budget words, at most GROUPS, can be hot.
    hot = frequent.filter(F.col("c") > budget).select("key", "c")
    hot_rows = hot.toArrow()
    hot_keys = np.sort(_unsigned(hot_rows["key"].to_numpy()))
    hot_total = int(np.sum(hot_rows["c"].to_numpy()))
    hot_pairs, pair_counts, extra = np.zeros(0, U64), np.zeros(0, np.int64), None
    if len(hot_keys):
        pairs = own.mapInArrow(_count_pairs(spark.sparkContext.broadcast(hot_keys), allowed), "w1 long, w2 long, pair long, c long")
        extra = stored(pairs.groupBy("w1", "w2", "pair").agg(F.sum("c").alias("c")).filter(F.col("c") > budget), "collocations-pairs")
        found = extra.select("pair", "c").toArrow()
        hot_pairs, pair_counts = _unsigned(found["pair"].to_numpy()), found["c"].to_numpy()
        order = np.argsort(hot_pairs)
        hot_pairs, pair_counts = hot_pairs[order], pair_counts[order]
    parts = [1 + 2 * int(x) // budget for x in (hot_total, pair_counts.sum())]
    groups = spark.sparkContext.broadcast(Groups(_bounds(frequent, hot, total, budget), hot_keys, parts[0], hot_pairs, pair_counts, parts[1]))

    dealt = own.mapInArrow(_deal(allowed, groups), "group long, block binary")
    found = dealt.groupBy("group").applyInArrow(_grow(groups, least), _PHRASES_DDL)
    if extra is not None:
        zero = F.lit(0).cast("long")
        found = found.union(extra.select("w1", "w2", zero, "pair", zero, "c", "c"))
    return stored(found, "collocations-phrases"), vocabulary


def collocations(docs: DataFrame, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    found, vocabulary = phrases(docs, least, budget)
    totals = vocabulary.groupBy("lang").agg(F.sum("c").alias("n"))
    known = vocabulary.filter(F.col("c") >= least)
    two, three = found.filter("w3 = 0"), found.filter("w3 <> 0")

    # A phrase of two words goes if some phrase of three holds it and occurs half as often.
    within = three.select("pair", "a").union(three.select(F.col("tail").alias("pair"), "a"))
    within = within.groupBy("pair").agg(F.max("a").alias("longer"))
    two = two.join(within, "pair", "left").filter(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))

    def word(name: str) -> DataFrame:
        return known.select(F.col("key").alias(name), F.col("c").alias(f"{name}_c"), F.col("word").alias(f"{name}_word"))

    first = known.select(F.col("key").alias("w1"), "lang", F.col("c").alias("w1_c"), F.col("word").alias("w1_word"))
    tails = found.filter("w3 = 0").select(F.col("pair").alias("tail"), F.col("a").alias("tail_c"))
    two = two.join(word("w2"), "w2").select(
        "w1", F.lit(None).cast("long").alias("middle"), F.col("w2_word").alias("last_word"), "a",
        F.lit(1).alias("cut"), F.lit(None).cast("long").alias("pair_count"), F.lit(None).cast("long").alias("last_c"), F.col("w2_c").alias("rest_c"),
    )
    three = three.join(tails, "tail").join(word("w3"), "w3").select(
        "w1", F.col("w2").alias("middle"), F.col("w3_word").alias("last_word"), "a",
        F.lit(2).alias("cut"), "pair_count", F.col("w3_c").alias("last_c"), F.col("tail_c").alias("rest_c"),
    )
    scored = two.union(three).join(first, "w1")

    def exact(left: str, right: str) -> Column:
        return F.expr(
            f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(30,0)))"
            f" div (CAST({left} AS DECIMAL(15,0)) * CAST({right} AS DECIMAL(15,0))) AS BIGINT)"
        )

    scored = scored.withColumn("at_1", exact("w1_c", "rest_c")).withColumn("at_2", F.when(F.col("cut") == 2, exact("pair_count", "last_c")))
    later = F.coalesce(F.col("at_2") < F.col("at_1"), F.lit(False))
    scored = scored.select(
        "lang", "w1_word", "middle", "last_word", "a",
        F.when(later, F.col("pair_count")).otherwise(F.col("w1_c")).alias("l"),
        F.when(later, F.col("last_c")).otherwise(F.col("rest_c")).alias("r"),
        F.when(later, F.col("at_2")).otherwise(F.col("at_1")).alias("score"),
    )

    salt = F.pmod(F.xxhash64("w1_word", "middle", "last_word"), F.lit(SALTS))
    by_score = [F.desc("score"), F.desc("a")]
    salted = Window.partitionBy("lang", "salt")
    near = scored.withColumn("salt", salt).withColumn("place", F.rank().over(salted.orderBy(*by_score))).filter(F.col("place") <= top)
    near = near.join(known.select(F.col("key").alias("middle"), F.col("word").alias("middle_word")), "middle", "left")
    near = near.withColumn("phrase", F.concat_ws(" ", "w1_word", "middle_word", "last_word"))
    near = near.withColumn("place", F.row_number().over(salted.orderBy(*by_score, "phrase"))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
