"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its rows into shards, ranks the words of a shard, sorts all word
suffixes by prefix doubling and looks up every test suffix by binary search.  Where
the first ``window`` words of a test suffix stand in the text, neighbouring hits on
one diagonal join into the longest verbatim match with its place.  No shuffle: a
text lies in one shard and a match in one text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null texts have no words;
items without words match nothing; an item shorter than the window is one window;
items with a null id carry the id ``null``.  Repeated rows give repeated rows.  Words
are ranked by 64-bit hashes and every match is then compared byte by byte.

The test items are broadcast in blocks of at most ``block_bytes`` of text (counted
first); more text makes more passes, none is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohmwatch.llm.arrays import (
    LOWER, U64, WORD, free_name, per_row, pieces, positions, ragged, span_hashes, spans, texts,
)

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 32 << 20

MATCH = pa.list_(
    pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
)


class Shard:
    """Words of some texts, in order: hashes, bounds and the end of each word's text."""

    def __init__(self, column: pa.Array):
        data, offsets = texts(column)
        self.data = LOWER[data]
        self.starts, self.ends = spans(WORD[data], offsets)
        self.first = per_row(self.starts, offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.stop = np.repeat(self.first[1:], np.diff(self.first))

    def words(self, at: int, n: int) -> list[bytes]:
        raw = self.data[self.starts[at] : self.ends[at + n - 1]].tobytes()
        base = int(self.starts[at])
        return [raw[s - base : e - base] for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist())]


def suffix_array(rank: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Order of all suffixes of words with ranks from 1; a suffix ends with its text.

    Prefix doubling: ranks of 1, 2, 4, ... words until no class is split any more.
    """
    n = len(rank)
    bits = U64(max(1, n.bit_length()))
    index = np.arange(n, dtype=U64)
    rank = rank.astype(U64)
    classes, reach = int(rank.max(initial=0)), 1
    while True:
        follow = np.zeros(n, U64)
        if reach < n:
            follow[:-reach] = np.where(index[:-reach].astype(np.int64) + reach < stop[:-reach], rank[reach:], U64(0))
        if 3 * int(bits) <= 64:
            key = (rank << (bits + bits)) | (follow << bits) | index
            key.sort()
            order, group = (key & ((U64(1) << bits) - U64(1))).astype(np.int64), key >> bits
        else:
            order = np.lexsort((follow, rank))
            group = (rank[order] << U64(32)) | follow[order]
        new = np.empty(n, U64)
        if n:
            new[0] = 1
            np.cumsum(group[1:] != group[:-1], out=new[1:].view(np.int64))
            new[1:] += U64(1)
        found = int(new[-1]) if n else 0
        rank = np.empty(n, U64)
        rank[order] = new
        if found in (classes, n):
            return order
        classes, reach = found, 2 * reach


def occurrences(order, rank, stop, queries):
    """Binary search: for each row of ``queries`` (word ranks) the range of suffixes
    that begin with it."""
    n, (q, width) = len(order), queries.shape
    steps = np.arange(width)
    counts = np.concatenate([[0], np.cumsum(np.bincount(rank))])
    found = []
    for beyond in (False, True):
        low, high = counts[queries[:, 0]].copy(), counts[queries[:, 0] + 1].copy()
        while (open_ := low < high).any():
            rows = np.flatnonzero(open_)
            middle = (low[rows] + high[rows]) // 2
            at = order[middle]
            place = at[:, None] + steps
            words = np.where(place < stop[at][:, None], rank[np.minimum(place, n - 1)], 0)
            differ = words != queries[rows]
            where = differ.argmax(axis=1)
            pick = np.arange(len(rows))
            less = words[pick, where] < queries[rows][pick, where]
            if beyond:
                less |= ~differ.any(axis=1)
            low[rows] = np.where(less, middle + 1, low[rows])
            high[rows] = np.where(less, high[rows], middle)
        found.append(low)
    return found


def matches(shard: Shard, items: Shard, window: int):
    """Longest matches as arrays (item, item word, shard word, words)."""
    vocabulary, rank = np.unique(shard.hashes, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    at, there = positions(vocabulary, items.hashes)
    wanted = np.where(there, at + 1, 0)
    sizes = np.diff(items.first)
    item = np.repeat(np.arange(len(sizes)), sizes)
    missing = np.concatenate([[0], np.cumsum(~there)])
    order, parts = None, []
    # Windows of one width at a time: the full ones, then each shorter item's own.
    for width in sorted({min(window, int(s)) for s in sizes if s}):
        starts = np.arange(len(item))
        fits = starts + width <= items.stop
        fits &= (sizes[item] >= window) if width == window else (sizes[item] == width)
        starts = starts[fits]
        starts = starts[missing[starts + width] == missing[starts]]
        if not len(starts) or not len(rank):
            continue
        if order is None:
            order = suffix_array(rank, shard.stop)
        low, high = occurrences(order, rank, shard.stop, wanted[starts[:, None] + np.arange(width)])
        hits = order[ragged(low, high - low)]
        parts.append((np.repeat(starts, high - low), hits, np.full(len(hits), width)))
    if not parts:
        return np.zeros((4, 0), np.int64)
    word, hit, width = (np.concatenate(x) for x in zip(*parts))
    if not len(word):
        return np.zeros((4, 0), np.int64)
    sort = np.lexsort((word, hit - word, item[word]))
    word, hit, width = word[sort], hit[sort], width[sort]
    joins = np.zeros(len(word), bool)
    joins[1:] = (np.diff(word) == 1) & (np.diff(hit) == 1) & (item[word[1:]] == item[word[:-1]])
    head = np.flatnonzero(~joins)
    tail = np.append(head[1:], len(word)) - 1
    length = word[tail] - word[head] + width[tail]
    out = np.stack([item[word[head]], word[head], hit[head], length])
    same = [shard.words(h, k) == items.words(w, k) for _, w, h, k in out.T.tolist()]
    return out[:, np.array(same, bool)]


def _scan(text_at: int, window: int, ids, item_texts, limit: int):
    def run(batches):
        items = Shard(pa.array(item_texts, pa.string()))
        for piece in pieces(batches, text_at, limit):
            shard = Shard(piece.column(text_at))
            found = matches(shard, items, window)
            doc = np.searchsorted(shard.first, found[2], "right") - 1
            sort = np.lexsort((found[1], found[2], doc))
            found, doc = found[:, sort], doc[sort]
            kind = MATCH.value_type
            rows = pa.StructArray.from_arrays(
                [
                    pa.array([ids[i] for i in found[0].tolist()], pa.string()),
                    pa.array(found[1] - items.first[found[0]], pa.int64()),
                    pa.array(found[2] - shard.first[doc], pa.int64()),
                    pa.array(found[3], pa.int64()),
                ],
                fields=list(kind),
            )
            bounds = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(np.diff(shard.first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), rows)],
                names=[*piece.schema.names, "n", "m"],
            )

    return run


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """Id and text of the test items, block by block; the driver holds one block."""
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    shown = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")
    )
    for k in range(n):
        rows = shown.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def with_matches(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is returned) with n_words, n_hit and the
    longest verbatim matches: item_id, item_start, doc_start, n_words."""
    context, names = docs.sparkSession.sparkContext, docs.columns
    text_at, kind = names.index(text), T.ArrayType(
        T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_start", "doc_start", "n_words")]])
    )
    out, counts, lists = docs, [], []
    for ids, item_texts in item_blocks(items, item_id, item_text, block_bytes):
        shared = context.broadcast((ids, item_texts))
        count, found = free_name(out, "n_words"), free_name(out, "matches")
        schema = T.StructType([*out.schema.fields, T.StructField(count, T.LongType()), T.StructField(found, kind)])
        out = out.mapInArrow(_shared_scan(text_at, window, shared, shard_bytes), schema)
        counts.append(count)
        lists.append(found)
    every = F.concat(*lists) if len(lists) > 1 else F.col(lists[0])
    covered = F.aggregate(
        F.array_sort(F.transform(every, lambda m: F.struct(m["doc_start"].alias("s"), (m["doc_start"] + m["n_words"]).alias("e")))),
        F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["e"], x["e"]).alias("e"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["e"], x["s"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    name = free_name(docs, "decontamination")
    result = F.struct(F.col(counts[0]).alias("n_words"), covered.alias("n_hit"), every.alias("matches"))
    return out.select(*[F.col(f"`{c}`") for c in names], result.alias(name)), name


def _shared_scan(text_at, window, shared, limit):
    def run(batches):
        ids, item_texts = shared.value
        yield from _scan(text_at, window, ids, item_texts, limit)(batches)

    return run


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs, unchanged."""
    scored, name = with_matches(docs, items, **options)
    return scored.filter(F.size(f"`{name}`.matches") == 0).drop(name)


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: how much of it is test material, and of which items."""
    scored, name = with_matches(docs.select("doc_id", "text"), items, **options)
    found = F.col(f"{name}.matches")
    ids = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["item_id"])))
    return scored.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        F.col(f"{name}.n_hit").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col(f"{name}.n_hit") > 0).alias("contaminated"),
    )
