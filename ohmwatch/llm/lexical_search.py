"""Ranked lexical search over posting lists in geometric blocks.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased.  With N texts that hold a term, L terms in
all, n in one text (repeats included), df texts with a term and tf its occurrences in a text:

    weight w = floor(1000 * ln((2N + 2) / (2df + 1)))      m = 75 + ((25 * n * N) div L)
    impact   = (10^9 * tf) div (1000 * tf + 12 * m)        score = sum of w * impact over the query's terms, repeats included

``vectors`` counts the queries' terms in every text; ``build`` makes index segments of them, ``search`` reads these.  A segment
holds the vectors of SEGMENT texts and, for every term, its posting list cut into blocks: a list of more than
BLOCK texts is clustered by the texts' similarity (random projections of their weighted vectors; each joins
the most similar of some leaders).  A block's summary has for every term the greatest impact in any of its
texts, in steps of STEP, rounded up; blocks of TINY texts or fewer have none.

A query takes its terms by their greatest contribution in the segment, largest first.  A block is skipped only if
the query's score on its summary is below the query's worst score so far; the texts of all others are scored
fully, each once.  It stops when the terms left cannot lift a text that holds none before over that score.  Nothing
else is left out, so the result is exact.  Each task hands on its best texts per query, and these are ranked.

Queries go in parts of at most TERMS different terms; each part is broadcast and meets all texts.
Null texts have no terms; rows repeated are ranked each; equal scores go by id, null last.  A query without terms, or without a
text of score over 0, has no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import (
    LOWER, WORD, batch_of, distinct, per_row, pieces, positions, ragged, small_batches, span_hashes, spans, stored, texts,
)
from ohmwatch.session import run_dir

TOP = 20
#: Texts of a segment and of a block; without summary; leaders of one list.
SEGMENT, BLOCK, TINY, LEADERS = 8192, 512, 8, 64
#: Terms and cells that a task works on at once while it makes summaries.
HELD = 1 << 20
#: Step of a summary's values (impacts stay below 10^6), numbers of a text's projection.
STEP, PROJECTED = 4096, 16
#: Distinct terms of a part of the queries.
TERMS = 1 << 18


def terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms, and the texts' bounds."""
    data, offsets = texts(column)
    starts, ends = spans(WORD[data], offsets)
    return span_hashes(LOWER[data], starts, ends), per_row(starts, offsets)


class Queries:
    """Terms (sorted hashes) and for each query its terms' places and how often it holds them."""

    def __init__(self, numbers: list[int], column: pa.Array):
        hashes, bounds = terms(column)
        self.numbers, self.terms = np.array(numbers, np.int64), distinct(hashes)
        at = np.searchsorted(self.terms, hashes)
        self.own = [np.unique(at[s:e], return_counts=True) for s, e in zip(bounds[:-1], bounds[1:])]


def _parts(queries: DataFrame, limit: int):
    """The numbered queries in parts whose terms stay below ``limit``, one part at a time on the driver."""
    size = queries.agg(F.sum(F.length("text")), F.count("*")).first()
    count = max(1, -(-((size[0] or 0) // 2 + size[1]) // limit))
    for part in range(count):
        own = queries.filter(F.pmod(F.xxhash64("number"), F.lit(count)) == part).orderBy("number").toArrow()
        if own.num_rows:
            yield Queries(own["number"].to_pylist(), own["text"].combine_chunks())


_VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
_VECTORS_DDL = "doc_id long, n long, terms array<int>, tf array<int>"


def vectors(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tf) for every text: its number of terms and the counts of the queries' terms in it."""

    def run(batches):
        known = shared.value.terms
        for piece in pieces(batches, 1):
            hashes, bounds = terms(piece.column(1))
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            at, there = positions(known, hashes)
            key, tf = np.unique(row[there] * max(1, len(known)) + at[there], return_counts=True)
            row, term = np.divmod(key, max(1, len(known)))
            cuts = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield batch_of(_VECTORS, [piece.column(0), n, *lists])

    return docs.select("doc_id", "text").mapInArrow(run, _VECTORS_DDL)


def weights(n_texts: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_texts + 2) / (2 * df + 1))).astype(np.int64)


class Segment:
    """Vectors of some texts and the blocks of their posting lists."""

    def __init__(self, ids, missing, ptr, term, impact, block_ptr, block_docs, list_ptr, sizes, coordinates, tops):
        self.ids, self.missing = ids, missing  # ids of the texts, and which are null
        self.ptr, self.term, self.impact = ptr, term, impact  # vectors, text by text
        self.list_ptr = list_ptr  # first block of each term
        self.block_ptr, self.block_docs = block_ptr, block_docs  # texts of each block
        self.sizes, self.coordinates, self.tops = sizes, coordinates, tops  # summaries: terms of each block, their greatest impact in steps

    @property
    def width(self) -> int:
        return max(1, len(self.list_ptr) - 1)

    @functools.cached_property
    def keys(self) -> np.ndarray:
        """block * terms + term of the summaries' cells, ascending."""
        return np.repeat(np.arange(len(self.sizes)) * self.width, self.sizes) + self.coordinates

    def packed(self) -> list[bytes]:
        arrays = (
            self.ids, self.missing, self.ptr, self.term, self.impact, self.block_ptr, self.block_docs, self.list_ptr,
            self.sizes, self.coordinates, self.tops,
        )
        return [np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, self.kinds(self.width))]

    @staticmethod
    def kinds(width: int) -> tuple[str, ...]:
        """How the arrays are written."""
        return ("<i8", "?", "<i8", "<i4", "<i4", "<i8", "<i4", "<i8", "<i4", "<u2" if width <= 1 << 16 else "<i4", "u1")

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> Segment:
        return cls(*[np.frombuffer(x, k) for x, k in zip(raw, cls.kinds(len(raw[7]) // 8 - 1))])

    @classmethod
    def made(cls, ids, missing, ptr, term, impact, weight, block: int) -> Segment:
        n_terms, n = len(weight), len(ids)
        row = np.repeat(np.arange(n), np.diff(ptr))
        # A text's projection: a sum of its terms' signs, by weight and impact, of length 1.
        signs = np.random.default_rng(7).integers(0, 2, (max(1, n_terms), PROJECTED), dtype=np.int8).astype(np.float32) * 2 - 1
        shape = np.zeros((n, PROJECTED), np.float32)
        full = np.flatnonzero(np.diff(ptr))
        if len(full):
            for i in range(PROJECTED):
                shape[full, i] = np.add.reduceat(signs[term, i] * (weight[term] * impact).astype(np.float32), ptr[full])
            shape /= np.maximum(np.linalg.norm(shape, axis=1, keepdims=True), 1e-9)
        order = np.argsort(term, kind="stable")
        docs, of = row[order], term[order]
        starts = np.searchsorted(of, np.arange(n_terms + 1))
        size = np.diff(starts)
        cluster = np.zeros(len(docs), np.int64)
        for t in np.flatnonzero(size > block):
            own = docs[starts[t] : starts[t + 1]]
            leaders = own[np.linspace(0, len(own) - 1, min(LEADERS, -(-len(own) // block))).astype(np.int64)]
            cluster[starts[t] : starts[t + 1]] = (shape[own] @ shape[leaders].T).argmax(axis=1)
        order = np.lexsort((docs, cluster, of))
        docs, of, cluster = docs[order], of[order], cluster[order]
        new = np.ones(len(docs), bool)
        new[1:] = (of[1:] != of[:-1]) | (cluster[1:] != cluster[:-1])
        first = np.flatnonzero(new)
        block_ptr = np.append(first, len(docs))
        list_ptr = np.searchsorted(of[first], np.arange(n_terms + 1))
        return cls(ids, missing, ptr, term, impact, block_ptr, docs, list_ptr, *cls._summaries(block_ptr, docs, ptr, term, impact, n_terms))

    @classmethod
    def _summaries(cls, block_ptr, docs, ptr, term, impact, n_terms):
        """Coordinatewise maxima of the blocks of more than TINY texts."""
        size, width = np.diff(block_ptr), max(1, n_terms)
        top = (-(-impact // STEP)).astype(np.uint8)
        wanted = np.flatnonzero(size > TINY)
        narrow = cls.kinds(width)[9]
        sizes, coordinates, tops = np.zeros(len(size), np.int32), [np.zeros(0, narrow)], [np.zeros(0, np.uint8)]
        # Blocks whose texts hold HELD terms together, and whose table has HELD cells, at a time.
        long = np.diff(ptr)
        upto = np.concatenate([[0], np.cumsum(long[docs])])
        weight = np.concatenate([[0], np.cumsum(upto[block_ptr[wanted + 1]] - upto[block_ptr[wanted]])])
        lo = 0
        while lo < len(wanted):
            hi = int(np.searchsorted(weight, weight[lo] + HELD, "right")) - 1
            hi = min(max(hi, lo + 1), lo + max(1, HELD // width), len(wanted))
            own, lo = wanted[lo:hi], hi
            rows = docs[ragged(block_ptr[own], size[own])]
            some = long[rows]
            at = ragged(ptr[rows], some)
            table = np.zeros(len(own) * width, np.uint8)
            np.maximum.at(table, np.repeat(np.repeat(np.arange(len(own)), size[own]), some) * width + term[at], top[at])
            found = np.flatnonzero(table)
            sizes[own] = np.bincount(found // width, minlength=len(own))
            coordinates.append((found % width).astype(narrow))
            tops.append(table[found])
        return sizes, np.concatenate(coordinates), np.concatenate(tops)

    def scores(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Full scores of some texts; ``value`` has the query's weight of each term."""
        size = self.ptr[docs + 1] - self.ptr[docs]
        at = ragged(self.ptr[docs], size)
        sums = np.concatenate([[0], np.cumsum(value[self.term[at]] * self.impact[at])])
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]

    def bounds(self, blocks: np.ndarray, own: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The query's score on the summaries; without one, no bound."""
        at, there = positions(self.keys, (blocks[:, None] * self.width + own).ravel())
        top = np.where(there, self.tops[at] if len(self.tops) else 0, 0).astype(np.int64).reshape(len(blocks), len(own))
        tiny = self.block_ptr[blocks + 1] - self.block_ptr[blocks] <= TINY
        return np.where(tiny, np.iinfo(np.int64).max, (top * STEP) @ value)

    def most(self) -> np.ndarray:
        """The greatest impact of each term."""
        out = np.zeros(self.width, np.int64)
        np.maximum.at(out, self.term, self.impact.astype(np.int64))
        return out


class Best:
    """A query's best texts so far: (score, null id, id), at most ``top`` of them."""

    def __init__(self, top: int):
        self.top, self.score, self.missing, self.ids = top, *(np.zeros(0, k) for k in (np.int64, bool, np.int64))

    @property
    def least(self) -> int:
        """The score a text needs: with it, its id may still decide."""
        return int(self.score[-1]) if len(self.score) >= self.top else 1

    def add(self, score, missing, ids) -> None:
        some = score >= self.least
        score, missing, ids = (np.concatenate([a, b[some]]) for a, b in ((self.score, score), (self.missing, missing), (self.ids, ids)))
        order = np.lexsort((ids, missing, -score))[: self.top]
        self.score, self.missing, self.ids = score[order], missing[order], ids[order]


def _find(segment: Segment, best: Best, own: np.ndarray, value: np.ndarray, full: np.ndarray, most: np.ndarray, seen: np.ndarray) -> None:
    """One query: its terms ``own``, their weights ``value`` (``full`` by term), on one segment."""
    gain = value * most[own]
    order = np.argsort(-gain, kind="stable")
    left = np.cumsum(gain[order][::-1])[::-1]
    touched = []
    for place, t in enumerate(own[order].tolist()):
        if left[place] < best.least:
            break
        blocks = np.arange(segment.list_ptr[t], segment.list_ptr[t + 1])
        if not len(blocks):
            continue
        bound = segment.bounds(blocks, own, value)
        for b in blocks[np.argsort(-bound, kind="stable")].tolist():
            if bound[b - blocks[0]] < best.least:
                break
            docs = segment.block_docs[segment.block_ptr[b] : segment.block_ptr[b + 1]]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                touched.append(docs)
                best.add(segment.scores(docs, full), segment.missing[docs], segment.ids[docs])
    for docs in touched:
        seen[docs] = False


_INDEX = pa.schema([(f"part{i}", pa.binary()) for i in range(11)])
_INDEX_DDL = ", ".join(f"{x} binary" for x in _INDEX.names)


def build(counted: DataFrame, n_texts: int, n_terms: int, weight, size: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Index segments of the ``vectors``; ``weight`` is a broadcast of the terms' weights."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def made():
            own = pa.Table.from_batches(held).combine_chunks()
            ids = own.column("doc_id").combine_chunks()
            n = own.column("n").to_numpy()
            lists = [own.column(c).combine_chunks() for c in ("terms", "tf")]
            ptr = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy().astype(np.int64))])
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            m = 75 + (25 * n * n_texts) // max(1, n_terms)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(ptr)))
            segment = Segment.made(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(False), ptr, term, impact, weight.value, block)
            return batch_of(_INDEX, [pa.array([x], pa.binary()) for x in segment.packed()])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield made()
                held.clear()
        if held:
            yield made()

    return counted.mapInArrow(run, _INDEX_DDL)


def written(index: DataFrame) -> DataFrame:
    """The index as a table: a segment is a row group of its own, so readers and writers hold one at a time."""
    spark = index.sparkSession
    path = run_dir(spark, "search-index")
    with small_batches(spark):
        index.write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)
    return spark.read.schema(index.schema).parquet(path)


_HITS = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def search(index: DataFrame, shared, weight, top: int = TOP) -> DataFrame:
    """(number, doc_id, score): the best texts of every query in each task's segments."""

    def run(batches):
        queries: Queries = shared.value
        w = weight.value
        best = [Best(top) for _ in queries.own]
        full = np.zeros(max(1, len(w)), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment.unpacked([batch.column(c)[i].as_py() for c in range(11)])
                most, seen = segment.most(), np.zeros(len(segment.ids), bool)
                for found, (own, often) in zip(best, queries.own):
                    value = w[own] * often
                    full[own] = value
                    _find(segment, found, own, value, full, most, seen)
                    full[own] = 0
        for number, found in zip(queries.numbers.tolist(), best):
            if len(found.score):
                ids = pa.array(found.ids, pa.int64(), mask=found.missing)
                yield batch_of(_HITS, [np.full(len(found.score), number), ids, found.score])

    return index.mapInArrow(run, "number long, doc_id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, limit: int = TERMS, size: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's best texts."""
    context = docs.sparkSession.sparkContext
    items = stored(queries.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "search-queries")
    hits = None
    for part in _parts(items, limit):
        shared = context.broadcast(part)
        counted = stored(vectors(docs, shared), "search-vectors")
        n_texts, n_terms = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(part.terms), np.int64)
        found = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        df[found["t"].to_numpy()] = found["df"].to_numpy()
        weight = context.broadcast(weights(n_texts, df))
        index = written(build(counted, n_texts, n_terms, weight, size, block))
        own = stored(search(index, shared, weight, top), "search-hits")
        hits = own if hits is None else hits.union(own)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
