"""Near-duplicates by b-bit MinHash: bands of minima find pairs, packed low bits estimate, full sets decide.

A text's set are its distinct shingles of WORDS words (lower-cased A-Z, ``[^\\x20\\x09-\\x0D]+``); a text of fewer
words is one shingle, a text without words has none and is linked with nothing.  Texts are linked if
100 * intersection >= PERCENT * union.

Each set has BANDS * ROWS minima.  ROWS of them together are the key of a band; of each
minimum only BITS low bits of its hash are retained, packed into one signature.  Two sets agree in a field with the
probability J + (1 - J) * 2**-BITS, so J is estimated from the number of equal fields, counted with xor and a bit count
and corrected for the collisions.

* Equal sets are one node, known by 128 bits of hash; copies make no pairs.
* Nodes meet by the keys that two or more of them have.  At J = 0.85 all bands differ for one pair in a million.
* First each key's rows are joined by FORESTS spanning forests of the best estimates, each without the pairs of the one before,
  so that a pair that is refused does not part what belongs together.  Keys with many rows are dealt into blocks
  by a hash of key and row, other blocks for each key, so no task holds a whole key.
* Pairs are confirmed on the full sets, made again from the texts; confirmed links form components.
* Then all pairs of a key that lie in different components, that their sizes and the estimate (less 4.5 deviations)
  allow and that were not confirmed or refused before are confirmed as well.  The few rows concerned get a second
  signature of LONG single bits for this, which tells 0.80 from 0.85.  A key's rows of its
  largest component meet the other rows only, never each other, and a pair counts for its first common band.

Nothing is capped: what is skipped is a pair that other links join already, or whose estimate excludes it.

Rows repeated or with equal sets share a component.  A component is named by its least id, null if it has no other.
Every row comes back; null is the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import (
    LOWER, NOT_BLANK, U64, batch_of, mixed, per_row, pieces, ragged, span_hashes, spans, stored, texts, window_hashes,
)
from ohmwatch.llm.simhash import components, forest
from ohmwatch.llm.suffix_tree import Filter

WORDS = 5
PERCENT = 85
BANDS, ROWS = 36, 7
BITS = 2
#: Single bits of the second signature.
LONG = 2048
#: Deviations by which an estimate may fall short of the bound.
SLACK = 4.5
#: Rows of a key that a task compares with each other.
GROUP = 1024
#: Rows of a key up to which pairs are made step by step; spanning forests of the first pairs.
SMALL, FORESTS = 32, 2
#: Rows up to which (counted) a list of row numbers is broadcast.
BROADCAST = 1 << 21

_FIELDS = BANDS * ROWS
_rng = np.random.default_rng(850585)
_TIMES = (_rng.integers(0, 1 << 31, LONG, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, LONG, dtype=np.uint32)


def shingle_sets(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending in it, and the texts' bounds."""
    data, offsets = texts(column)
    starts, ends = spans(NOT_BLANK[data], offsets)
    first = per_row(starts, offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = ragged(first[:-1], n)
    h = window_hashes(hashes, at, np.minimum(n_words, words)[row])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]).astype(np.int64)


def minima(hashes: np.ndarray, bounds: np.ndarray, fields: int = _FIELDS) -> np.ndarray:
    """The minima of each set under so many permutations; zero for empty sets."""
    x = (hashes >> U64(32)).astype(np.uint32)
    out = np.zeros((len(bounds) - 1, fields), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        first = bounds[:-1][full]
        for i in range(fields):
            out[full, i] = np.minimum.reduceat(x * _TIMES[i] + _PLUS[i], first)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of a row's minima."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2])
    for i in range(ROWS):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def packed(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` low bits of each minimum's hash, packed into 64-bit words: one row per set."""
    low = (mixed(least.astype(U64)) & U64((1 << bits) - 1)).astype(np.uint8)
    flat = np.unpackbits(low[:, :, None], axis=2, count=bits, bitorder="little").reshape(len(least), -1)
    flat = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 64)))
    return np.packbits(flat, axis=1, bitorder="little").view("<u8")


def differing(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """In how many fields two signatures differ."""
    apart = x ^ y
    for i in range(1, bits):
        apart = apart | ((x ^ y) >> U64(i))
    lowest = U64(sum(1 << i for i in range(0, 64, bits)))
    return np.bitwise_count(apart & lowest).sum(axis=-1, dtype=np.int32)


def estimate(apart: np.ndarray, fields: int = _FIELDS, bits: int = BITS) -> np.ndarray:
    """Similarity of sets whose signatures differ in so many fields, corrected for equal bits by chance."""
    return 1 - apart / fields / (1 - 2.0**-bits)


def most_apart(percent: int = PERCENT, fields: int = _FIELDS, bits: int = BITS) -> int:
    """Differing fields beyond which a similarity of ``percent`` is excluded."""
    miss = (1 - percent / 100) * (1 - 2.0**-bits)
    return int(fields * miss + SLACK * np.sqrt(fields * miss * (1 - miss)))


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_ROWS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
     ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("text", pa.string())]
)
_ROWS_DDL = "row long, doc_id long, n long, a long, b long, bands array<long>, signature binary, text string"


def _describe(words: int):
    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for piece in pieces(batches, 1):
            n = piece.num_rows
            h, bounds = shingle_sets(piece.column(1), words)
            least = minima(h, bounds)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mixed(h ^ U64(salt)))]) for salt in (0, 0xA5A5A5A5F00DF00D)]
            a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(_long(band_keys(least)).ravel()))
            signature = pa.array([x.tobytes() for x in packed(least)], pa.binary())
            yield batch_of(_ROWS, [row + np.arange(n), piece.column(0), np.diff(bounds), _long(a), _long(b), keys, signature, piece.column(1)])
            row += n

    return run


def _steps(group: np.ndarray):
    """All pairs of rows of equal ``group`` (sorted), one distance after the other."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    left = np.repeat(size, size) - (np.arange(len(group)) - np.repeat(start, size))
    at, step = np.flatnonzero((left > 1) & ~np.repeat(size > SMALL, size)), 1
    while len(at):
        yield at, at + step
        step += 1
        at = at[left[at] > step]
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        own = np.arange(s, s + n)
        for i in range(n - 1):
            yield np.broadcast_to(own[i], n - 1 - i), own[i + 1 :]


def spanning(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The pairs (by place) of FORESTS spanning forests of n rows, those that differ least first."""
    order = np.lexsort((j, i, apart))
    out = []
    for _ in range(FORESTS):
        x, y, label = i[order], j[order], np.arange(n)
        taken = np.zeros(len(order), bool)
        left = np.arange(len(order))
        while True:
            a, b = label[x[left]], label[y[left]]
            left = left[a != b]
            if not len(left):
                break
            # Each tree's first pair to another one; places are in the order of choice.
            first = np.full(n, len(order))
            np.minimum.at(first, label[x[left]], left)
            np.minimum.at(first, label[y[left]], left)
            picked = np.unique(first[first < len(order)])
            taken[picked] = True
            nodes, roots = forest(label[x[picked]], label[y[picked]])
            new = np.arange(n)
            new[nodes] = roots
            label = new[label]
        out.append(order[taken])
        order = order[~taken]
    return np.concatenate(out)


def narrowed(keys: np.ndarray) -> np.ndarray:
    """32 bits of a band's key."""
    return (mixed(keys.astype(U64)) >> U64(32)).astype(np.uint32)


def _lengthen(words: int):
    """Task function: (row, text) to (row, signature of LONG single bits, digests of its band keys)."""
    kind = pa.schema([("row", pa.int64()), ("long_signature", pa.binary()), ("digests", pa.binary())])

    def run(batches):
        for piece in pieces(batches, 1):
            for at in range(0, piece.num_rows, 512):
                own = piece.slice(at, 512)
                least = minima(*shingle_sets(own.column(1), words), LONG)
                made = packed(least, 1), narrowed(band_keys(least[:, :_FIELDS]))
                yield batch_of(kind, [own.column(0), *[pa.array([x.tobytes() for x in rows], pa.binary()) for rows in made]])

    return run


def _compare(best: bool, percent: int):
    """Task function: rows (cell, row, root, n, signature) sorted by cell to candidate pairs: those that join
    the rows best; or else, from rows with a long signature, the cell's key and digests of all their keys, those of
    different roots in the first band that they share."""
    fields, bits = (_FIELDS, BITS) if best else (LONG, 1)
    limit = most_apart(percent, fields, bits)
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pairs(cell, row, root, n, signature, key=None, digests=None):
        found = [np.zeros((3, 0), np.int64)]
        for i, j in _steps(cell):
            fine = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (root[i] != root[j])
            i, j = i[fine], j[fine]
            if not best:
                shared = (digests[i] == digests[j]).argmax(axis=1)
                fine = digests[i, shared] == narrowed(key[i])
                i, j = i[fine], j[fine]
            apart = differing(signature[i], signature[j], bits)
            fine = apart <= limit
            found.append(np.stack([i[fine], j[fine], apart[fine]]))
        i, j, apart = np.concatenate(found, axis=1)
        if best:
            chosen = spanning(len(row), i, j, apart)
            i, j = i[chosen], j[chosen]
        u, v = np.minimum(row[i], row[j]), np.maximum(row[i], row[j])
        return batch_of(kind, [u, v])

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            signature = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            own = [*(batch.column(i).to_numpy() for i in range(4)), signature]
            if not best:
                digests = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u4").reshape(batch.num_rows, BANDS)
                own += [batch.column(5).to_numpy(), digests]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            cell = held[0]
            cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
            if cut:
                yield pairs(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield pairs(*held)

    return run


def _confirm(words: int, percent: int):
    """Task function: (u, v, text of u, text of v) to (u, v, linked), decided on the full sets."""
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            (x, at_x), (y, at_y) = (shingle_sets(batch.column(i), words) for i in (2, 3))
            row = np.concatenate([np.repeat(np.arange(n), np.diff(at)) for at in (at_x, at_y)])
            both = np.concatenate([x, y])
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            shared = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=n)
            union = np.diff(at_x) + np.diff(at_y) - shared
            yield batch_of(kind, [batch.column(0), batch.column(1), (100 * shared >= percent * union) & (union > 0)])

    return run


def _shared_keys(allowed):
    """Task function: (row, bands) to (row, key) of the keys that the filter lets through."""
    kind = pa.schema([("row", pa.int64()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            keys = batch.column(1).flatten().to_numpy()
            row = np.repeat(batch.column(0).to_numpy(), BANDS)
            some = allowed.value.has(np.ascontiguousarray(keys).view(U64))
            yield batch_of(kind, [row[some], keys[some]])

    return run


def _small(numbers: DataFrame) -> DataFrame:
    """A stored list of row numbers, broadcast if it is short."""
    return F.broadcast(numbers) if numbers.limit(BROADCAST + 1).count() <= BROADCAST else numbers


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = stored(docs.select("doc_id", "text").mapInArrow(_describe(words), _ROWS_DDL), "minhash-rows")
    heads = stored(rows.filter("n > 0").groupBy("a", "b").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "minhash-heads")
    copies = stored(rows.filter("n > 0").select("row").join(heads, "row", "left_anti"), "minhash-copies")
    nodes = rows.filter("n > 0").select("row", "n", "bands", "signature").join(_small(copies), "row", "left_anti")
    keys = nodes.select("row", F.explode("bands").alias("key"))
    crowded = stored(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "minhash-keys")
    # Few keys are shared: a filter of these (one that refuses none of them) thins the rows out before the join.
    allowed = docs.sparkSession.sparkContext.broadcast(Filter(crowded.select("key")))
    keys = nodes.select("row", "bands").mapInArrow(_shared_keys(allowed), "row long, key long")
    keyed = stored(keys.join(crowded, "key"), "minhash-keyed")

    def candidates(dealt: DataFrame, best: bool) -> DataFrame:
        found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(best, percent), "u long, v long")
        return found.distinct()

    def texts_of(wanted: DataFrame) -> DataFrame:
        return rows.select("row", "text").join(_small(wanted), "row", "left_semi")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "minhash-pairs")
        wanted = stored(pairs.select("u").union(pairs.select("v")).distinct().toDF("row"), "minhash-wanted")
        own = stored(texts_of(wanted), "minhash-texts")
        both = pairs.join(own.toDF("u", "x"), "u").join(own.toDF("v", "y"), "v").select("u", "v", "x", "y")
        return stored(both.mapInArrow(_confirm(words, percent), "u long, v long, linked boolean"), "minhash-confirmed")

    # Some block of each key, so that every row meets others; blocks differ from key to key.
    block = F.pmod(F.xxhash64("row", "key"), F.ceil(F.col("size") / group))
    dealt = keyed.select(F.xxhash64("key", block).alias("cell"), "row", F.col("row").alias("root"))
    dealt = dealt.join(nodes.select("row", "n", "signature"), "row").select("cell", "row", "root", "n", "signature")
    first = confirmed(candidates(dealt, True))
    linked = first.filter("linked").select("u", "v")
    roots = stored(components(linked), "minhash-roots").toDF("row", "root")

    # Keys whose rows lie in several components: all pairs between two of these.
    placed = stored(keyed.select("key", "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "minhash-placed")
    per_root = placed.groupBy("key", "root").agg(F.count("*").alias("rows"))
    split = per_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("rows").alias("size"), F.max(F.struct("rows", "root")).alias("most"))
    split = stored(split.filter("roots > 1").select("key", "size", F.col("most.rows").alias("main"), F.col("most.root").alias("main_root")), "minhash-split")
    cells = (
        placed.join(split, "key")
        .withColumn("small", F.col("size") <= group)
        .withColumn("inner", F.col("root") == F.col("main_root"))
        .withColumn("mains", F.ceil(F.col("main") / group))
        .withColumn("others", F.ceil((F.col("size") - F.col("main")) / group))
        .withColumn("own", F.pmod(F.xxhash64("row", "key"), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("others"))))
        .select(
            "row",
            "root",
            "key",
            F.explode(
                F.expr(
                    """CASE WHEN small THEN array(xxhash64(key))
                    WHEN inner THEN transform(sequence(0L, others - 1), i -> xxhash64(key, 0, own, i))
                    ELSE concat(transform(sequence(0L, mains - 1), i -> xxhash64(key, 0, i, own)),
                        transform(sequence(0L, others - 1), i -> xxhash64(key, 1, least(own, i), greatest(own, i)))) END"""
                )
            ).alias("cell"),
        )
    )
    wanted = stored(placed.join(split.select("key"), "key", "left_semi").select("row").distinct(), "minhash-wanted")
    facts = texts_of(wanted).mapInArrow(_lengthen(words), "row long, long_signature binary, digests binary")
    sizes = rows.select("row", "n").join(_small(wanted), "row", "left_semi")
    facts = stored(facts.join(sizes, "row"), "minhash-long")
    dealt = cells.join(facts, "row").select("cell", "row", "root", "n", "long_signature", "key", "digests")
    second = candidates(dealt, False).join(first.select("u", "v"), ["u", "v"], "left_anti")
    linked = linked.union(confirmed(second).filter("linked").select("u", "v"))

    roots = components(linked).toDF("row", "root")
    rooted = stored(heads.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "minhash-rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(names, "root").select("a", "b", "component_id"), "minhash-named")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(named, ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def digest(docs: DataFrame) -> DataFrame:
    return near_groups(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
