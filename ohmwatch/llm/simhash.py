"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits.  The
binary Golay code (23, 12) gives each segment keys: the codewords that the segment and
its neighbours at one flipped bit decode to, at most six.  Two segments that differ in two
bits or fewer share a key, for the value between them is a neighbour of both.

Of at most four differing bits, one of two cases holds, and the keys are made for both:

* every segment differs in two bits or fewer: one key of each segment (36 bits);
* else one segment differs in three or more, the others in one bit at most together: one
  of them is equal, the other shares a key: the equal bits with that key (33 or 34 bits).

Only distinct fingerprints are joined.  Rows are dealt by key and sorted; a task compares
the fingerprints of a key, keeps those within the bound, and returns a forest of what it has
linked instead of all pairs.  A key with more than GROUP fingerprints is cut into blocks whose
pairs are dealt out again.  Components then form by alternating stars over written tables.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null texts have none and get the
fingerprint zero.  Repeated rows stay, a component of null ids only is null.  ``keep_one`` leaves one
row of each component as it is, with all its columns: of the least id (null is last), then the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import LOWER, NOT_BLANK, U64, batch_of, free_name, per_row, spans, stored, texts, with_struct

WORDS = 4
BITS = 4
SEED = 42
#: Fingerprints of one key that a task compares at once.
GROUP = 4096
#: Fingerprints per task that makes keys; each makes up to some two hundred.
DEALT = 4096

# Fixed values: (first bit, bits) of the segments, the code's generator polynomial.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011


class Golay:
    """Index of the codeword nearest to a 23-bit value; the code is perfect."""

    def __init__(self):
        def rest(v: int) -> int:
            for shift in range(11, -1, -1):
                if v >> (shift + 11) & 1:
                    v ^= GENERATOR << shift
            return v

        self.parity = np.array([rest(m << 11) for m in range(4096)], np.uint32)
        self.error = np.zeros(2048, np.uint32)
        one = [1 << i for i in range(23)]
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = one[i] | one[j] | one[k]
                    self.error[rest(e)] = e

    def decode(self, values: np.ndarray) -> np.ndarray:
        values = values.astype(np.uint32)
        syndrome = self.parity[values >> np.uint32(11)] ^ (values & np.uint32(2047))
        return (values ^ self.error[syndrome]) >> np.uint32(11)

    def keys(self, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codeword indices of each value and its one-bit neighbours: rows of six,
        and which of them count."""
        flips = np.array([0, *(1 << i for i in range(bits))], np.uint32)
        found = np.sort(self.decode(values.astype(np.uint32)[:, None] ^ flips), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        place = np.cumsum(new, axis=1) - 1
        out, there = np.zeros((len(values), 6), U64), np.zeros((len(values), 6), bool)
        row = np.nonzero(new)
        out[row[0], place[row]] = found[row]
        there[row[0], place[row]] = True
        return out, there


def fingerprint_keys(fingerprints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys, and the row of each."""
    parts = [(fingerprints >> U64(at)) & U64((1 << n) - 1) for at, n in SEGMENTS]
    codes = [golay.keys(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    (a, ia), (b, ib), (c, ic) = codes
    joined = (a[:, :, None, None] << U64(24)) | (b[:, None, :, None] << U64(12)) | c[:, None, None, :]
    there = ia[:, :, None, None] & ib[:, None, :, None] & ic[:, None, None, :]
    rows = np.nonzero(there)
    keys, row = [joined[rows]], [rows[0]]
    kind = 1
    for i, equal in enumerate(parts):
        for j, (code, own) in enumerate(codes):
            if i != j:
                pick = np.nonzero(own)
                keys.append((U64(kind) << U64(36)) | (equal[pick[0]] << U64(12)) | code[pick])
                row.append(pick[0])
                kind += 1
    return np.concatenate(keys), np.concatenate(row)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) as stars: every node but the least of a component, and that least."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


class Links:
    """Collects links and keeps them as a forest."""

    #: Rows of a key up to which all pairs are compared step by step.
    small = 64

    def __init__(self, bits: int):
        self.bits, self.u, self.v, self.n = bits, [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        some = np.bitwise_count(x ^ y) <= self.bits
        self.u.append(x[some])
        self.v.append(y[some])
        self.n += int(some.sum())
        if self.n > 1 << 20:
            u, v = self.result()
            self.u, self.v, self.n = [u], [v], 0

    def group(self, own: np.ndarray) -> None:
        for i in range(len(own) - 1):
            self.add(np.broadcast_to(own[i], len(own) - 1 - i), own[i + 1 :])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.u:
            return np.zeros(0, U64), np.zeros(0, U64)
        return forest(np.concatenate(self.u), np.concatenate(self.v))


def link_groups(links: Links, key: np.ndarray, fp: np.ndarray, limit: int = GROUP):
    """Compare the rows of each key (sorted); yields (key, rows) of keys over ``limit``."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(start, size))  # rows to the group's end
    wide = np.repeat(size > links.small, size)
    at = np.flatnonzero((left > 1) & ~wide)
    step = 1
    while len(at):
        links.add(fp[at], fp[at + step])
        step += 1
        at = at[left[at] > step]
    for s, n in zip(start[size > links.small].tolist(), size[size > links.small].tolist()):
        if n > limit:
            yield key[s], fp[s : s + n]
        else:
            links.group(fp[s : s + n])


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("size", pa.int64())])
_LINKS_DDL = "u long, v long, key long, place long, size long"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _compare(bits: int, limit: int):
    def run(batches):
        links = Links(bits)
        key, fp = np.zeros(0, U64), np.zeros(0, U64)

        def large(found):
            for k, rows in found:
                n = len(rows)
                yield batch_of(_LINKS, [_signed(rows), pa.nulls(n, pa.int64()), np.full(n, k, U64).view(np.int64), np.arange(n), np.full(n, n)])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy().view(U64)])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(U64)])
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield from large(link_groups(links, key[:cut], fp[:cut], limit))
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield from large(link_groups(links, key, fp, limit))
        u, v = links.result()
        none = pa.nulls(len(u), pa.int64())
        yield batch_of(_LINKS, [_signed(u), _signed(v), none, none, none])

    return run


def _make_keys(batches):
    golay = Golay()
    kind = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    for batch in batches:
        fp = batch.column(0).to_numpy().view(U64)
        for i in range(0, len(fp), 2048):
            keys, row = fingerprint_keys(fp[i : i + 2048], golay)
            yield batch_of(kind, [_signed(keys), _signed(fp[i : i + 2048][row])])


def links(distinct: DataFrame, bits: int = BITS, limit: int = GROUP) -> DataFrame:
    """Links (u, v) between the fingerprints of ``distinct`` (one column, distinct values):
    a subset that connects just what all links within ``bits`` connect."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the keys find up to {BITS} differing bits")
    parts = max(1, -(-distinct.count() // DEALT))
    keys = distinct.repartition(parts, distinct.columns[0]).mapInArrow(_make_keys, "key long, fp long")
    return compared(keys, bits, limit)


def compared(keys: DataFrame, bits: int, limit: int) -> DataFrame:
    """A forest (u, v) of the links between the fingerprints with equal keys (key, fp)."""
    found = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(bits, limit), _LINKS_DDL), "simhash-links")
    pairs = found.filter("v is not null").select("u", "v")
    large = found.filter("v is null")
    if large.isEmpty():
        return pairs
    # All pairs of a large key's blocks; a block meets itself and every other one.
    half = limit // 2
    blocks = large.selectExpr("key", "u AS fp", f"place div {half} AS own", f"explode(sequence(0L, (size - 1) div {half})) AS other")
    dealt = blocks.selectExpr("xxhash64(key, least(own, other), greatest(own, other)) AS key", "fp")
    again = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(bits, 2 * limit), _LINKS_DDL)
    return pairs.union(again.filter("v is not null").select("u", "v"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the component's least node.

    Alternating large and small stars; each round is written and read back.
    """
    edges = stored(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "components")
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).distinct()
        new = stored(small, "components")
        # Done when every node hangs on one root and no root hangs on another.
        state = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("nodes")).first()
        edges = new
        if state["n"] == state["nodes"] and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.toDF("node", "root")
    raise RuntimeError("components did not settle")


def shingles(column, words: int) -> tuple[np.ndarray, list[bytes]]:
    """The rows' bounds among all shingles, and the shingles: lower-cased words joined by one
    blank.  A text of fewer words is one shingle, a text without words has none."""
    data, offsets = texts(column)
    inside = NOT_BLANK[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # one blank after each word
    shift = np.concatenate([[0], np.cumsum(kept)])
    low = np.where(inside, LOWER[data], np.uint8(32))[kept]
    offsets = shift[offsets]
    starts, ends = spans(low != 32, offsets)
    first = per_row(starts, offsets)
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1], n)
    last = np.minimum(at + words, np.repeat(first[1:], n)) - 1
    raw = low.tobytes()
    return bounds, [raw[s:e] for s, e in zip(starts[at].tolist(), ends[last].tolist())]


def ones(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of a row's hashes (as rows of bytes) have each bit set; zero without any."""
    bits = np.unpackbits(hashes, axis=1, bitorder="little")
    out = np.zeros((len(bounds) - 1, bits.shape[1]), np.int32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(bits, bounds[:-1][full], axis=0, dtype=np.int32)
    return out


def _fingerprinter(words: int):
    def start():
        import xxhash

        hash64 = xxhash.xxh64_intdigest

        def make(column):
            bounds, parts = shingles(column, words)
            h = np.fromiter((hash64(x, SEED) for x in parts), U64, len(parts))
            count = ones(h.astype("<u8").view(np.uint8).reshape(-1, 8), bounds)
            bits = 2 * count > np.diff(bounds)[:, None]
            return [np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)]

        return make

    return start


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS) -> tuple[DataFrame, str]:
    """``docs`` with a struct column that holds the fingerprint as a long, and its name."""
    return with_struct(docs, text, "simhash", {"fp": "long"}, _fingerprinter(words))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def groups(rows: DataFrame, bits: int = BITS, limit: int = GROUP) -> DataFrame:
    """(fp, component_id) for the rows' (doc_id, fp): the least id its links reach."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), bits, limit)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    frame, name = with_fingerprint(docs.select("doc_id", "text"))
    rows = stored(frame.select("doc_id", F.col(f"{name}.fp").alias("fp")), "simhash")
    return rows.join(groups(rows), "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", bits: int = BITS, words: int = WORDS, limit: int = GROUP) -> DataFrame:
    """The rows of ``docs`` less all but one of each component, unchanged."""
    number = free_name(docs, "row")
    frame, name = with_fingerprint(docs, text, words)
    rows = stored(frame.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    own = rows.select("doc_id", F.col(f"{name}.fp").alias("fp"), F.col(number).alias("row"))
    # Components by the number of a row: each fingerprint's first row stands for it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    heads = stored(own.groupBy("fp").agg(first.alias("best")), "simhash-heads")
    roots = components(links(heads.select("fp"), bits, limit)).select(F.col("node").alias("fp"), "root")
    rooted = heads.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    gone = stored(own.select("row").join(stay, "row", "left_anti"), "simhash-gone").withColumnRenamed("row", number)
    return rows.join(gone, number, "left_anti").select(*docs.columns)
