"""Token ids as files of patched frame-of-reference blocks.

A segment holds whole documents in ascending doc_id order.  Its ids are cut into
blocks of BLOCK ids; a block stores its minimum, the differences packed at the width
that covers WIDTH_SHARE of them, and the others in a list of exceptions (place and high bits).  The
segment's index has the byte at which each block starts, so any range of ids is read
without the rest.

``write`` range-partitions the documents by id and writes segments with Spark's
Parquet writer (one binary payload and its directory columns per row), so a lost task
is simply run again; ``read`` adds the partitions' token totals to global offsets.
Null and empty texts hold the end id alone.  Rows with equal ids stand in the order of
their text hash; repeated rows stay.  A null id sorts first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import LARGE, batch_of, pieces
from ohmwatch.llm.tokens import encoder, shared_vocabulary
from ohmwatch.session import run_dir

BLOCK = 1024
WIDTH_SHARE = 0.95
#: Ids after which a segment ends (with its last document).
SEGMENT = 1 << 18
MAGIC = b"PFOR1\0"
#: minimum, packed width, count, exceptions
_HEAD = "<IBHH"
#: magic, number of ids, ids in a block
_TOP = "<6sQQ"


def pack_block(values: np.ndarray, share: float = WIDTH_SHARE) -> bytes:
    """Minimum, differences at the chosen width, exceptions (place, high bits)."""
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    widths = np.zeros(len(rest), np.int64)
    some = rest > 0
    widths[some] = np.floor(np.log2(rest[some].astype(np.float64))).astype(np.int64) + 1
    width = int(np.sort(widths)[min(len(rest) - 1, int(np.ceil(share * len(rest))) - 1)])
    over = np.flatnonzero(widths > width).astype(np.uint16)
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    high = (rest[over].astype(np.uint64) >> np.uint64(width)).astype("<u4")
    return b"".join(
        [struct.pack(_HEAD, low, width, len(rest), len(over)), np.packbits(bits.ravel(), bitorder="little").tobytes(), over.astype("<u2").tobytes(), high.tobytes()]
    )


def unpack_block(raw: memoryview) -> np.ndarray:
    low, width, n, n_over = struct.unpack_from(_HEAD, raw)
    at = struct.calcsize(_HEAD)
    size = (n * width + 7) // 8
    values = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(raw[at : at + size], np.uint8), bitorder="little", count=n * width).reshape(n, width)
        full = np.zeros((n, 32), np.uint8)
        full[:, :width] = bits
        values = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().copy()
    at += size
    over = np.frombuffer(raw[at : at + 2 * n_over], "<u2")
    high = np.frombuffer(raw[at + 2 * n_over : at + 6 * n_over], "<u4").astype(np.uint64)
    values[over] |= (high << np.uint64(width)).astype(np.uint32)
    return values + np.uint32(low)


def pack_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Head, index of block starts, blocks."""
    blocks = [pack_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([struct.pack(_TOP, MAGIC, len(ids), block), starts.tobytes(), *blocks])


def unpack_segment(raw: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop]; only the blocks that hold them are decoded."""
    view = memoryview(raw)
    magic, n, block = struct.unpack_from(_TOP, view)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    count = -(-n // block)
    starts = np.frombuffer(view[struct.calcsize(_TOP) : struct.calcsize(_TOP) + 8 * (count + 1)], "<u8")
    base = struct.calcsize(_TOP) + 8 * (count + 1)
    first, last = start // block, (stop - 1) // block
    parts = [unpack_block(view[base + int(starts[i]) : base + int(starts[i + 1])]) for i in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : stop - first * block]


_ROW = pa.schema(
    [("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())]
)
_ROW_DDL = "part int, before long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"


def _segments(vocabulary):
    def run(batches):
        known, part, before = encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []

        def flush():
            joined = np.concatenate(ids)
            row = [[part], [before], [len(joined)], [list(doc_ids)], [list(sizes)], [pack_segment(joined)]]
            doc_ids.clear(), sizes.clear(), ids.clear()
            return batch_of(_ROW, row), len(joined)

        held = 0
        for piece in pieces(batches, 1, LARGE):
            flat, lengths = known.encode(piece.column(1))
            doc_ids += piece.column(0).to_pylist()
            sizes += lengths.tolist()
            ids.append(flat)
            held += len(flat)
            if held >= SEGMENT:
                batch, n = flush()
                before, held = before + n, 0
                yield batch
        if held:
            yield flush()[0]

    return run


def write(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Write the ids of ``docs`` (doc_id, text) as segments below ``path``."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(_segments(shared), _ROW_DDL).write.parquet(path)


def with_starts(segments: DataFrame) -> DataFrame:
    """``segments`` and the global offset of each one's partition.

    The driver adds up one total per written partition, a number the cluster's settings
    fix; segments and documents never pass through it.
    """
    spark = segments.sparkSession
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, at = [], 0
    for part, n in totals:
        rows.append((part, at))
        at += n
    return segments.join(F.broadcast(spark.createDataFrame(rows, "part int, base long")), "part")


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_segment(row["payload"]).astype("<u4")
            sizes = np.array(row["sizes"], np.int64)
            starts = np.cumsum(sizes) - sizes
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), sizes.tolist())]
            yield batch_of(_DOCS, [pa.array(row["doc_ids"], pa.int64()), starts + (row["base"] + row["before"]), sizes, crc])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)
    return with_starts(segments).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to a new folder below the shared one and read it back."""
    path = run_dir(docs.sparkSession, "token-blocks")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
