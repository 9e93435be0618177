"""Concatenate and cut: documents as one stream of ids, cut into fixed windows.

Pass one encodes the documents and stores their ids with the number of ids before them in
their partition.  The partitions' totals, summed up, give every document its place in
the stream of all ids; pass two cuts each document where a window ends.  No shuffle and
no order between tasks is needed.  Only the last sequence is shorter than the window; it
is padded with the pad id to the window (``sequences``).

Null and empty texts are the end id alone.  Repeated rows are packed repeatedly, each with
its own places.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import LARGE, batch_of, pieces, stored
from ohmwatch.llm.token_blocks import with_starts
from ohmwatch.llm.tokens import encoder, shared_vocabulary

WINDOW = 2048
PAD = 0

_ENCODED = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def _encode(vocabulary):
    def run(batches):
        known, part, before = encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        narrow = known.tokenizer.get_vocab_size() <= 1 << 16
        for piece in pieces(batches, 1, LARGE):
            ids, sizes = known.encode(piece.column(1))
            width = 2 if narrow else 4
            raw = ids.astype(f"<u{width}").tobytes()
            ends = np.cumsum(sizes)
            offsets = np.concatenate([[0], ends * width]).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
            n = len(sizes)
            yield batch_of(_ENCODED, [np.full(n, part, np.int32), before + ends - sizes, sizes, piece.column(0), binary])
            before += int(ends[-1])

    return run


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def _cut(window: int, keep_ids: bool):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            doc_id, ids = batch.column(names.index("doc_id")), batch.column(names.index("ids"))
            at, before, n = (batch.column(names.index(c)).to_numpy() for c in ("base", "before", "n_ids"))
            at = at + before
            first, last = at // window, (at + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            begin = np.maximum(sequence * window, at[row])
            end = np.minimum((sequence + 1) * window, (at + n)[row])
            start, length = begin - at[row], end - begin
            crc, parts, held, wide = [], [], -1, b""
            for r, s, k in zip(row.tolist(), start.tolist(), length.tolist()):
                if r != held:
                    raw = ids[r].as_buffer()
                    width = len(raw) // int(n[r])
                    wide, held = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()), r
                own = wide[4 * s : 4 * (s + k)]
                crc.append(zlib.crc32(own))
                parts.append(own.tobytes() if keep_ids else None)
            yield batch_of(
                _PIECES,
                [doc_id.take(pa.array(row)), start, length, crc, n[row], sequence, begin - sequence * window, pa.array(parts, pa.binary())],
            )

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    with ``ids`` also the ids themselves (little-endian unsigned 32-bit)."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    encoded = stored(
        docs.select("doc_id", "text").mapInArrow(_encode(shared), "part int, before long, n_ids long, doc_id long, ids binary"), "packing"
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    cut = with_starts(encoded).mapInArrow(_cut(window, ids), schema)
    return cut if ids else cut.drop("ids")


def sequences(pieces_: DataFrame, window: int = WINDOW, pad: int = PAD) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of ``window``), n_ids before the pad.

    A sequence has at most ``window`` pieces, so its group is bounded.
    """
    joined = (
        pieces_.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
        .withColumn("raw", F.expr("aggregate(transform(parts, p -> hex(p.ids)), '', (a, x) -> concat(a, x))"))
    )
    value = F.expr(
        "transform(sequence(0, int(n_ids) - 1), i -> cast(conv(concat(substr(raw, 8*i+7, 2), substr(raw, 8*i+5, 2), "
        "substr(raw, 8*i+3, 2), substr(raw, 8*i+1, 2)), 16, 10) AS int))"
    )
    filled = F.concat(value, F.array_repeat(F.lit(pad), F.lit(window) - F.col("n_ids").cast("int")))
    return joined.select("sequence_id", filled.alias("ids"), "n_ids")
