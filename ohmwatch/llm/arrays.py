"""Text columns as NumPy arrays: words, hashes and ragged indexing inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ohmwatch.session import run_dir

U64 = np.uint64
#: Bytes of text that a task holds as arrays at a time; one longer text is taken whole.
#: LARGE is for work that gains from seeing more words at once.
PIECE, LARGE = 1 << 19, 1 << 20
#: Rows and bytes of text that Spark hands to a worker at a time while a table is stored.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

# The byte classes of the two kinds of words.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
WORD_RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANKS)] = False
WORD = np.zeros(256, bool)
for _low, _high in WORD_RANGES:
    WORD[_low : _high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if cache.get("n", -1) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            cache[name] = np.cumprod(steps, dtype=U64)
        cache["n"] = size
    return cache["up"][:n], cache["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes anywhere."""
    sums = _sums(_BYTES[data])
    _, down = powers(len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes from each start."""
    sums = _sums(hashes)
    _, down = powers(len(hashes) + 1)
    return mixed((sums[starts + size] - sums[starts]) * down[starts])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches, column: int, limit: int = PIECE):
    """Cut record batches into slices of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    batches = batch = None
    release()


def release() -> None:
    """Give freed memory back to the system before a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first span of each row, with the total as the last entry."""
    return np.searchsorted(starts, offsets).astype(np.int64)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], row by row: what stands in another row
    never changes the rounding of a row's sum."""
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values.astype(out.dtype, copy=False), bounds[full])
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``size`` steps, one run after the other."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(total, dtype=np.int64) + shift


def positions(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster here than a hash table)."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for the jobs inside; the session's own settings come back after."""
    before = {name: spark.conf.get(name) for name in BATCH}
    try:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to a new folder below the shared one and read it back: a cut of the lineage
    that outlives executors."""
    spark = df.sparkSession
    path = run_dir(spark, f"{label}-{uuid.uuid4().hex[:8]}")
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def with_struct(docs: DataFrame, text: str, wanted: str, fields: dict[str, str], start) -> tuple[DataFrame, str]:
    """``docs`` with a struct column computed from the text, and that column's name.

    ``start()`` runs once in a task and returns the function from a text column to one
    array per field; it sees PIECE bytes of text at a time.
    """
    at, name = docs.columns.index(text), free_name(docs, wanted)
    ddl = ", ".join(f"{k}: {v}" for k, v in fields.items())
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"`{name}` struct<{ddl}>").fields])

    def run(batches):
        make = start()
        for piece in pieces(batches, at):
            columns = [pa.array(x, _ARROW[kind]) for x, kind in zip(make(piece.column(at)), fields.values(), strict=True)]
            made = pa.StructArray.from_arrays(columns, names=list(fields))
            yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*piece.schema.names, "made"])

    return docs.mapInArrow(run, schema), name
