"""Fault episodes inside a stream: the maximal runs of one kind that ``fault_episodes`` finds on stored readings.

Readings wait in the state, in packed parts, until the watermark has passed their hour, so files may come in any order within the delay.
They are then taken in the order of (time, id); a run is given out when a reading of another kind ends it. Per asset the state
holds the readings of open hours and one run.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ohmwatch.config import HOUR, KEY, NO_FAULT, TIE, TIME
from ohmwatch.streaming.waiting import OpenHours

#: Runs that are handed on in one row.
PACKED = 1 << 12


def _packed(kinds) -> tuple[bytes, list[str]]:
    names = sorted(set(kinds))
    place = {k: i for i, k in enumerate(names)}
    return np.array([place[k] for k in kinds], "<i4").tobytes(), names


class RunProcessor(StatefulProcessor):
    """Gives the ended runs out packed, up to PACKED in a row: all rows of a task stay in its memory until the last one is made."""

    def __init__(self, normal: str = NO_FAULT, key_type: str = "int"):
        self.normal = normal
        self.schema = f"{KEY} {key_type}, names array<string>, runs binary"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = OpenHours(handle, _packed)
        self.closed = handle.getValueState("closed", "hour long")
        self.run = handle.getValueState("run", "kind string, first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        closed = self.closed.get()[0] if self.closed.exists() else None
        self.open.add(rows, lambda r: r["fault_type"] or self.normal, closed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = timerValues.getCurrentWatermarkInMs() // (HOUR * 1000)
        if self.closed.exists() and self.closed.get()[0] >= due:
            return
        run = tuple(self.run.get()) if self.run.exists() else None
        ended: list[tuple] = []
        for _, micros, ids, parts in self.open.take(due):
            for part in self._runs(micros, ids, parts):
                if run and run[0] == part[0]:
                    run = (run[0], run[1], part[2], run[3] + part[3])
                    continue
                if run and run[0] != self.normal:
                    ended.append(run)
                run = part
            while len(ended) >= PACKED:
                yield self._row(key, ended[:PACKED])
                del ended[:PACKED]
        if ended:
            yield self._row(key, ended)
        self.closed.update((due,))
        if run:
            self.run.update(run)

    @staticmethod
    def _runs(micros, ids, parts) -> list[tuple]:
        """(kind, first, last, number) of the runs of one hour, in the order of (time, id, kind)."""
        names = sorted({n for _, own in parts for n in own})
        place = {n: i for i, n in enumerate(names)}
        kinds = np.concatenate([np.array([place[n] for n in own])[np.frombuffer(raw, "<i4")] for raw, own in parts])
        order = np.lexsort((kinds, ids, micros))
        micros, kinds = micros[order], kinds[order]
        starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        ends = np.append(starts[1:], len(kinds))
        return [(names[k], a, z, n) for k, a, z, n in zip(kinds[starts].tolist(), micros[starts].tolist(), micros[ends - 1].tolist(), (ends - starts).tolist())]

    @staticmethod
    def _row(key, ended: list[tuple]) -> Row:
        kinds, firsts, lasts, counts = zip(*ended)
        codes, names = _packed(kinds)
        firsts = np.array(firsts, "<i8")
        table = np.stack([np.frombuffer(codes, "<i4"), np.diff(firsts, prepend=0), np.array(lasts) - firsts, np.array(counts)]).astype("<i8")
        return Row(**{KEY: key[0]}, names=names, runs=zlib.compress(table.tobytes(), 1))

    def close(self) -> None:
        pass


def unpack(batches):
    """(key, kind, first, last, number) of packed runs; a batch for each packed row."""
    for batch in batches:
        keys, names, packed = batch.columns
        for i in range(batch.num_rows):
            codes, steps, lengths, counts = np.frombuffer(zlib.decompress(packed[i].as_py()), "<i8").reshape(4, -1)
            firsts = np.cumsum(steps)
            key = keys.take(pa.array(np.full(len(codes), i)))
            kinds = pa.array(names[i].as_py(), pa.string()).take(pa.array(codes))
            yield pa.RecordBatch.from_arrays([key, kinds, *map(pa.array, (firsts, firsts + lengths, counts))], names=[KEY, "kind", "first", "last", "n"])


def fault_runs(stream: DataFrame, delay: str = "2 hours", normal: str = NO_FAULT) -> DataFrame:
    """(asset, fault_type, start_ts, end_ts, n_rows) of every run that another kind has ended."""
    processor = RunProcessor(normal, stream.schema[KEY].dataType.simpleString())
    timed = stream.select(KEY, TIE, F.col(TIME).cast("timestamp").alias(TIME), "fault_type").withWatermark(TIME, delay)
    packed = timed.groupBy(KEY).transformWithState(processor, processor.schema, "append", "eventTime")
    key = packed.schema[KEY].dataType.simpleString()
    runs = packed.mapInArrow(unpack, f"{KEY} {key}, kind string, first long, last long, n long")
    return runs.selectExpr(KEY, "kind AS fault_type", "timestamp_micros(first) AS start_ts", "timestamp_micros(last) AS end_ts", "n AS n_rows")
