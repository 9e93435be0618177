"""Readings that wait in the state until the watermark has passed their hour.

They are kept in parts: one entry per hour and flush, the readings of the part as packed columns.  A task holds FLUSH readings
while files come in, and one hour's readings at a time when hours are closed, however many wait.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ohmwatch.config import HOUR, TIE, TIME

EPOCH = dt.datetime(1970, 1, 1)
HOUR_MICROS = HOUR * 1_000_000
#: Readings that are packed at once.
FLUSH = 1 << 16
#: A missing id counts as the lowest, as in a sort of stored readings.
NO_ID = -(1 << 63)


class OpenHours:
    """``pack`` turns the cells of a part's readings into bytes and the names these refer to."""

    def __init__(self, handle: StatefulProcessorHandle, pack: Callable[[list], tuple[bytes, list[str]]]):
        self.handle, self.pack = handle, pack
        self.parts = handle.getMapState("open_parts", "hour long, part long", "micros binary, ids binary, cells binary, names array<string>")
        self.next = handle.getValueState("next_part", "part long")

    def add(self, rows, cells: Callable, closed: int | None) -> None:
        """Keep the rows of hours from ``closed`` on, and ask for a timer at the end of each hour."""
        part = self.next.get()[0] if self.next.exists() else 0
        timers: set[int] = set()
        held: dict[int, list] = {}
        n = 0
        for r in rows:
            micros = (r[TIME] - EPOCH.replace(tzinfo=r[TIME].tzinfo)) // dt.timedelta(microseconds=1)
            hour = micros // HOUR_MICROS
            if closed is not None and hour < closed:
                continue  # behind the watermark
            held.setdefault(hour, []).append((micros, NO_ID if r[TIE] is None else r[TIE], cells(r)))
            n += 1
            if n == FLUSH:
                part, n = self._write(held, part, timers), 0
                held = {}
        part = self._write(held, part, timers)
        self.next.update((part,))

    def _write(self, held: dict[int, list], part: int, timers: set[int]) -> int:
        for hour, readings in held.items():
            micros, ids, cells = zip(*readings)
            raw, names = self.pack(cells)
            self.parts.updateValue((hour, part), (np.array(micros, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), raw, names))
            if hour not in timers:
                self.handle.registerTimer((hour + 1) * HOUR * 1000)
                timers.add(hour)
        return part + 1

    def take(self, due: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[bytes, list[str]]]]]:
        """Hour by hour before ``due``, in order: (hour, times, ids, packed cells of its parts); they leave the state."""
        ready: dict[int, list[int]] = {}
        for hour, part in self.parts.keys():
            if hour < due:
                ready.setdefault(hour, []).append(part)
        for hour in sorted(ready):
            micros, ids, cells = [], [], []
            for part in sorted(ready[hour]):
                a, b, raw, names = self.parts.getValue((hour, part))
                micros.append(np.frombuffer(bytes(a), "<i8"))
                ids.append(np.frombuffer(bytes(b), "<i8"))
                cells.append((bytes(raw), list(names)))
                self.parts.removeKey((hour, part))
            yield hour, np.concatenate(micros), np.concatenate(ids), cells
