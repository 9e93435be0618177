"""Raw readings to feature rows and scores inside a stream.

One processor per asset does what ``prepare`` and ``build_features(fill=False)`` do on stored readings: the reading
with the lowest id of equal time stamps, hourly means, straight lines over gaps, moving statistics, differences and running
sums.  Its state is bounded:

* ``open``: readings of hours that the watermark has not passed, in packed parts (``waiting``), read hour by hour;
* ``waiting``: closed hours with a sensor whose next known value is still to come, PATIENCE hours at most
  (then a gap takes the last known value, or stays missing if there was none);
* ``tail``: the last rows of the clean series, as many as the longest window needs;
* running sums and the number of rows so far.

An hour is closed by an event-time timer once the watermark passes its end, so files may come in any order within
the delay.  State and timers are restored from the query's checkpoint.  What depends on one row only (gas diagnostics, thermal
columns, cyclic time) and the model are built-in expressions behind the processor.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ohmwatch.config import CHANGE_COLUMNS, CHANGE_PERIODS, HOUR, KEY, RATED_KVA, REQUIRED, ROLLING_COLUMNS, ROLLING_WINDOWS, TIE, TIME
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import add
from ohmwatch.plans.features import gas_diagnostics, gas_total_columns, thermal_columns
from ohmwatch.plans.prepare import validate
from ohmwatch.plans.scoring import score_health
from ohmwatch.streaming.waiting import EPOCH, OpenHours

DELAY = "2 hours"
PATIENCE = 720
CELLS = "cells"
#: Rows whose windows are laid out at once.
CHUNK = 256


def rolling_names(columns, windows=ROLLING_WINDOWS) -> list[str]:
    return [f"{c}_{s}_{w}h" for w in windows for c in columns for s in ("mean", "std", "max")]


def change_names(columns, periods=CHANGE_PERIODS) -> list[str]:
    return [f"{c}_roc_{p}h" for c in columns for p in periods]


def moving_values(values: np.ndarray, first: int, windows, periods, rolled: list[int], changing: list[int]) -> np.ndarray:
    """Moving statistics and differences of the rows from ``first`` on; rows before are their past."""
    n = len(values)
    out = []
    longest = max(windows)
    padded = np.concatenate([np.full((longest - 1, len(rolled)), np.nan), values[:, rolled]])
    for w in windows:
        need, parts = max(1, w // 4), []
        for at in range(first, n, CHUNK):
            end = min(n, at + CHUNK)
            frame = np.lib.stride_tricks.sliding_window_view(padded[at + longest - w : end + longest - 1], w, axis=0)
            known = ~np.isnan(frame)
            count = known.sum(axis=2)
            filled = np.where(known, frame, 0.0)
            mean = filled.sum(axis=2) / np.maximum(count, 1)
            spread = (np.where(known, frame - mean[:, :, None], 0.0) ** 2).sum(axis=2)
            std = np.sqrt(spread / np.maximum(count - 1, 1))
            top = np.where(known, frame, -np.inf).max(axis=2)
            few = count < need
            block = np.stack([np.where(few, np.nan, mean), np.where(few | (count < 2), np.nan, std), np.where(few, np.nan, top)], axis=2)
            parts.append(block.reshape(end - at, -1))
        out.append(np.concatenate(parts))
    for c in changing:
        for p in periods:
            at = np.arange(first, n)
            past = np.where(at >= p, values[np.maximum(at - p, 0), c], np.nan)
            out.append((values[first:, c] - past)[:, None])
    return np.concatenate(out, axis=1)


def hour_means(micros: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Means of an hour's readings, of those with the lowest id of their time stamp."""
    order = np.lexsort((ids, micros))
    first = np.concatenate([[True], np.diff(micros[order]) > 0])
    cells = cells[order[first]]
    known = ~np.isnan(cells)
    count = known.sum(axis=0)
    return np.where(count > 0, np.where(known, cells, 0.0).sum(axis=0) / np.maximum(count, 1), np.nan)


class FeatureProcessor(StatefulProcessor):
    """Clean hourly rows with moving values of one asset, from its raw readings."""

    def __init__(self, columns=REQUIRED, windows=ROLLING_WINDOWS, periods=CHANGE_PERIODS, rated_kva=RATED_KVA, patience=PATIENCE, key_type="int"):
        self.columns, self.windows, self.periods = list(columns), tuple(windows), tuple(periods)
        self.rated_kva, self.patience = rated_kva, patience
        self.rolled = [c for c in ROLLING_COLUMNS if c in self.columns]
        self.changing = [c for c in CHANGE_COLUMNS if c in self.columns]
        self.sums = [n for n, c in (("cumulative_overload", "load_kva"), ("cumulative_aging", "hot_spot_temp")) if c in self.columns]
        self.made = [*rolling_names(self.rolled, self.windows), *change_names(self.changing, self.periods), *self.sums]
        self.reach = max(max(self.windows) - 1, max(self.periods))
        self.schema = f"{KEY} {key_type}, {TIME} timestamp, " + ", ".join(f"`{c}` double" for c in [*self.columns, *self.made])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = OpenHours(handle, lambda cells: (np.array(cells, "<f8").tobytes(), []))
        # Apart from the rest, for every timer asks for it.
        self.closed = handle.getValueState("closed", "hour long")
        self.past = handle.getValueState("past", "last long, tail binary, sums binary, waiting_at binary, waiting binary")

    def _read(self):
        width = len(self.columns)
        if not self.past.exists():
            return None, np.zeros((0, width)), np.zeros(len(self.sums)), np.zeros(0, np.int64), np.zeros((0, width))
        last, *raw = self.past.get()
        tail, sums, at, waiting = (np.frombuffer(bytes(x), kind) for x, kind in zip(raw, ("<f8", "<f8", "<i8", "<f8")))
        return last, tail.reshape(-1, width), sums, at, waiting.reshape(-1, width)

    def handleInputRows(self, key, rows, timerValues):
        closed = self.closed.get()[0] if self.closed.exists() else None
        self.open.add(rows, lambda r: r[CELLS], closed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = timerValues.getCurrentWatermarkInMs() // (HOUR * 1000)  # hours before this one are complete
        if self.closed.exists() and self.closed.get()[0] >= due:
            return iter(())
        last, tail, sums, at, waiting = self._read()
        hours, means = [], []
        for hour, micros, ids, parts in self.open.take(due):
            hours.append(hour)
            means.append(hour_means(micros, ids, np.frombuffer(b"".join(raw for raw, _ in parts), "<f8").reshape(len(micros), -1)))
        found = np.array(means, float).reshape(-1, len(self.columns))
        at, waiting = np.concatenate([at, np.array(hours, np.int64)]), np.concatenate([waiting, found])
        out, last, tail, sums, at, waiting = self._advance(last, tail, sums, at, waiting, due)
        self.closed.update((due,))
        kinds = (float, float, np.int64, float)
        self.past.update((last, *[np.ascontiguousarray(x, kind).tobytes() for x, kind in zip((tail, sums, at, waiting), kinds)]))
        return iter([Row(**{KEY: key[0]}, **r) for r in out])

    def _advance(self, last, tail, sums, at, waiting, due):
        """Emit every hour whose sensors all have a known value then or later, or that has waited too long."""
        if not len(at):
            return [], last, tail, sums, at, waiting
        width = len(self.columns)
        start = int(at[0]) if last is None else last + 1
        grid = np.full((int(at[-1]) - start + 1, width), np.nan)
        grid[at - start] = waiting
        known = ~np.isnan(grid)
        place = np.arange(len(grid))
        upto = np.array([np.flatnonzero(known[:, c])[-1] if known[:, c].any() else -1 for c in range(width)])
        n = max(int(upto.min()) + 1, min(len(grid), due - self.patience - start))
        if n <= 0:
            return [], last, tail, sums, at, waiting
        rows = grid[:n].copy()
        for c in range(width):
            own = np.flatnonzero(known[:, c])
            x, y = own, grid[own, c]
            # What follows the last known value waits or carries on; what precedes the first one takes it.
            if len(tail) and not np.isnan(tail[-1, c]):
                x, y = np.concatenate([[-1], x]), np.concatenate([[tail[-1, c]], y])
            if len(x):
                rows[:, c] = np.interp(place[:n], x, y)
        values = np.concatenate([tail, rows])
        index = {c: i for i, c in enumerate(self.columns)}
        moving = moving_values(values, len(tail), self.windows, self.periods, [index[c] for c in self.rolled], [index[c] for c in self.changing])
        added = []
        if "load_kva" in index:
            added.append(np.maximum(rows[:, index["load_kva"]] / self.rated_kva - 1.0, 0.0))
        if "hot_spot_temp" in index:
            added.append(np.minimum(np.exp((rows[:, index["hot_spot_temp"]] - 98.0) / 6.0), 50.0))
        added = np.array(added).reshape(len(self.sums), n)
        running = sums[:, None] + np.cumsum(np.where(np.isnan(added), 0.0, added), axis=1)
        shown = np.where(np.isnan(added), np.nan, running)
        sums = running[:, -1] if len(running) else sums
        every = np.concatenate([rows, moving, shown.T], axis=1)
        names = [*self.columns, *self.made]
        out = []
        for i in range(n):
            stamp = EPOCH + dt.timedelta(hours=start + i)
            out.append({TIME: stamp} | {c: None if np.isnan(v) else float(v) for c, v in zip(names, every[i])})
        later = at >= start + n
        return out, start + n - 1, values[-self.reach :], sums, at[later], waiting[later]

    def close(self) -> None:
        pass


def feature_stream(readings: DataFrame, delay: str = DELAY, patience: int = PATIENCE, windows=ROLLING_WINDOWS, periods=CHANGE_PERIODS) -> DataFrame:
    """Feature rows (those of ``build_features(prepare(readings), fill=False)``) of a stream of raw readings."""
    processor = FeatureProcessor(windows=windows, periods=periods, patience=patience, key_type=readings.schema[KEY].dataType.simpleString())
    # One column of cells: what a reading costs in Python is mostly its number of columns.
    cells = F.array(*[F.col(c).cast("double") for c in processor.columns]).alias(CELLS)
    raw = validate(readings).withColumn(TIME, F.col(TIME).cast("timestamp")).select(KEY, TIE, TIME, cells)
    moved = raw.withWatermark(TIME, delay).groupBy(KEY).transformWithState(processor, processor.schema, "append", "eventTime")
    local = thermal_columns(processor.columns) | gas_total_columns(processor.columns)
    return add(gas_diagnostics(add(moved, local)), d.cyclic_time(TIME))


def score_raw_stream(readings: DataFrame, model: PipelineModel, **options) -> DataFrame:
    """Health of every clean hour of a stream of raw readings."""
    return score_health(feature_stream(readings, **options), model)
