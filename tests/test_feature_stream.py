"""Features made inside a stream equal the batch table, also over a restart."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ohmwatch.plans.features import build_features
from ohmwatch.plans.prepare import prepare
from ohmwatch.session import run_dir
from ohmwatch.sources import fixtures
from ohmwatch.streaming import jobs, waiting
from ohmwatch.streaming.features import feature_stream, hour_means

WINDOWS, PERIODS = (24, 48), (1, 24)


@pytest.fixture(scope="module")
def raw(spark, sf):
    return fixtures.with_copies(fixtures.readings(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp")).cache()


def _files(raw, path, low, high):
    """One file per five days, copies included."""
    for day in range(low, high, 5):
        start, end = dt.datetime(2024, 1, 1) + dt.timedelta(days=day), dt.datetime(2024, 1, 1) + dt.timedelta(days=day + 5)
        raw.filter((F.col("ts") >= start) & (F.col("ts") < end)).coalesce(1).write.mode("append").parquet(path)


def _run(spark, raw, path, out, progress):
    stream = jobs.read_stream(spark, path, raw.schema, files_per_batch=1)
    features = feature_stream(stream, delay="1 hour", windows=WINDOWS, periods=PERIODS)
    return jobs.run_to_end(features, out, progress)


def test_stream_equals_batch_over_a_restart(spark, raw):
    path, out, progress = (run_dir(spark, x) for x in ("raw", "out", "progress"))
    _files(raw, path, 0, 15)
    first = _run(spark, raw, path, out, progress).count()
    _files(raw, path, 15, 31)
    last = raw.limit(1).withColumns({"ts": F.lit(dt.datetime(2024, 2, 5)), "asset_id": F.lit(-1)})
    last.coalesce(1).write.mode("append").parquet(path)
    got = {(r.asset_id, r.ts): r for r in _run(spark, raw, path, out, progress).collect() if r.asset_id >= 0}
    want = build_features(prepare(raw), WINDOWS, PERIODS, fill=False)
    rows = {(r.asset_id, r.ts): r for r in want.collect()}
    assert 0 < first < len(got)
    # Hours after the last known value of some sensor still wait; nothing else may be absent.
    known = {}
    for key in got:
        known[key[0]] = max(key[1], known.get(key[0], key[1]))
    assert set(got) == {k for k in rows if k[1] <= known[k[0]]}
    assert len(rows) - len(got) < 5 * 24
    names = [c for c in want.columns if c not in ("asset_id", "ts")]
    assert set(names) <= set(next(iter(got.values())).asDict())
    for key, r in got.items():
        for c in names:
            a, b = r[c], rows[key][c]
            assert a == b if isinstance(b, (str, type(None))) else a == pytest.approx(b, rel=1e-9, abs=1e-7), (key, c)


def test_an_unknown_sensor_waits_no_longer_than_the_patience(spark, raw):
    path = run_dir(spark, "silent")
    silent = raw.withColumn("CO", F.lit(None).cast("double"))
    _files(silent, path, 0, 10)
    stream = jobs.read_stream(spark, path, silent.schema, files_per_batch=1)
    made = feature_stream(stream, delay="1 hour", patience=24, windows=WINDOWS, periods=PERIODS)
    got = jobs.run_to_end(made, run_dir(spark, "out"), run_dir(spark, "progress"))
    shown = got.agg(F.count("*").alias("n"), F.count("CO").alias("co"), F.max("ts").alias("last")).first()
    assert shown.n > 0 and shown.co == 0 and shown["last"] < dt.datetime(2024, 1, 10)


@pytest.mark.parametrize("flush", [7, 1 << 16])
def test_waiting_readings_are_kept_in_parts_and_read_hour_by_hour(monkeypatch, flush):
    """A task holds no more than FLUSH readings of what comes in, and no more than one hour of what is closed."""
    monkeypatch.setattr(waiting, "FLUSH", flush)
    parts, timers, asked = {}, [], []

    class Map:
        updateValue = staticmethod(parts.__setitem__)  # noqa: N815
        removeKey = staticmethod(parts.__delitem__)  # noqa: N815
        keys = staticmethod(lambda: iter(list(parts)))
        getValue = staticmethod(lambda k: asked.append(k) or parts[k])  # noqa: N815

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, x: setattr(self, "held", x)

    class Handle:
        getMapState = staticmethod(lambda *_: Map)  # noqa: N815
        getValueState = staticmethod(lambda *_: Value())  # noqa: N815
        registerTimer = staticmethod(timers.append)  # noqa: N815

    start = dt.datetime(2024, 1, 1)
    readings = [(start + dt.timedelta(minutes=(i * 37) % 600), i, [float(i), None]) for i in range(100)]
    open_hours = waiting.OpenHours(Handle, lambda cells: (np.array(cells, "<f8").tobytes(), []))
    one = [Row(ts=t, reading_id=i, cells=c) for t, i, c in readings]
    open_hours.add(iter(one[:50]), lambda r: r.cells, None)
    open_hours.add(iter(one[50:]), lambda r: r.cells, 473352 + 2)  # two hours of ten are behind the watermark
    want = [r for k, r in enumerate(readings) if k < 50 or r[0].hour >= 2]
    assert max(len(np.frombuffer(a, "<i8")) for a, *_ in parts.values()) <= flush
    assert {x // 3_600_000 - 473353 for x in timers} == set(range(10))
    got = []
    for n, (hour, micros, ids, cells) in enumerate(open_hours.take(473352 + 8)):
        assert len({h for h, _ in asked}) == n + 1 and len(micros) == len(ids)
        got += ids.tolist()
        assert np.frombuffer(b"".join(raw for raw, _ in cells), "<f8").reshape(-1, 2)[:, 0].tolist() == ids.tolist()
        assert (micros // 3_600_000_000 == hour).all()
    assert sorted(got) == sorted(i for t, i, _ in want if t.hour < 8) and {h for h, _ in parts} == {473360, 473361}


def test_hour_means_take_the_lowest_id_of_a_time():
    means = hour_means(np.array([5, 3, 5]), np.array([9, 4, 2]), np.array([[100.0, 1.0], [1.0, np.nan], [2.0, np.nan]]))
    assert means[0] == 1.5 and np.isnan(means[1])
