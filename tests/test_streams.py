"""Streams over several files equal their batch twins."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ohmwatch.operators import tables as t
from ohmwatch.operators.sequences import fault_episodes
from ohmwatch.session import run_dir
from ohmwatch.sources import fixtures
from ohmwatch.streaming import jobs, runs
from ohmwatch.streaming.runs import fault_runs

LATER = dt.datetime(2100, 1, 1)


@pytest.fixture(scope="module")
def batch(spark, sf):
    return jobs.event_time(fixtures.readings(spark, sf)).cache()


@pytest.fixture(scope="module")
def files(spark, batch):
    """Four files in time order, then one far-later row."""
    path = run_dir(spark, "stream")
    edges = [i * 250 for i in range(5)]
    for lo, hi in zip(edges, edges[1:]):
        part = batch.filter((F.col("reading_id") >= lo) & (F.col("reading_id") < hi))
        part.coalesce(1).write.mode("append").parquet(path)
    last = batch.limit(1).withColumns({"ts": F.lit(LATER), "fault_type": F.lit("overheating")})
    last.coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, batch, files, job):
    stream = job(jobs.read_stream(spark, files, batch.schema, files_per_batch=1))
    return jobs.run_to_end(stream, run_dir(spark, "out"), run_dir(spark, "progress"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hourly_means(spark, batch, files):
    out = run(spark, batch, files, lambda s: jobs.hourly_means(s, ["H2"])).filter(F.col("ts") < F.lit(LATER))
    want = batch.groupBy("asset_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("H2").alias("H2"))
    got, expected = rows(out, "asset_id", "ts", "H2"), rows(want, "asset_id", "ts", "H2")
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in expected])


def test_alerts(spark, batch, files):
    out = run(spark, batch, files, jobs.alert_stream).filter(F.col("ts") < F.lit(LATER))
    names = ("reading_id", "parameter", "value", "message")
    assert rows(out, *names) == rows(t.alerts(batch), *names)


def test_first_copies(spark, batch, files):
    def doubled(s):
        return jobs.first_copies(s.unionByName(s))

    out = run(spark, batch, files, doubled).filter(F.col("ts") < F.lit(LATER))
    assert rows(out, "asset_id", "ts") == rows(batch.select("asset_id", "ts").distinct(), "asset_id", "ts")


def test_fault_sessions(spark, batch, files):
    out = run(spark, batch, files, jobs.fault_sessions).filter(F.col("start_ts") < F.lit(LATER))
    names = ("asset_id", "fault_type", "start_ts", "end_ts", "n_rows")
    assert rows(out, *names) == rows(jobs.fault_sessions(batch), *names)


def test_fault_runs_of_files_in_any_order(spark, batch):
    """Four files whose times overlap, within the delay: the runs of the stored readings, but for each asset's last one."""
    path = run_dir(spark, "mixed")
    for part in (2, 0, 3, 1):
        batch.filter(F.col("reading_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    last = batch.limit(1).withColumns({"ts": F.lit(LATER), "asset_id": F.lit(-1)})
    last.coalesce(1).write.mode("append").parquet(path)
    out = run(spark, batch, path, lambda s: fault_runs(s, delay="60 days"))
    want = fault_episodes(batch)
    names = ("asset_id", "fault_type", "start_ts", "end_ts", "n_rows")
    newest = {r.asset_id: r.ts for r in batch.groupBy("asset_id").agg(F.max("ts").alias("ts")).collect()}
    assert rows(out, *names) == [r for r in rows(want, *names) if r[3] < newest[r[0]]]


def test_rows_behind_the_watermark_are_dropped(spark, batch):
    path = run_dir(spark, "late")
    one = batch.limit(1)
    # A batch is checked against the watermark of the batch before it.
    for at, h2 in ((dt.datetime(2024, 1, 1, 10), 1.0), (dt.datetime(2024, 1, 2), 2.0),
                   (dt.datetime(2024, 1, 2, 0, 30), 2.0), (dt.datetime(2024, 1, 1, 10, 30), 99.0),
                   (LATER, 3.0)):
        one.withColumns({"ts": F.lit(at), "H2": F.lit(h2)}).coalesce(1).write.mode("append").parquet(path)
    out = run(spark, batch, path, lambda s: jobs.hourly_means(s, ["H2"]))
    assert [r.H2 for r in out.filter(F.col("ts") < F.lit(LATER)).orderBy("ts").collect()] == [1.0, 2.0]


def test_ended_runs_of_a_task_leave_it_packed(monkeypatch):
    """A row holds many runs, as the rows of a task wait for its last one; ids and kinds break ties, kinds are named per part."""
    monkeypatch.setattr(runs, "PACKED", 3)
    kinds = ["a", "b", "b", "normal", "a", "b", "a", "b"]
    held = [(0, np.arange(5), np.arange(5), [runs._packed(kinds[:2]), runs._packed(kinds[2:5])]), (1, np.arange(5, 8), np.arange(3), [runs._packed(kinds[5:])])]
    state = {}

    class Value:
        def __init__(self, name):
            self.exists, self.get, self.update = (lambda: name in state), (lambda: state[name]), (lambda x: state.__setitem__(name, x))

    processor = runs.RunProcessor()
    processor.closed, processor.run = Value("closed"), Value("run")
    processor.open = type("Open", (), {"take": staticmethod(lambda due: iter(held))})
    times = type("Times", (), {"getCurrentWatermarkInMs": staticmethod(lambda: 2 * 3_600_000)})
    made = list(processor.handleExpiredTimer((7,), times, None))
    packed = pa.RecordBatch.from_pylist([r.asDict() for r in made])
    flat = [x for batch in runs.unpack([packed]) for x in zip(*(c.to_pylist() for c in batch.columns))]
    assert len(made) == 2
    assert flat == [(7, "a", 0, 0, 1), (7, "b", 1, 2, 2), (7, "a", 4, 4, 1), (7, "b", 5, 5, 1), (7, "a", 6, 6, 1)]
    assert state == {"closed": (2,), "run": ("b", 7, 7, 1)}
