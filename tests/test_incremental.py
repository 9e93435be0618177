"""Appended features equal the full rebuild."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ohmwatch.plans import incremental
from ohmwatch.plans.features import build_features
from ohmwatch.plans.prepare import prepare
from ohmwatch.session import run_dir
from ohmwatch.sources import fixtures

WINDOWS, PERIODS = (24, 48), (1, 24)


@pytest.fixture(scope="module")
def series(spark, sf):
    path = run_dir(spark, "series")
    prepare(fixtures.readings(spark, sf)).withColumn("H2", F.expr("CASE WHEN hour(ts) <> 7 THEN H2 END")).write.parquet(path)
    return spark.read.parquet(path)


def _cut(series, low, high):
    return series.filter((F.col("ts") >= low) & (F.col("ts") < high))


def test_appended_days_equal_the_full_table(spark, series):
    folder = run_dir(spark, "store")
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 21), dt.datetime(2024, 1, 22, 5), dt.datetime(2024, 2, 5)]
    late = (F.col("asset_id") != 3) | (F.col("ts") >= days[2])  # an asset that appears later
    series = series.filter(late)
    for low, high in zip(days, days[1:]):
        added = incremental.append(spark, folder, _cut(series, low, high), WINDOWS, PERIODS)
        assert added.count() == _cut(series, low, high).count()
    got = {(r.asset_id, r.ts): r for r in incremental.read_features(spark, folder).collect()}
    want = build_features(series, WINDOWS, PERIODS, fill=False)
    rows = {(r.asset_id, r.ts): r for r in want.collect()}
    assert set(got) == set(rows)
    for key, r in rows.items():
        for c in want.columns:
            a, b = got[key][c], r[c]
            assert a == (pytest.approx(b, rel=1e-9, abs=1e-7) if isinstance(b, float) else b), (key, c)


def test_only_the_newest_state_is_read(spark, series):
    folder = run_dir(spark, "store")
    incremental.append(spark, folder, _cut(series, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10)), WINDOWS, PERIODS)
    incremental.append(spark, folder, _cut(series, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11)), WINDOWS, PERIODS)
    assert incremental.newest(spark, folder) == 1
    state = spark.read.parquet(f"{folder}/state/part=1")
    assert state.count() == 5 and state.select(F.max(F.size("tail"))).first()[0] == max(WINDOWS) - 1
    read = incremental.append(spark, folder, _cut(series, dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 12)), WINDOWS, PERIODS)
    assert {r.f.split("features/")[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).collect()} == {"part=2"}


def test_a_gap_or_an_overlap_is_refused(spark, series):
    folder = run_dir(spark, "store")
    incremental.append(spark, folder, _cut(series, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)), WINDOWS, PERIODS)
    for start in (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 2)):
        with pytest.raises(ValueError, match="go on"):
            incremental.append(spark, folder, _cut(series, start, dt.datetime(2024, 1, 5)), WINDOWS, PERIODS)
