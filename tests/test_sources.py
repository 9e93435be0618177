"""Scans, sinks and stores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ohmwatch.plans.scoring import with_health
from ohmwatch.session import run_dir
from ohmwatch.sources import fixtures, readings, store


def write(tmp_path, text, name="r.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name", ["timestamp", "Date", "DATETIME", "time", "Index"])
def test_time_column_by_name(spark, tmp_path, name):
    df = readings.read_csv(spark, write(tmp_path, f"H2,{name}\n1.5,2024-01-01 12:00:00\n2,2024-01-02 13:00:00\n"))
    assert df.columns == ["H2", "ts", "asset_id", "reading_id"]
    assert [r.ts for r in df.orderBy("ts").collect()] == [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 13)]


def test_first_named_column_that_parses_wins_else_first_column(spark, tmp_path):
    text = "date,Time,H2\nnot a date,2024-01-01 12:00:00,1\n,2024-01-02 12:00:00,2\n"
    assert "date" in readings.read_csv(spark, write(tmp_path, text)).columns
    text = "when,H2\n2024-01-01,1\n2024-01-02,2\n"
    df = readings.read_csv(spark, write(tmp_path, text, "w.csv"))
    assert df.columns[0] == "ts" and df.schema["ts"].dataType.simpleString() == "timestamp"


def test_no_time_column_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no time column"):
        readings.read_csv(spark, write(tmp_path, "a,b\nx,1\ny,2\n"))
    with pytest.raises(ValueError, match="no time column"):
        readings.read_csv(spark, write(tmp_path, "time,b\n1,1\n2,2\n", "int.csv"))


def test_absent_and_broken_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readings.read_csv(spark, str(tmp_path / "nothing.csv"))
    with pytest.raises(FileNotFoundError):
        readings.read_parquet(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        readings.read_csv(spark, write(tmp_path, ""))


def test_nan_becomes_missing(spark, tmp_path):
    df = readings.read_csv(spark, write(tmp_path, "ts,H2\n2024-01-01,NaN\n2024-01-02,2.5\n"))
    assert [r.H2 for r in df.orderBy("ts").collect()] == [None, 2.5]


def test_csv_and_parquet_round_trip(spark, sf):
    df = fixtures.readings(spark, sf)
    path = run_dir(spark, "csv")
    readings.write_csv(df, path)
    back = readings.read_csv(spark, path)
    assert spark.read.csv(path, header=True).columns[0] == "ts"
    assert back.count() == df.count()
    assert back.agg(F.sum("H2")).first()[0] == pytest.approx(df.agg(F.sum("H2")).first()[0])
    path = run_dir(spark, "parquet")
    readings.write_parquet(df, path)
    stored = spark.read.parquet(path)
    assert "PartitionFilters: [isnotnull" in str(
        stored.filter("asset_id = 3")._jdf.queryExecution().executedPlan()
    ) or "asset_id" in stored.columns
    assert readings.read_parquet(spark, path).count() == df.count()


def test_prediction_sink(spark, sf):
    path = run_dir(spark, "predictions")
    readings.write_predictions(with_health(fixtures.scored(fixtures.readings(spark, sf))), path)
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert back.columns == ["asset_id", "ts", "health_score", "failure_proba", "risk_level"]
    assert back.count() == 1000


def test_metrics_store(spark):
    folder = run_dir(spark, "metrics")
    assert store.load_metrics(spark, folder) == {}
    table = spark.createDataFrame(
        [("H2", "7d", 1.23456, 0.5, None, 10)],
        "target string, horizon string, cv_rmse_mean double, cv_rmse_std double, cv_mae_mean double, n_samples long",
    )
    store.save_metrics(table, folder, "forecast_metrics")
    found = store.load_metrics(spark, folder)
    assert list(found) == ["forecast_metrics"]
    row = store.forecast_table(found["forecast_metrics"]).first()
    assert (row.target, row.cv_rmse_mean, row.cv_mae_mean, row.n_samples) == ("H2", 1.235, 0.0, 10)


def test_nested_metrics(spark, tmp_path):
    text = '{"H2": {"7d": {"cv_rmse_mean": 8.0, "cv_rmse_std": 1, "cv_mae_mean": 6.0, "n_samples": 5}, "30d": {}}}'
    rows = store.nested_forecast_metrics(spark, write(tmp_path, text, "m.json")).orderBy("horizon").collect()
    assert [(r.target, r.horizon, r.cv_rmse_mean, r.n_samples) for r in rows] == [
        ("H2", "30d", None, None), ("H2", "7d", 8.0, 5)]


def test_files_of_several_assets(spark, tmp_path):
    """Equal time stamps in two files: the asset is in the name, or the call is refused."""
    for k in (3, 7):
        write(tmp_path, "".join(["ts,H2\n", *[f"2024-01-01 0{h}:00:00,{k + h}\n" for h in range(5)]]), f"unit_{k}.csv")
    every = str(tmp_path / "unit_*.csv")
    with pytest.raises(ValueError, match="several files"):
        readings.read_csv(spark, every)
    df = readings.read_csv(spark, every, asset_from=r"unit_(\d+)\.csv")
    assert sorted((r.asset_id, r.H2) for r in df.collect()) == [(k, k + h) for k in (3, 7) for h in range(5)]
    assert {r.asset_id for r in readings.read_csv(spark, every, asset_id=4).collect()} == {4}
    assert {r.asset_id for r in readings.read_csv(spark, str(tmp_path / "unit_3.csv")).collect()} == {0}
