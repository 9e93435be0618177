"""Fits: schema, ranges, repeatability, persistence; never exact values."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ohmwatch.learning import datasets as ds
from ohmwatch.learning import evaluation as ev
from ohmwatch.learning import models as m
from ohmwatch.plans import scoring, training
from ohmwatch.session import run_dir
from ohmwatch.sources import fixtures, readings, store

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    n = 240
    y = rng.integers(0, 2, n)
    frame = pd.DataFrame({
        "asset_id": 0,
        "ts": [START + dt.timedelta(hours=i) for i in range(n)],
        "a": y * 2.0 + rng.normal(0, 0.5, n),
        "b": rng.normal(0, 1, n),
        "failure_label": y,
    })
    return spark.createDataFrame(frame).cache()


SMALL = m.TrainingSettings(n_splits=2, parallel_fits=2).smaller(2, 2)


def test_classifiers_learn_and_repeat(separable):
    got = m.train_classifiers(separable, ["a", "b", "failure_label"], SMALL)
    assert got.inputs == ["a", "b"]
    metrics = {r.model: r for r in got.metrics.collect()}
    assert set(metrics) == {"rf", "gb", "xgb"}
    assert all(r.auc_cv > 0.8 and 0 <= r.f1_cv <= 1 for r in metrics.values())
    assert sum(r.n for r in got.matrix.collect()) == 80
    assert got.report.count() == 5
    scored = scoring.score_health(separable.drop("b"), got.models["xgb"])
    rows = scored.collect()
    assert all(0 <= r.failure_proba <= 1 and r.health_score == pytest.approx(100 * (1 - r.failure_proba)) for r in rows)
    assert set(scored.columns) - set(separable.columns) == {"b", "failure_proba", "health_score", "risk_level"} - {"b"}
    again = m.fit(separable, ["a", "b"], "failure_label", SMALL.classifiers["xgb"])
    one = [r.failure_proba for r in m.probability(got.models["xgb"], separable, ["a", "b"]).orderBy("ts").collect()]
    two = [r.failure_proba for r in m.probability(again, separable, ["a", "b"]).orderBy("ts").collect()]
    assert one == pytest.approx(two)


def test_label_column_is_required(separable):
    with pytest.raises(ValueError, match="failure_label"):
        m.train_classifiers(separable.drop("failure_label"), ["a"], SMALL)


def test_forecast_scores_every_row_and_the_real_future(spark):
    n = 120
    frame = pd.DataFrame({
        "asset_id": 0,
        "ts": [START + dt.timedelta(hours=i) for i in range(n)],
        "H2": np.arange(n, dtype=float),
        "CO": 5.0,
    })
    df = spark.createDataFrame(frame)
    data = ds.forecast_dataset(df, "H2", 6, ["H2", "CO", "absent"], 3)
    assert data.columns == ["asset_id", "ts", "CO", "H2_lag1", "H2_lag2", "H2_lag3", "future_target"]
    assert data.count() == n - 6 - 3
    model = m.fit(data, data.columns[2:-1], ds.FUTURE, SMALL.forecaster)
    got = scoring.score_forecast(df, model, "H2", 6, 3).orderBy("ts").collect()
    assert len(got) == n
    assert [r.forecast is None for r in got] == [True] * 3 + [False] * (n - 3)
    assert all(r.target_ts - r.ts == dt.timedelta(hours=6) for r in got)
    assert got[-1].target_ts > frame.ts.max()
    view = scoring.parameter_view(df, scoring.score_forecast(df, model, "H2", 6, 3), "H2", 150.0)
    assert view.count() == n + 6
    assert not ds.enough_rows(data.limit(19), 2) and ds.enough_rows(data, 2)


def test_scaling(series):
    df = series({"x": [1.0, 2.0, 3.0, None], "k": [7.0] * 4})
    out = ds.standardise(df, ds.scaling_facts(df, ["x", "k"])).orderBy("ts").collect()
    s = np.std([1, 2, 3])
    assert [r.x for r in out[:3]] == pytest.approx([-1 / s, 0, 1 / s]) and out[3].x is None
    assert [r.k for r in out] == [0.0] * 4


def test_training_job_store_and_file_scoring(spark, sf, tmp_path):
    raw = fixtures.readings(spark, sf).filter("asset_id < 2")
    folder = run_dir(spark, "models")
    settings = m.TrainingSettings(n_splits=2, targets=("H2",), horizons={"1d": 24}, parallel_fits=2).smaller(1, 1)
    settings.classifiers = {"xgb": settings.classifiers["xgb"]}
    tables = training.run_training(raw, folder, settings, 6, 20.0, windows=(24,), periods=(1, 24))
    assert set(tables) == {"forecast_metrics", "classifier_metrics", "classifier_report", "confusion_matrix"}
    assert tables["forecast_metrics"].first().cv_rmse_mean > 0
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, folder, "classifier_none")
    models = store.load_models(spark, folder)
    assert list(models) == ["classifier_xgb"]  # the 1d forecast is not a default horizon
    path = str(tmp_path / "in")
    readings.write_csv(raw, path)
    out = str(tmp_path / "out")
    result = scoring.score_file(spark, path, models["classifier_xgb"], out)
    hours = result["predictions"].count()
    assert spark.read.csv(out, header=True).count() == hours
    assert {r.asset_id for r in result["kpis"].collect()} == {0, 1}
    report = scoring.full_report(scoring.with_health(fixtures.scored(raw))).collect()
    assert all(len(r.active_alerts) <= 8 and r.n_samples > 100 for r in report)


def test_a_forest_of_one_class_gives_probability_zero(separable):
    calm = separable.withColumn("failure_label", F.lit(0))
    model = m.fit(calm, ["a", "b"], "failure_label", SMALL.classifiers["rf"])
    tested = m._tested(model, separable)
    assert {(r.y_pred, r.failure_proba) for r in tested.collect()} == {(0, 0.0)}
    got = ev.f1_and_auc(tested).first()
    assert (got.f1, got.auc) == (0.0, 0.5)
    assert ev.f1_and_auc(m._tested(model, calm)).first().auc is None
    assert {r.failure_proba for r in m.probability(model, calm.drop("b"), ["a", "b"]).collect()} == {0.0}


def test_training_with_one_class_keeps_a_row_per_classifier(spark, separable):
    calm = separable.withColumn("failure_label", F.lit(0))
    got = m.train_classifiers(calm, ["a", "b", "failure_label"], SMALL)
    assert set(got.models) == {"rf", "gb", "xgb"}
    folder = run_dir(spark, "metrics")
    for name, table in (("classifier_metrics", got.metrics), ("classifier_report", got.report), ("confusion_matrix", got.matrix)):
        store.save_metrics(table, folder, name)
    back = store.load_metrics(spark, folder)
    assert dict(back["classifier_metrics"].dtypes) == {"model": "string", "f1_cv": "double", "auc_cv": "double"}
    assert {tuple(r) for r in back["classifier_metrics"].select("model", "f1_cv", "auc_cv").collect()} == {(n, None, None) for n in ("rf", "gb", "xgb")}
    assert back["classifier_report"].columns == ["class", "f1", "precision", "recall", "support"] and back["classifier_report"].count() == 0
    assert back["confusion_matrix"].count() == 4
