"""The training job: readings in, models and metrics out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ohmwatch.config import LABEL_LEVEL, LABEL_WINDOW
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import add
from ohmwatch.learning.models import TrainingSettings, train_classifiers, train_forecasts
from ohmwatch.operators.sequences import failure_label
from ohmwatch.plans.features import build_features, feature_columns
from ohmwatch.plans.prepare import prepare
from ohmwatch.sources import store


def labelled_features(
    series: DataFrame,
    label_window: int = LABEL_WINDOW,
    label_level: float = LABEL_LEVEL,
    **feature_args,
) -> DataFrame:
    """Feature table with health index and look-ahead label, computed after cleaning.

    No back-fill: early rows without a full window stay incomplete and are left
    out of training, so nothing later leaks into them.
    """
    rated = add(series, {"health_index": d.health_index()})
    marked = failure_label(rated, label_window, label_level)
    return build_features(marked, **({"fill": False} | feature_args))


def run_training(
    readings: DataFrame,
    folder: str,
    settings: TrainingSettings | None = None,
    label_window: int = LABEL_WINDOW,
    label_level: float = LABEL_LEVEL,
    **feature_args,
) -> dict[str, DataFrame]:
    """Prepare, build features, fit all models, keep models and metrics in ``folder``.

    The clean series and the feature table are written as parquet: the fits
    read them instead of repeating the preparation, and a lost executor costs
    only its own part.
    """
    spark = readings.sparkSession
    settings = settings or TrainingSettings()
    prepare(readings).write.mode("overwrite").parquet(f"{folder}/series")
    series = spark.read.parquet(f"{folder}/series")
    labelled_features(series, label_window, label_level, **feature_args).write.mode("overwrite").parquet(
        f"{folder}/features"
    )
    features = spark.read.parquet(f"{folder}/features")
    columns = feature_columns(features)

    forecasts, forecast_metrics = train_forecasts(features, columns, settings)
    for (target, horizon), model in forecasts.items():
        store.save_model(model, folder, store.forecast_name(target, horizon))
    if forecast_metrics is not None:
        store.save_metrics(forecast_metrics, folder, "forecast_metrics")

    outcome = train_classifiers(features, columns, settings)
    for name, model in outcome.models.items():
        store.save_model(model, folder, f"classifier_{name}")
    store.save_metrics(outcome.metrics, folder, "classifier_metrics")
    store.save_metrics(outcome.report, folder, "classifier_report")
    store.save_metrics(outcome.matrix, folder, "confusion_matrix")
    return store.load_metrics(spark, folder)
