"""Apply fitted models: health, forecasts, reports, and the file-scoring job."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmwatch.config import HOUR, KEY, N_LAGS, TIME
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import add
from ohmwatch.learning.datasets import scoring_dataset
from ohmwatch.learning.models import model_inputs, probability
from ohmwatch.learning.newton import Ensemble
from ohmwatch.operators import tables
from ohmwatch.operators.blocks import attach
from ohmwatch.plans.features import build_features
from ohmwatch.plans.prepare import clean, validate
from ohmwatch.session import run_dir
from ohmwatch.sources.readings import read_csv, write_predictions

ML_COLUMNS = ("raw", "features", "rawPrediction", "probability", "prediction")


def with_health(df: DataFrame) -> DataFrame:
    """Health score and risk level from a failure probability."""
    return add(add(df, {"health_score": d.health_score()}), {"risk_level": d.risk_level()})


def score_health(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Failure probability, health score and risk level of every row."""
    scored = probability(model, df, model_inputs(model)).drop(*ML_COLUMNS)
    return with_health(scored)


def score_forecast(
    features: DataFrame,
    model: PipelineModel,
    target: str,
    horizon: int,
    n_lags: int = N_LAGS,
    step: int = HOUR,
) -> DataFrame:
    """Forecast per row with the time it is meant for; missing where inputs are.

    The future need not be known.  The keys travel through the model, so every
    row of the input is in the result without a join on positions.
    """
    wanted = model_inputs(model)
    columns = [c for c in wanted if c in features.columns]
    data = scoring_dataset(features, target, columns, n_lags, step)
    absent = [c for c in wanted if c not in data.columns]
    if absent:
        raise ValueError(f"model inputs missing: {absent}")
    complete = " AND ".join(f"`{c}` IS NOT NULL" for c in wanted)
    ready = data.selectExpr(
        KEY, TIME, f"({complete}) AS __complete", *[f"coalesce(`{c}`, 0) AS `{c}`" for c in wanted]
    )
    return model.transform(ready).selectExpr(
        KEY,
        TIME,
        f"{TIME} + make_dt_interval(0, 0, 0, {horizon * step}) AS target_ts",
        f"'{target}' AS target",
        "CASE WHEN __complete THEN prediction END AS forecast",
    )


def realign(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions back on all rows, missing where there is none."""
    return rows.join(predictions, [KEY, TIME], "left")


def parameter_view(
    rows: DataFrame, forecasts: DataFrame, parameter: str, limit: float | None
) -> DataFrame:
    """Measured value, the forecast made for this time, and the alarm limit."""
    meant = forecasts.selectExpr(KEY, f"target_ts AS {TIME}", "forecast")
    shown = rows.selectExpr(KEY, TIME, f"`{parameter}` AS measured")
    return shown.join(meant, [KEY, TIME], "full").withColumn(
        "threshold", F.lit(limit).cast("double")
    )


def full_report(scored: DataFrame) -> DataFrame:
    """Newest state per asset: health, risk, active alerts, number of rows."""
    newest = tables.with_alerts(tables.latest(scored))
    counts = scored.groupBy(KEY).agg(F.count("*").alias("n_samples"))
    return attach(newest, counts).selectExpr(
        KEY,
        f"CAST({TIME} AS STRING) AS timestamp",
        "health_score",
        "failure_proba",
        "risk_level",
        "transform(active_alerts, a -> named_struct('parameter', a.parameter, 'value', a.value, "
        "'threshold', a.threshold, 'severity', a.severity)) AS active_alerts",
        "n_samples",
    )


def score_file(
    spark: SparkSession, path: str, model: PipelineModel | Ensemble, out: str | None = None, strict: bool = False, **asset
) -> dict[str, DataFrame]:
    """CSV in, predictions out: clean, features, health, key figures, alerts.

    ``asset_from`` or ``asset_id`` name the asset of files without such a column (see ``read_csv``).  The cleaned series
    and the predictions (five columns) are written once; everything after them reads these tables.
    """
    raw = read_csv(spark, path, **asset)
    store = run_dir(spark, "file")
    clean(validate(raw, strict)).write.parquet(f"{store}/series")
    series = spark.read.parquet(f"{store}/series")
    scored = score_health(build_features(series), model)
    scored.select(KEY, TIME, "health_score", "failure_proba", "risk_level").write.parquet(f"{store}/predictions")
    scored = spark.read.parquet(f"{store}/predictions")
    if out:
        write_predictions(scored, out)
    return {
        "predictions": scored,
        "kpis": tables.file_kpis(scored),
        "alerts": tables.alerts(tables.latest(series)),
    }
