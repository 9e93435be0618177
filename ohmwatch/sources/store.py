"""Models and their metrics, by name, below one folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohmwatch.config import FORECAST_HORIZONS, FORECAST_TARGETS
from ohmwatch.functions.guards import rounded
from ohmwatch.learning.newton import Ensemble
from ohmwatch.sources.readings import _exists

#: Metrics tables and their columns, in the order of a JSON scan.
METRIC_TABLES = {
    "forecast_metrics": {"cv_mae_mean": "double", "cv_rmse_mean": "double", "cv_rmse_std": "double", "horizon": "string", "n_samples": "bigint", "target": "string"},
    "classifier_metrics": {"auc_cv": "double", "f1_cv": "double", "model": "string"},
    "classifier_report": {"class": "string", "f1": "double", "precision": "double", "recall": "double", "support": "bigint"},
    "confusion_matrix": {"actual": "bigint", "n": "bigint", "predicted": "bigint"},
}
SERVED_MODEL = "classifier_xgb"


def forecast_name(target: str, horizon: str) -> str:
    return f"forecast_{target}_{horizon}"


def save_model(model: PipelineModel | Ensemble, folder: str, name: str) -> str:
    path = f"{folder}/{name}"
    if isinstance(model, Ensemble):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, folder: str, name: str) -> PipelineModel | Ensemble:
    path = f"{folder}/{name}"
    if not _exists(spark, path):
        raise FileNotFoundError(f"model '{name}' not found in {folder}; train first")
    return Ensemble.load(spark, path) if _exists(spark, f"{path}/trees") else PipelineModel.load(path)


def load_models(spark: SparkSession, folder: str) -> dict[str, PipelineModel | Ensemble]:
    """The served classifier (required) and every forecast model that is there."""
    models = {SERVED_MODEL: load_model(spark, folder, SERVED_MODEL)}
    for target in FORECAST_TARGETS:
        for horizon in FORECAST_HORIZONS:
            name = forecast_name(target, horizon)
            if _exists(spark, f"{folder}/{name}"):
                models[name] = load_model(spark, folder, name)
    return models


def save_metrics(df: DataFrame, folder: str, name: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")


def load_metrics(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every metrics table that exists; absent ones are skipped.

    A table without rows or with a column of missing figures only has its columns and types as well, which a JSON scan cannot see.
    """
    found = {}
    for name, kinds in METRIC_TABLES.items():
        try:
            table = spark.read.json(f"{folder}/{name}")
            if set(table.columns) <= set(kinds):
                table = table.select(*[(F.col(c) if c in table.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
            found[name] = table
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return found


# Nested shape: target -> horizon -> figures.
_FIGURES = T.StructType(
    [
        T.StructField("cv_rmse_mean", T.DoubleType()),
        T.StructField("cv_rmse_std", T.DoubleType()),
        T.StructField("cv_mae_mean", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
    ]
)
_NESTED = T.MapType(T.StringType(), T.MapType(T.StringType(), _FIGURES))


def nested_forecast_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read a nested metrics document (target, then horizon) into a long table."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.from_json("value", _NESTED).alias("m"))
    by_target = parsed.select(F.explode("m").alias("target", "h"))
    return by_target.select("target", F.explode("h").alias("horizon", "f")).select(
        "target", "horizon", "f.*"
    )


def forecast_table(metrics: DataFrame) -> DataFrame:
    """Display table: figures rounded to three digits."""
    return metrics.selectExpr(
        "target",
        "horizon",
        *[f"{rounded(f'coalesce({c}, 0D)', 3)} AS {c}" for c in ("cv_rmse_mean", "cv_rmse_std", "cv_mae_mean")],
        "coalesce(n_samples, 0) AS n_samples",
    )
