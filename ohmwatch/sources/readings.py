"""Scans and sinks of readings and predictions."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohmwatch.config import KEY, REQUIRED, TIE, TIME, TIME_NAMES
from ohmwatch.functions.guards import nan_to_null

# Column order of a stored reading.
SCHEMA = T.StructType(
    [
        T.StructField(TIME, T.TimestampType()),
        T.StructField(KEY, T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in REQUIRED],
        T.StructField("fault_type", T.StringType()),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def _with_asset(raw: DataFrame, asset_id: int | None, asset_from: str | None) -> DataFrame:
    """The asset of files that have no column for it.

    ``asset_from`` is a pattern whose first group is the asset's number in the file's path;
    a file that it does not match is an error when it is read.  Several files without
    any name for their assets are refused, for their readings would be taken for copies.
    """
    if KEY in raw.columns:
        return raw
    if asset_from is not None:
        return raw.withColumn(KEY, F.regexp_extract("_metadata.file_path", asset_from, 1).cast("int"))
    if asset_id is None and len(raw.inputFiles()) > 1:
        raise ValueError(f"several files and no column {KEY}: give asset_from or asset_id")
    return raw


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    asset_id: int | None = None,
    asset_from: str | None = None,
) -> DataFrame:
    """Readings from CSV files with a header; the time axis becomes ``ts``.

    Give a schema for large inputs: inferring one reads the data twice.  Files without a
    column ``asset_id`` take it from their path (``asset_from``) or are all of ``asset_id``.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"no such file: {path}")
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    try:
        raw = reader.csv(path)
        if not raw.columns:
            raise ValueError(f"cannot read {path} as CSV: no columns")
        return as_readings(_with_asset(raw, asset_id, asset_from), asset_id or 0)
    except PySparkException as error:
        raise ValueError(f"cannot read {path} as CSV: {error}") from error


def read_parquet(
    spark: SparkSession, path: str, asset_id: int | None = None, asset_from: str | None = None
) -> DataFrame:
    try:
        return as_readings(_with_asset(spark.read.parquet(path), asset_id, asset_from), asset_id or 0)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no such file: {path}") from error
        raise


def as_readings(raw: DataFrame, asset_id: int = 0) -> DataFrame:
    """Name the time axis, and add an asset id and a row id where there is none."""
    timed = with_time_axis(nan_to_null(raw))
    if KEY not in timed.columns:
        timed = timed.withColumn(KEY, F.lit(asset_id))
    if TIE not in timed.columns:
        # File and row order of the scan: only used to keep the first of two copies.
        timed = timed.withColumn(TIE, F.monotonically_increasing_id())
    return timed


def _parses(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def time_column(df: DataFrame) -> str:
    """The column holding time: a known name that parses wholly, else the first column.

    All candidates are tried in one pass over the data.  Plain numbers are
    refused.
    """
    named = [f for f in df.schema.fields if f.name.lower() in TIME_NAMES and f.name != TIME]
    if TIME in df.columns:
        named = [df.schema[TIME], *named]
    order = list(dict.fromkeys([*(f.name for f in named), *df.columns[:1]]))
    tried = [c for c in order if _parses(df.schema[c])]
    if tried and not isinstance(df.schema[tried[0]].dataType, T.StringType):
        return tried[0]  # typed already, nothing to try
    if tried:
        bad = df.agg(
            *[
                F.expr(f"count_if(`{c}` IS NOT NULL AND try_to_timestamp(CAST(`{c}` AS STRING)) IS NULL)").alias(c)
                for c in tried
            ]
        ).first()
        for c in tried:
            if bad[c] == 0:
                return c
    raise ValueError(f"no time column among {df.columns}; expected one named like {TIME_NAMES}")


def with_time_axis(df: DataFrame) -> DataFrame:
    name = time_column(df)
    typed = df.schema[name].dataType
    if isinstance(typed, T.StringType):
        df = df.withColumn(name, F.try_to_timestamp(F.col(name)))
    elif isinstance(typed, T.DateType):
        df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df.withColumnRenamed(name, TIME)


# Whole microseconds; the CSV default stops at milliseconds.
_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_OPTIONS = {"header": True, "timestampFormat": _STAMP, "timestampNTZFormat": _STAMP}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Readings as CSV with a header, time first; one file per task."""
    columns = [TIME, *[c for c in df.columns if c not in (TIME, TIE)]]
    df.select(*columns).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The default store: one folder per asset, so asset filters prune files.

    Rows are spread by (asset, day) first, so a large asset is written by many
    tasks and a task holds few open files.
    """
    day = F.to_date(TIME)
    df.repartition(KEY, day).write.mode(mode).partitionBy(KEY).parquet(path)


PREDICTION_COLUMNS = (KEY, TIME, "health_score", "failure_proba", "risk_level")


def write_predictions(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    scored.select(*PREDICTION_COLUMNS).write.mode(mode).options(**CSV_OPTIONS).csv(path)
