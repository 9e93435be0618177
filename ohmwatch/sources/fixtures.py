"""Readings derived from the ``events`` table, for checks and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmwatch.config import FAULT_PRIORITY, TIE
from ohmwatch.session import prepare as prepare_session

READINGS_SQL = """
SELECT CAST(event_id AS BIGINT) AS reading_id, CAST(user_id % {assets} AS INT) AS asset_id, ts,
  CASE WHEN event_id % 97 = 0 THEN -5E0 ELSE 3E2 + (event_id * 37) % 800 END AS load_kva,
  5E0 + (event_id * 7) % 30 AS ambient_temp,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE 25E0 + (event_id * 7) % 30 + k * 9E-1 END AS top_oil_temp,
  CASE WHEN event_id % 101 = 0 THEN 250E0
       ELSE 45E0 + (event_id * 7) % 30 + k * 9E-1 + (event_id % 23) END AS hot_spot_temp,
  value * 4E0 AS H2, 15E1 + k * 5E0 AS CO,
  (event_id * 13) % 70 + value / 1E1 AS C2H4, 2E1 + (event_id * 29) % 130 AS CH4,
  5E0 + (event_id * 11) % 35 AS moisture_ppm, 1E0 + (k % 50) / 1E1 AS vibration_mms,
  CASE event_type WHEN 'error' THEN 'overheating' WHEN 'signup' THEN 'moisture_fault'
                  WHEN 'purchase' THEN 'partial_discharge' ELSE 'normal' END AS fault_type
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e
"""


def readings(spark: SparkSession, sf_dir: str, assets: int = 5) -> DataFrame:
    prepare_session(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(READINGS_SQL.format(assets=assets, events="{events}"), events=events)


#: The events as hourly readings without pauses: every event is one hour of one of two assets.
LONG_EVENTS = "(SELECT * EXCEPT (user_id, ts), event_id % 2 AS user_id, TIMESTAMP_NTZ '2022-01-01' + make_dt_interval(0, CAST(event_id DIV 2 AS INT)) AS ts FROM {events})"


def long_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of hours (n / 2 per asset), for what needs longer series than the month of the events."""
    prepare_session(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(READINGS_SQL.format(assets=2, events=LONG_EVENTS), events=events)


def with_copies(df: DataFrame) -> DataFrame:
    """Every 50th reading a second time, with another id and another H2 value."""
    copies = df.filter(F.col(TIE) % 50 == 0).withColumns(
        {TIE: F.col(TIE) + 1_000_000, "H2": F.col("H2") + 1}
    )
    return df.unionByName(copies)


def fault_intervals(df: DataFrame) -> DataFrame:
    faults = df.filter((F.col(TIE) % 400 == 0) & F.col("fault_type").isin(*FAULT_PRIORITY))
    return faults.select(
        "asset_id",
        "fault_type",
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("end_ts"),
    )


def scored(df: DataFrame) -> DataFrame:
    """A score and labels fixed by the reading id, independent of any model."""
    probability = ((F.col(TIE) * 7919) % 1001) / F.lit(1e3)
    noise = ((F.col(TIE) * 31) % 100) / F.lit(2e2)
    return df.withColumns(
        {
            "failure_proba": probability,
            "y_true": (probability + noise > 0.75).cast("int"),
            "y_pred": (probability > 0.5).cast("int"),
        }
    )
