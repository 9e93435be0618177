"""The per-reading and per-hour rules on a stream of files.

Event time is TIMESTAMP; state is held only up to the watermark.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ohmwatch.config import KEY, NO_FAULT, TIE, TIME
from ohmwatch.functions.guards import numeric_columns
from ohmwatch.operators import tables
from ohmwatch.plans.scoring import score_health

DELAY = "2 hours"


def read_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of parquet files; all new files make one batch unless a number is given."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(stream: DataFrame) -> DataFrame:
    return stream.withColumn(TIME, F.col(TIME).cast("timestamp"))


def hourly_means(stream: DataFrame, columns: list[str] | None = None, delay: str = DELAY) -> DataFrame:
    """Mean per asset and hour; rows later than the watermark are dropped."""
    columns = columns or numeric_columns(stream, (KEY, "reading_id"))
    grouped = (
        event_time(stream)
        .withWatermark(TIME, delay)
        .groupBy(KEY, F.window(TIME, "1 hour").alias("w"))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    return grouped.select(KEY, F.col("w.start").alias(TIME), *columns)


def alert_stream(stream: DataFrame) -> DataFrame:
    """Alerts of every reading; no state."""
    return tables.alerts(event_time(stream))


def first_copies(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """The copy with the lowest reading id of each (asset, time stamp), as ``keep_first`` takes it.

    The state holds one row per time stamp until the watermark passes it; later copies are dropped.
    """
    timed = event_time(stream)
    others = [c for c in timed.columns if c not in (KEY, TIME)]
    least = F.min_by(F.struct(*others), F.col(TIE))
    kept = timed.withWatermark(TIME, delay).groupBy(KEY, TIME).agg(least.alias("copy"))
    return kept.select(*[c if c in (KEY, TIME) else F.col("copy")[c].alias(c) for c in timed.columns])


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Health of rows that already carry their features."""
    return score_health(stream, model)


def fault_sessions(stream: DataFrame, gap: str = "2 hours", delay: str = DELAY) -> DataFrame:
    """Stretches of one fault kind without a pause longer than ``gap``."""
    timed = event_time(stream)
    if timed.isStreaming:
        timed = timed.withWatermark(TIME, delay)
    grouped = (
        timed.filter(F.col("fault_type") != NO_FAULT)
        .groupBy(KEY, "fault_type", F.session_window(TIME, gap).alias("w"))
        .agg(F.count("*").alias("n_rows"))
    )
    return grouped.select(
        KEY, "fault_type", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_rows"
    )


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process all files there are, append to parquet, return the written table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
