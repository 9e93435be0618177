"""The feature table kept up to date: new rows are computed from one stored row per asset.

``append`` takes the next stretch of the clean series and writes its feature rows as a new part. It reads the newest
state only, never older features or series.  The state has one row per asset: its last rows, as many as the longest window
needs, and the running sums of the rows before them.  The result of all appends equals
``build_features(series, fill=False)`` of the whole series, however it was cut.

A part is written before its state, and numbered by the newest state: a job that died in between is repeated with
the same number and overwrites its own part.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmwatch.config import CHANGE_PERIODS, DROPPED_COLUMNS, HOUR, KEY, RATED_KVA, ROLLING_WINDOWS, TIE, TIME
from ohmwatch.functions.axis import POS, position
from ohmwatch.functions.guards import add
from ohmwatch.plans.features import build_features, cumulative_values

PART = "part"


def newest(spark: SparkSession, folder: str) -> int | None:
    """Number of the newest state, None before the first append."""
    try:
        return spark.read.parquet(f"{folder}/state").agg(F.max(PART)).first()[0]
    except AnalysisException:
        return None


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """All feature rows that were appended."""
    return spark.read.option("mergeSchema", "false").parquet(f"{folder}/features").drop(PART)


def append(
    spark: SparkSession,
    folder: str,
    series: DataFrame,
    windows: tuple[int, ...] = ROLLING_WINDOWS,
    periods: tuple[int, ...] = CHANGE_PERIODS,
    rated_kva: float = RATED_KVA,
    step: int = HOUR,
) -> DataFrame:
    """Write the feature rows of ``series``, which goes on where the stored one ends, and return them.

    ``series`` is regular per asset (see ``prepare``); assets may be new, or have no rows this time.  Rows
    that do not follow an asset's last row at once are refused.
    """
    reach = max(max(windows) - 1, max(periods))
    base = series.drop(TIE, *DROPPED_COLUMNS)
    sums = cumulative_values(base, rated_kva)
    before = [f"__before_{n}" for n in sums]
    number = newest(spark, folder)
    if number is None:
        rows, known, part = base.withColumn("__fresh", F.lit(True)), None, 0
    else:
        state, part = spark.read.parquet(f"{folder}/state/{PART}={number}"), number + 1
        known = state.select(KEY, "last", *before)
        starts = base.groupBy(KEY).agg(F.expr(f"min({position(step)}) AS start"))
        gaps = starts.join(known, KEY).filter("start <> last + 1")
        if not gaps.isEmpty():
            raise ValueError(f"the series of asset {gaps.first()[KEY]} does not go on where the stored one ends")
        tail = state.select(KEY, F.inline("tail")).withColumn("__fresh", F.lit(False))
        rows = tail.unionByName(base.withColumn("__fresh", F.lit(True)))

    marked = rows.withColumnRenamed("__fresh", "fresh_row")
    built = build_features(marked, windows, periods, rated_kva, fill=False, step=step).filter("fresh_row").drop("fresh_row")
    if known is not None:
        built = built.join(known.drop("last"), KEY, "left")
        built = add(built, {n: f"{n} + coalesce(__before_{n}, 0D)" for n in sums}).drop(*before)
    path = f"{folder}/features/{PART}={part}"
    built.select(KEY, TIME, *[c for c in built.columns if c not in (KEY, TIME)]).write.mode("overwrite").parquet(path)

    placed = add(rows, {POS: position(step)})
    ends = placed.groupBy(KEY).agg(F.max(POS).alias("last"))
    placed = placed.join(ends, KEY)
    recent = f"{POS} > last - {reach}"
    columns = ", ".join(f"`{c}`" for c in base.columns if c != KEY)
    state = placed.groupBy(KEY).agg(
        F.first("last").alias("last"),
        F.expr(f"array_sort(collect_list(struct({columns})) FILTER (WHERE {recent}), (a, b) -> CASE WHEN a.{TIME} < b.{TIME} THEN -1 ELSE 1 END) AS tail"),
        *[F.expr(f"coalesce(sum(CASE WHEN NOT ({recent}) THEN {v} END), 0D) AS __before_{n}") for n, v in sums.items()],
    )
    if known is not None:
        earlier = known.select(KEY, *[F.col(b).alias(f"{b}_") for b in before])
        state = state.join(earlier, KEY, "left")
        state = add(state, {b: f"{b} + coalesce({b}_, 0D)" for b in before}).drop(*[f"{b}_" for b in before])
    state.select(KEY, "last", "tail", *before).write.mode("overwrite").parquet(f"{folder}/state/{PART}={part}")
    return spark.read.parquet(path)
