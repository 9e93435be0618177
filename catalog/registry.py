"""Registration of queries and helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from catalog.sql import NUDGE
from ohmwatch.plans.prepare import prepare, validate
from ohmwatch.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.readings(spark, sf)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(readings(spark, sf))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    return validate(readings(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    from ohmwatch.functions import diagnostics as d
    from ohmwatch.functions.guards import add

    return add(fixtures.scored(readings(spark, sf)), {"health_score": d.health_score()})


def r6(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Round fractions to six digits, the same way the SQL twins do."""
    chosen = set(columns or df.columns)
    return df.selectExpr(
        *[
            f"round(`{f.name}` + {NUDGE}, 6) + 0 AS `{f.name}`"
            if isinstance(f.dataType, T.DoubleType) and f.name in chosen
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )
