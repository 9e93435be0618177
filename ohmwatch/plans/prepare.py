"""From raw readings to a clean, regular series per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ohmwatch.config import BLOCK_ROWS, HOUR, TIE
from ohmwatch.functions.axis import Step, fitted
from ohmwatch.functions.guards import nan_to_null
from ohmwatch.operators import cleaning as c


def validate(df: DataFrame, strict: bool = True) -> DataFrame:
    """Check the schema and blank out impossible values."""
    if strict:
        c.require_columns(df)
    return c.mask_bounds(nan_to_null(df))


def clean(df: DataFrame, step: Step = HOUR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """De-duplicate, resample, lay on the regular grid and fill the gaps.

    The step is a number of seconds or ``month``.  Seconds that do not divide a day are counted from the midnight before the
    first reading, for all assets alike (one small job).
    """
    step = fitted(df, step)
    single = c.keep_first(df)
    numeric, categorical = c.split_columns(df)
    buckets = c.resample(single, step, numeric, categorical)
    grid = c.on_grid(buckets, df, step, block_rows)
    return c.fill_series(grid, numeric, categorical, step, block_rows).drop(TIE)


def prepare(
    df: DataFrame, step: Step = HOUR, block_rows: int = BLOCK_ROWS, strict: bool = True
) -> DataFrame:
    return clean(validate(df, strict), step, block_rows)
