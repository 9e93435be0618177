"""Validation and cleaning of raw readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohmwatch.config import BLOCK_ROWS, BOUNDS, HOUR, KEY, NO_FAULT, REQUIRED, TIE, TIME
from ohmwatch.functions.axis import (
    BEFORE,
    BLOCK,
    POS,
    TO_DATE,
    Step,
    apart,
    backward,
    block_of,
    check_step,
    forward,
    over,
    position,
    stamp,
    with_blocks,
)
from ohmwatch.functions.guards import num, numeric_columns, other_columns, replace
from ohmwatch.operators.blocks import row_index

IDS = (KEY, TIME, TIE)


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def _outside(column: str, low: float, high: float) -> str:
    return f"(`{column}` < {num(low)} OR `{column}` > {num(high)})"


def bound_violations(df: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """Out-of-range cells per column, only columns that have some.  One scan."""
    present = {c: b for c, b in bounds.items() if c in df.columns}
    counted = df.agg(
        *[F.expr(f"count_if({_outside(c, *b)}) AS `{c}`") for c, b in present.items()]
    )
    return counted.unpivot([], list(present), "parameter", "n_out").filter("n_out > 0")


def mask_bounds(df: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """Replace physically impossible values by missing."""
    return replace(
        df,
        {
            c: f"CASE WHEN NOT {_outside(c, *bounds[c])} THEN `{c}` END"
            for c in df.columns
            if c in bounds
        },
    )


def sort_readings(df: DataFrame) -> DataFrame:
    return df.orderBy(*[c for c in IDS if c in df.columns])


def keep_first(df: DataFrame) -> DataFrame:
    """One reading per (asset, time stamp): the one with the lowest reading id.

    The rank filter is applied before the shuffle too (window group limit), so
    a large group of copies costs one row per map task.
    """
    ranked = df.selectExpr("*", f"row_number() {over((KEY, TIME), TIE)} AS __rank")
    return ranked.filter("__rank = 1").drop("__rank")


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, non-numeric) measurement columns."""
    return numeric_columns(df, IDS), other_columns(df, IDS)


def _mean(column: str, fraction: bool) -> str:
    """Mean of a bucket; that of fractions does not depend on the order in which rows and partial sums meet.

    A fraction is cut into a multiple of 1/1024, whose sums have no rounding, and a remainder, whose sums round far
    below the last digit of the mean.  A plain sum of 81.2, 65.7, 44.8 and 128.3 is above 320 in some orders only.
    """
    if not fraction:
        return f"avg(`{column}`)"
    value = f"CAST(`{column}` AS DOUBLE)"
    small, coarse = f"abs({value}) < 1e9D", f"rint({value} * 1024D) / 1024D"
    parts = f"CASE WHEN {small} THEN {coarse} ELSE {value} END", f"CASE WHEN {small} THEN {value} - {coarse} ELSE 0D END"
    return f"(sum({parts[0]}) + sum({parts[1]})) / nullif(count(`{column}`), 0)"


def resample(
    df: DataFrame,
    step: Step = HOUR,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
) -> DataFrame:
    """Mean of numeric and last non-missing value of other columns per time bucket.

    Partial aggregation runs before the shuffle on (asset, bucket).
    """
    check_step(step)
    found_numeric, found_other = split_columns(df)
    numeric = found_numeric if numeric is None else numeric
    categorical = found_other if categorical is None else categorical
    order = f"struct({', '.join(c for c in (TIME, TIE) if c in df.columns)})"
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    grouped = df.groupBy(KEY, F.expr(position(step)).alias(POS)).agg(
        *[F.expr(f"{_mean(c, c in fractions)} AS `{c}`") for c in numeric],
        *[
            F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN {order} END) AS `{c}`")
            for c in categorical
        ],
    )
    return grouped.selectExpr(
        KEY, f"{stamp(POS, step, df)} AS {TIME}", *[f"`{c}`" for c in [*numeric, *categorical]]
    )


def time_grid(df: DataFrame, step: Step = HOUR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every (asset, bucket) between the first and the last reading of the asset.

    Bounds come from a scan of two columns; the span is cut into blocks, the
    blocks are spread over all tasks, and each task lists its own buckets.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.groupBy(KEY).agg(
        F.expr(f"min({position(step)}) AS __lo"), F.expr(f"max({position(step)}) AS __hi")
    )
    first, last = block_of("__lo", block_rows), block_of("__hi", block_rows)
    blocks = bounds.selectExpr(
        KEY, "__lo", "__hi", f"explode(sequence({first}, {last})) AS {BLOCK}"
    ).repartition(partitions, KEY, BLOCK)
    start = f"greatest(__lo, {BLOCK} * {block_rows})"
    end = f"least(__hi, ({BLOCK} + 1) * {block_rows} - 1)"
    points = blocks.selectExpr(KEY, f"explode(sequence({start}, {end})) AS {POS}")
    return points.selectExpr(KEY, f"{stamp(POS, step, df)} AS {TIME}")


def on_grid(
    resampled: DataFrame, readings: DataFrame, step: Step = HOUR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Regular series: empty buckets become rows of missing values."""
    return time_grid(readings, step, block_rows).join(resampled, [KEY, TIME], "left")


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two results side by side on (asset, time), keeping rows of either."""
    return left.join(right, [KEY, TIME], "full")


def _with_neighbours(
    df: DataFrame, columns: list[str], step: Step, block_rows: int
) -> DataFrame:
    """Add ``__p_c`` / ``__n_c``: nearest non-missing value at or before / after a row,
    and ``__pp_c`` / ``__np_c``, their positions, to a series on the regular grid.

    Inside a block two running windows find them; beyond its borders the last
    and first known values of the other blocks do, from one summary row per block.
    """
    # The time stamp is left out and rebuilt from the position: the summary then
    # reads the very same shuffle as the windows do.
    placed = with_blocks(df, step, block_rows).drop(TIME).repartition(KEY, BLOCK)
    known = {c: f"CASE WHEN `{c}` IS NOT NULL THEN {POS} END" for c in columns}
    up, down = forward(TO_DATE), backward(TO_DATE)
    local = placed.selectExpr(
        "*",
        *[f"last(`{c}`, true) {up} AS `__p_{c}`" for c in columns],
        *[f"last({known[c]}, true) {up} AS `__pp_{c}`" for c in columns],
    )
    local = local.selectExpr(
        "*",
        *[f"last(`{c}`, true) {down} AS `__n_{c}`" for c in columns],
        *[f"last({known[c]}, true) {down} AS `__np_{c}`" for c in columns],
    )
    edges = {"__p_": "max_by", "__n_": "min_by", "__pp_": "max", "__np_": "min"}
    summary = placed.groupBy(KEY, BLOCK).agg(
        *[
            F.expr(f"{f}(`{c}`, {known[c]}) AS `{p}{c}`")
            if f.endswith("_by")
            else F.expr(f"{f}({known[c]}) AS `{p}{c}`")
            for c in columns
            for p, f in edges.items()
        ]
    )
    earlier, later = over((KEY,), BLOCK, BEFORE), over((KEY,), f"{BLOCK} DESC", BEFORE)
    carried = summary.selectExpr(
        KEY,
        BLOCK,
        *[
            f"last(`{p}{c}`, true) {earlier if p in ('__p_', '__pp_') else later} AS `__c{p}{c}`"
            for c in columns
            for p in edges
        ],
    )
    return local.join(carried, [KEY, BLOCK]).selectExpr(
        *[f"{stamp(POS, step, df)} AS {TIME}" if c == TIME else f"`{c}`" for c in df.columns],
        POS,
        *[f"coalesce(`{p}{c}`, `__c{p}{c}`) AS `{p}{c}`" for c in columns for p in edges],
    )


def _between(c: str, step: Step) -> str:
    """Straight line in time between the known neighbours of a missing value."""
    passed, whole = apart(f"`__pp_{c}`", POS, step), apart(f"`__pp_{c}`", f"`__np_{c}`", step)
    return f"`__p_{c}` + (`__n_{c}` - `__p_{c}`) * ({passed} / nullif({whole}, 0))"


def _fill(df: DataFrame, rules: dict[str, str], step: Step, block_rows: int) -> DataFrame:
    near = _with_neighbours(df, list(rules), step, block_rows)
    return replace(near, rules).select(*df.columns)


def interpolate(
    df: DataFrame, columns: list[str], step: Step = HOUR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Interior gaps linearly in time, trailing gaps by the last value, leading stay."""
    rules = {
        c: f"CASE WHEN `{c}` IS NOT NULL THEN CAST(`{c}` AS DOUBLE) "
        f"WHEN `__n_{c}` IS NOT NULL THEN {_between(c, step)} ELSE `__p_{c}` END"
        for c in columns
    }
    return _fill(df, rules, step, block_rows)


def forward_fill(
    df: DataFrame, columns: list[str], step: Step = HOUR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    return _fill(df, {c: f"`__p_{c}`" for c in columns}, step, block_rows)


def backward_fill(
    df: DataFrame, columns: list[str], step: Step = HOUR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    return _fill(df, {c: f"`__n_{c}`" for c in columns}, step, block_rows)


def fill_series(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    step: Step = HOUR,
    block_rows: int = BLOCK_ROWS,
    constant: str = NO_FAULT,
) -> DataFrame:
    """All gap rules at once: interpolate numbers, then carry forward and back.

    A single shuffle of the series serves every column and rule.
    """
    rules = {
        c: f"coalesce(CAST(`{c}` AS DOUBLE), {_between(c, step)}, `__p_{c}`, `__n_{c}`)" for c in numeric
    }
    rules |= {c: f"coalesce(`__p_{c}`, `__n_{c}`, '{constant}')" for c in categorical}
    return _fill(df, rules, step, block_rows)


def constant_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def missing_cells(df: DataFrame) -> DataFrame:
    """Number of missing cells in the whole table."""
    per_row = " + ".join(f"CAST(`{c}` IS NULL AS BIGINT)" for c in df.columns)
    return df.agg(F.expr(f"coalesce(sum({per_row}), 0) AS n_missing"))


def chronological_split(
    df: DataFrame, test_ratio: float = 0.2, step: Step = HOUR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``part``: the first share of each asset's rows is 'train', the rest 'test'."""
    indexed = row_index(df, step=step, block_rows=block_rows, dense=TIE in df.columns)
    cut = f"floor(__n * {num(1 - test_ratio)})"
    return indexed.selectExpr(
        *df.columns, f"CASE WHEN __rn <= {cut} THEN 'train' ELSE 'test' END AS part"
    )


def train_test(df: DataFrame, test_ratio: float = 0.2, **kw) -> tuple[DataFrame, DataFrame]:
    marked = chronological_split(df, test_ratio, **kw)
    return tuple(marked.filter(f"part = '{p}'").drop("part") for p in ("train", "test"))
