"""Row-to-row operators: differences, lags, labels, smoothing, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.config import (
    BLOCK_ROWS,
    CHANGE_COLUMNS,
    CHANGE_PERIODS,
    HOUR,
    KEY,
    LABEL_LEVEL,
    LABEL_WINDOW,
    N_LAGS,
    NO_FAULT,
    RATED_KVA,
    TIE,
    TIME,
)
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.axis import (
    BLOCK,
    POS,
    TO_DATE,
    forward,
    over,
    seconds,
    with_blocks,
    without_blocks,
)
from ohmwatch.functions.guards import add, aliased, num
from ohmwatch.operators.blocks import density_blocks, home_rows, running_totals, with_halo
from ohmwatch.operators.rolling import column_name, rolling_columns

# Rows after which 0.85^k is below the resolution of a double.
SMOOTHING = 0.85
SMOOTHING_REACH = 256
SMOOTHING_BLOCK = 2048


def change_columns(
    columns: list[str] = list(CHANGE_COLUMNS), periods: tuple[int, ...] = CHANGE_PERIODS
) -> dict[str, str]:
    return {
        f"{c}_roc_{p}h": f"`{c}` - lag(`{c}`, {p}) {forward()}" for c in columns for p in periods
    }


def rate_of_change(
    df: DataFrame,
    columns: list[str] | None = None,
    periods: tuple[int, ...] = CHANGE_PERIODS,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Difference to the value ``p`` rows earlier (not divided by the period)."""
    columns = [c for c in (columns or CHANGE_COLUMNS) if c in df.columns]
    haloed = with_halo(df, back=max(periods), step=step, block_rows=block_rows)
    changed = haloed.selectExpr("*", *aliased(change_columns(columns, periods)))
    return without_blocks(home_rows(changed))


def lag_columns(target: str, n_lags: int = N_LAGS) -> dict[str, str]:
    return {f"{target}_lag{k}": f"lag(`{target}`, {k}) {forward()}" for k in range(1, n_lags + 1)}


def lags_and_future(
    df: DataFrame,
    target: str,
    n_lags: int = N_LAGS,
    horizon: int | None = None,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the last ``n_lags`` values of the target and, if asked, its value ahead."""
    haloed = with_halo(df, back=n_lags, ahead=horizon or 0, step=step, block_rows=block_rows)
    columns = lag_columns(target, n_lags)
    if horizon is not None:
        columns["future_target"] = f"lead(`{target}`, {horizon}) {forward()}"
    return without_blocks(home_rows(haloed.selectExpr("*", *aliased(columns))))


def cumulative(
    df: DataFrame,
    values: dict[str, str],
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum per asset; missing where the addend is missing, total carries on."""
    placed = with_blocks(df, step, block_rows)
    summed = running_totals(
        placed, {n: f"coalesce({v}, 0D)" for n, v in values.items()}, (KEY,), BLOCK, POS
    )
    shown = {n: f"CASE WHEN ({v}) IS NOT NULL THEN {n} END" for n, v in values.items()}
    return without_blocks(add(summed, shown))


def failure_label(
    df: DataFrame,
    window: int = LABEL_WINDOW,
    level: float = LABEL_LEVEL,
    health: str = "health_index",
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """1 when the health index falls below ``level`` within the next ``window`` rows.

    The last ``window`` rows have no full outlook and reuse the last computable
    answer, the minimum of the final ``window`` rows; series not longer than the
    window get 0.  A halo on both sides makes each answer local to its block:
    a row without outlook always has the end of its series in its halo.
    """
    haloed = with_halo(df, back=window, ahead=window, step=step, block_rows=block_rows)
    lowest = column_name(health, "min", window)
    seen = rolling_columns(haloed, [health], (window,), ("min",), need=1)
    whole = f"OVER (PARTITION BY {KEY}, {BLOCK})"
    ahead = seen.selectExpr(
        "*",
        f"lead({lowest}, {window}) {forward()} AS __next",
        f"max_by({lowest}, {POS}) {whole} AS __last",
        f"count(*) {whole} AS __rows",
    )
    decisive = f"coalesce(__next, CASE WHEN __rows > {window} THEN __last END)"
    label = f"coalesce(CAST({decisive} < {num(level)} AS INT), 0)"
    return without_blocks(home_rows(add(ahead, {"failure_label": label}))).drop(lowest)


def expected_oil(
    df: DataFrame,
    rated_kva: float = RATED_KVA,
    step: int = HOUR,
    block_rows: int = SMOOTHING_BLOCK,
) -> DataFrame:
    """Expected oil temperature: first-order response to load and ambient air.

    y0 = x0, y = 0.85 y' + 0.15 x is the weighted running sum
    0.15 * sum(0.85^(i-j) x_j).  Weights beyond 256 rows are below the
    resolution of a double, so a halo of that reach gives the exact value;
    factoring out 0.85^i turns the sum into one running window.
    """
    haloed = with_halo(df, back=SMOOTHING_REACH, step=step, block_rows=block_rows)
    staged = haloed.selectExpr(
        "*",
        f"{d.oil_rise(rated_kva)} AS __x",
        f"{POS} - min({POS}) {forward(TO_DATE)} AS __i",
    )
    grow = f"pow({num(1 / SMOOTHING)}, __i)"
    weight = f"if(__i = 0, 1D, {num(1 - SMOOTHING)})"
    summed = f"sum({weight} * {grow} * __x) {forward(TO_DATE)}"
    smoothed = staged.selectExpr("*", f"{summed} / {grow} AS expected_oil_temp")
    return without_blocks(
        home_rows(add(smoothed, {"oil_residual": "top_oil_temp - expected_oil_temp"}))
    )


def fault_episodes(
    df: DataFrame,
    column: str = "fault_type",
    normal: str = NO_FAULT,
    target_rows: int = 200_000,
) -> DataFrame:
    """Maximal runs of one fault kind per asset: kind, first and last time, length.

    Runs are found inside time blocks.  Only the first and the last run of a
    block can continue elsewhere; a running count over one summary row per
    block numbers these chains, and a final aggregation joins their pieces.
    """
    order = ", ".join(c for c in (TIME, TIE) if c in df.columns)
    slim = df.selectExpr(KEY, *order.split(", "), f"coalesce(`{column}`, '{normal}') AS kind")
    placed = density_blocks(slim, target_rows).repartition(KEY, BLOCK)
    spec = over((KEY, BLOCK), order)
    marked = placed.selectExpr(
        "*", f"CAST(NOT (lag(kind) {spec} <=> kind) AS INT) AS __new"
    )
    numbered = marked.selectExpr(
        "*", f"sum(__new) {over((KEY, BLOCK), order, TO_DATE)} AS __run"
    )
    runs = numbered.groupBy(KEY, BLOCK, "__run", "kind").agg(
        F.min(TIME).alias("start_ts"), F.max(TIME).alias("end_ts"), F.count("*").alias("n_rows")
    )

    summary = placed.groupBy(KEY, BLOCK).agg(
        F.expr(f"min_by(kind, struct({order})) AS __first"),
        F.expr(f"max_by(kind, struct({order})) AS __final"),
        F.expr("CAST(min(kind) <> max(kind) AS INT) AS __mixed"),
    )
    by_block = over((KEY,), BLOCK)
    fresh = summary.selectExpr(
        "*", f"CAST(NOT (lag(__final) {by_block} <=> __first) AS INT) AS __fresh"
    )
    chains = fresh.selectExpr(
        KEY, BLOCK, "__mixed", f"sum(__fresh + __mixed) {over((KEY,), BLOCK, TO_DATE)} AS __chain"
    )

    placed_runs = runs.selectExpr(
        "*", f"max(__run) OVER (PARTITION BY {KEY}, {BLOCK}) AS __top"
    ).join(chains, [KEY, BLOCK])
    pieces = placed_runs.filter(f"kind <> '{normal}'").selectExpr(
        KEY,
        "kind",
        # A block's first run belongs to the chain its summary row opened or
        # continued, its last run to the chain it left open; others stand alone.
        "CASE WHEN __run = 1 THEN __chain - __mixed WHEN __run = __top THEN __chain END AS __link",
        f"CASE WHEN __run > 1 AND __run < __top THEN {BLOCK} END AS __alone",
        "CASE WHEN __run > 1 AND __run < __top THEN __run END AS __which",
        "start_ts",
        "end_ts",
        "n_rows",
    )
    merged = pieces.groupBy(KEY, "kind", "__link", "__alone", "__which").agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.sum("n_rows").alias("n_rows"),
    )
    return merged.selectExpr(KEY, f"kind AS `{column}`", "start_ts", "end_ts", "n_rows")
