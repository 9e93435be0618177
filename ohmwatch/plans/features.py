"""The wide feature table: one shuffle of the series, then row-local work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.config import (
    BLOCK_ROWS,
    CHANGE_COLUMNS,
    CHANGE_PERIODS,
    DROPPED_COLUMNS,
    GASES,
    HOUR,
    KEY,
    RATED_KVA,
    ROLLING_COLUMNS,
    ROLLING_WINDOWS,
    TARGET_COLUMNS,
    TIE,
    TIME,
)
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.axis import (
    BEFORE,
    BLOCK,
    POS,
    TO_DATE,
    forward,
    over,
    position,
    with_blocks,
    without_blocks,
)
from ohmwatch.functions.guards import add, aliased, replace
from ohmwatch.operators.blocks import HOME, home_rows, prefix_over_blocks, with_halo
from ohmwatch.operators.rolling import STATS, rolling_columns
from ohmwatch.operators.sequences import change_columns

#: Columns whose rules give a value for missing inputs too.
NEVER_MISSING = ("duval_zone", "duval_zone_code", "rogers_code", "TDCG")


def gas_diagnostics(df: DataFrame) -> DataFrame:
    """Duval shares, zone and code, Rogers ratios and code."""
    shares = add(df, d.duval_percentages() | d.rogers_ratios())
    zoned = add(shares, {"duval_zone": d.duval_zone(), "rogers_code": d.rogers_code()})
    return add(zoned, {"duval_zone_code": d.duval_code()})


def thermal_columns(columns: list[str], rated_kva: float = RATED_KVA) -> dict[str, str]:
    """Load ratio, gradients and ageing rate, as far as the inputs are there."""
    needs = {
        "load_ratio": ({"load_kva"}, d.load_ratio(rated_kva)),
        "temp_gradient": ({"top_oil_temp", "ambient_temp"}, d.TEMP_GRADIENT),
        "hot_spot_gradient": ({"hot_spot_temp", "top_oil_temp"}, d.HOT_SPOT_GRADIENT),
        "aging_factor": ({"hot_spot_temp"}, d.aging_factor()),
    }
    return {n: text for n, (inputs, text) in needs.items() if inputs <= set(columns)}


def thermal_features(df: DataFrame, rated_kva: float = RATED_KVA) -> DataFrame:
    return add(df, thermal_columns(df.columns, rated_kva))


def time_features(df: DataFrame) -> DataFrame:
    return add(df, d.cyclic_time(TIME)) if TIME in df.columns else df


def gas_total_columns(columns: list[str]) -> dict[str, str]:
    present = tuple(g for g in GASES if g in columns)
    out = {"TDCG": d.tdcg(present)} if present else {}
    if {"H2", "CH4"} <= set(present):
        out["H2_CH4_ratio"] = d.ratio("H2", "CH4")
    if {"CO", "H2"} <= set(present):
        out["CO_H2_ratio"] = d.ratio("CO", "H2")
    return out


def gas_totals(df: DataFrame) -> DataFrame:
    return add(df, gas_total_columns(df.columns))


def cumulative_values(df: DataFrame, rated_kva: float) -> dict[str, str]:
    out = {}
    if "load_kva" in df.columns:
        out["cumulative_overload"] = d.overload(rated_kva)
    if "hot_spot_temp" in df.columns:
        out["cumulative_aging"] = d.aging_factor()
    return out


def build_features(
    df: DataFrame,
    windows: tuple[int, ...] = ROLLING_WINDOWS,
    periods: tuple[int, ...] = CHANGE_PERIODS,
    rated_kva: float = RATED_KVA,
    fill: bool = True,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All engineered columns of a regular series; gaps are allowed.

    With ``fill`` a missing cell of any column takes the last known value of its
    asset, and before the first known one that first value, however far away
    it is.  ``fill=False`` leaves such cells missing (no look-ahead).

    The fill reads the shuffle of the series twice, as rows and as one summary row per
    block; the moving values are computed for both.
    """
    base = df.drop(TIE, *DROPPED_COLUMNS)
    rolled = [c for c in ROLLING_COLUMNS if c in base.columns]
    changing = [c for c in CHANGE_COLUMNS if c in base.columns]
    back = max(max(windows) - 1, max(periods))
    # Placed anew behind the shuffle, so that rows and summary need the same columns of it.
    haloed = add(with_halo(base, back, 0, step, block_rows), {POS: position(step)})

    moving = rolling_columns(haloed, rolled, windows, STATS)
    totals = cumulative_values(base, rated_kva)
    running = {
        f"__run_{n}": f"sum(CASE WHEN {HOME} THEN {v} END) {forward(TO_DATE)}"
        for n, v in totals.items()
    }
    moving = moving.selectExpr("*", *aliased(change_columns(changing, periods) | running))
    local = thermal_columns(base.columns, rated_kva) | gas_total_columns(base.columns)
    wide = gas_diagnostics(add(home_rows(moving), local))
    wide = _filled(wide, totals) if fill else _summed(wide, totals, base, step, block_rows)
    return without_blocks(add(wide, d.cyclic_time(TIME)))


def _summed(
    wide: DataFrame, totals: dict[str, str], base: DataFrame, step: int, block_rows: int
) -> DataFrame:
    """Running sums continued over the blocks; missing where their value is."""
    if not totals:
        return wide
    per_block = (
        with_blocks(base, step, block_rows)
        .groupBy(KEY, BLOCK)
        .agg(*[F.expr(f"sum({v}) AS __t_{n}") for n, v in totals.items()])
    )
    before = prefix_over_blocks(per_block, (KEY,), BLOCK, [f"__t_{n}" for n in totals])
    sums = {
        n: f"CASE WHEN ({v}) IS NOT NULL THEN __run_{n} + __t_{n}__before END"
        for n, v in totals.items()
    }
    return add(wide.join(before, [KEY, BLOCK]), sums)


def _filled(wide: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Every column carried forward, then back, and running sums continued over the blocks.

    Inside a block a running window does it; what lies in other blocks comes from one
    summary row per block with the last and the first known value of each column.
    """
    runs = [f"__run_{n}" for n in totals]
    columns = [c for c in wide.columns if c not in (KEY, TIME, *NEVER_MISSING) and not c.startswith("__")]
    known = {c: f"CASE WHEN `{c}` IS NOT NULL THEN {TIME} END" for c in [*columns, *runs]}
    summary = wide.groupBy(KEY, BLOCK).agg(
        *[F.expr(f"max_by(`{c}`, {k}) AS `__l_{c}`") for c, k in known.items()],
        *[F.expr(f"min_by(`{c}`, {k}) AS `__f_{c}`") for c, k in known.items()],
    )
    earlier = over((KEY,), BLOCK, BEFORE)
    whole = over((KEY,), BLOCK, "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    carried = summary.selectExpr(
        KEY,
        BLOCK,
        *[f"last(`__l_{c}`, true) {earlier} AS `__b_{c}`" for c in columns],
        *[f"sum(`__l_{c}`) {earlier} AS `__b_{c}`" for c in runs],
        *[f"first(`__f_{c}`, true) {whole} AS `__a_{c}`" for c in known],
    )
    local = replace(wide, {c: f"last(`{c}`, true) {forward(TO_DATE)}" for c in columns})
    joined = replace(
        local.join(carried, [KEY, BLOCK]),
        {c: f"coalesce(`{c}`, `__b_{c}`, `__a_{c}`)" for c in columns},
    )
    sums = {
        n: f"coalesce(__run_{n} + coalesce(__b___run_{n}, 0D), __b___run_{n}, __a___run_{n})"
        for n in totals
    }
    return add(joined, sums)


def feature_columns(df: DataFrame, exclude_targets: bool = True) -> list[str]:
    """Model inputs: every column but keys, labels and the textual zone."""
    skip = {KEY, TIME, TIE, "duval_zone", POS}
    if exclude_targets:
        skip |= set(TARGET_COLUMNS)
    return [c for c in df.columns if c not in skip]
