"""Training sets, scaling and time-ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.config import BLOCK_ROWS, HOUR, KEY, N_LAGS, N_SPLITS, TIME
from ohmwatch.functions.axis import BEFORE, BLOCK, TO_DATE, forward, over, without_blocks
from ohmwatch.functions.guards import add, aliased, num, replace
from ohmwatch.operators.blocks import attach, home_rows, row_index, with_halo
from ohmwatch.operators.sequences import lag_columns, lags_and_future

GRID_BLOCK, UPTO = "grid_block", "grid_upto_"
FUTURE = "future_target"
LABEL = "failure_label"


def forecast_inputs(columns: list[str], target: str, n_lags: int = N_LAGS) -> list[str]:
    return [c for c in columns if c != target] + list(lag_columns(target, n_lags))


def forecast_dataset(
    features: DataFrame,
    target: str,
    horizon: int,
    columns: list[str],
    n_lags: int = N_LAGS,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inputs, lags of the target and the target ``horizon`` rows ahead; complete rows."""
    present = [c for c in columns if c in features.columns]
    slim = features.select(KEY, TIME, *dict.fromkeys([*present, target]))
    shifted = lags_and_future(slim, target, n_lags, horizon, step, block_rows)
    inputs = forecast_inputs(present, target, n_lags)
    return shifted.dropna(subset=[*inputs, FUTURE]).select(KEY, TIME, *inputs, FUTURE)


def scoring_dataset(
    features: DataFrame,
    target: str,
    columns: list[str],
    n_lags: int = N_LAGS,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The same inputs without asking for a known future."""
    present = [c for c in columns if c in features.columns]
    slim = features.select(KEY, TIME, *dict.fromkeys([*present, target]))
    shifted = lags_and_future(slim, target, n_lags, None, step, block_rows)
    return shifted.select(KEY, TIME, *forecast_inputs(present, target, n_lags))


def classification_dataset(features: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    inputs = [c for c in columns if c in features.columns and c != label]
    complete = features.dropna(subset=[*inputs, label])
    return complete.selectExpr(KEY, TIME, *[f"`{c}`" for c in inputs], f"CAST({label} AS INT) AS {label}")


def scaling_facts(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column: two numbers each, one pass."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardise(df: DataFrame, facts: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation; a constant column is only centred."""
    return replace(df, {c: f"(`{c}` - {num(m)}) / {num(s)}" for c, (m, s) in facts.items()})


def _fold(n_splits: int) -> str:
    """The fold that tests row ``__rn`` of ``__n``."""
    size = f"(__n DIV {n_splits + 1})"
    start = f"(__n - {n_splits} * {size})"
    return f"CAST(CASE WHEN __rn <= {start} OR {size} = 0 THEN 0 ELSE CAST((__rn - 1 - {start}) DIV {size} AS INT) + 1 END AS INT)"


def _learns(n_splits: int, gap: int) -> str:
    """The first fold that learns from row ``__rn`` of ``__n``."""
    size = f"(__n DIV {n_splits + 1})"
    return f"CASE WHEN {size} = 0 THEN {n_splits + 1} ELSE {n_splits + 1} - CAST(floor((__n - __rn - {gap}) / {size}) AS INT) END"


def fold_numbers(
    df: DataFrame, n_splits: int = N_SPLITS, step: int = HOUR, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Expanding-window folds per asset: ``fold`` is the fold that tests the row.

    The first share (fold 0) is only ever trained on.  Fold ``i`` trains on all
    rows with a smaller number; a gap can be left by dropping rows before the
    test part (see ``train_rows``).
    """
    indexed = row_index(df, step=step, block_rows=block_rows)
    return indexed.selectExpr(*df.columns, f"{_fold(n_splits)} AS fold", "CAST(__rn AS BIGINT) AS row_no")


def fold_plan(df: DataFrame, n_splits: int = N_SPLITS, gap: int = 0, step: int = HOUR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, ``fold``, ``learns``): fold ``k`` tests the rows with fold = k and trains on those with learns <= k.

    The same folds as ``fold_numbers``; ``gap`` rows before each test part learn in later folds only.
    """
    indexed = row_index(fold_numbers(df.select(KEY, TIME), n_splits, step, block_rows), step=step, block_rows=block_rows)
    return indexed.selectExpr(KEY, TIME, "fold", f"{_learns(n_splits, gap)} AS learns")


def forecast_grid(
    features: DataFrame,
    targets: list[str],
    horizons: dict[str, int],
    columns: list[str],
    n_lags: int = N_LAGS,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[str]]:
    """One table for all targets and horizons, from one shuffle: the ``columns``, every target's lags, and its
    value ahead as ``<target>_in_<horizon>``. Rows with complete inputs; and the names of all inputs.

    Beside these, the block of a row and, for each horizon, how many rows of the block up to it have any known future: what
    ``grid_folds`` numbers the rows by.
    """
    present = [c for c in columns if c in features.columns]
    slim = features.select(KEY, TIME, *dict.fromkeys([*present, *targets]))
    haloed = with_halo(slim, n_lags, max(horizons.values()), step, block_rows)
    lags = {n: text for t in targets for n, text in lag_columns(t, n_lags).items()}
    ahead = {f"{t}_in_{h}": f"lead(`{t}`, {rows}) {forward()}" for t in targets for h, rows in horizons.items()}
    inputs = [*dict.fromkeys([*present, *targets]), *lags]
    shifted = home_rows(haloed.selectExpr("*", *aliased(lags | ahead))).dropna(subset=inputs)
    upto = {f"{UPTO}{h}": f"sum(CAST({_any_known(targets, h)} AS BIGINT)) {forward(TO_DATE)}" for h in horizons}
    numbered = shifted.selectExpr("*", *aliased(upto))
    return numbered.select(*without_blocks(shifted).columns, F.col(BLOCK).alias(GRID_BLOCK), *upto), inputs


def _any_known(targets: list[str], horizon: str) -> str:
    return "(" + " OR ".join(f"`{t}_in_{horizon}` IS NOT NULL" for t in targets) + ")"


def grid_folds(grid: DataFrame, targets: list[str], horizon: str, n_splits: int = N_SPLITS, gap: int = 0) -> DataFrame:
    """The stored ``forecast_grid`` with ``fold_<horizon>`` and ``learns_<horizon>`` of ``fold_plan``, for the rows with any known future.

    Rows are numbered by what the grid has counted inside its blocks and by one row per block: the wide rows need no shuffle.
    """
    known = _any_known(targets, horizon)
    counts = grid.filter(known).groupBy(KEY, GRID_BLOCK).agg(F.count("*").alias("__c"))
    sizes = counts.selectExpr(
        KEY, GRID_BLOCK, f"coalesce(sum(__c) {over((KEY,), GRID_BLOCK, BEFORE)}, 0) AS __before", f"sum(__c) OVER (PARTITION BY {KEY}) AS __n"
    )
    placed = attach(grid, sizes, (KEY, GRID_BLOCK), "left")
    numbered = add(placed, {"__rn": f"CASE WHEN {known} THEN {UPTO}{horizon} + __before END"})
    made = {f"fold_{horizon}": _fold(n_splits), f"learns_{horizon}": _learns(n_splits, gap)}
    return numbered.selectExpr(*grid.columns, *[f"CASE WHEN __rn IS NOT NULL THEN {text} END AS {name}" for name, text in made.items()])


def train_rows(folded: DataFrame, fold: int, gap: int = 0) -> DataFrame:
    """All rows before the test part of ``fold``, less the last ``gap`` rows per asset."""
    before = folded.filter(f"fold < {fold}")
    if gap <= 0:
        return before
    last = before.groupBy(KEY).agg(F.max("row_no").alias("__last"))
    return attach(before, last).filter(f"row_no <= __last - {gap}").drop("__last")


def enough_rows(df: DataFrame, n_splits: int = N_SPLITS) -> bool:
    """At least ten rows per split; looks at no more rows than that."""
    need = 10 * n_splits
    return df.limit(need).count() >= need
