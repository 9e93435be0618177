"""Moving statistics over a fixed number of rows of a regular series.

Short frames use Spark's sliding window.  Its cost grows with rows x frame
length, so long frames are computed from running scans instead (van Herk 1992,
Gil and Werman 1993): the axis is cut into chunks of the frame length, every
frame is the tail of one chunk plus the head of the next, and the two partial
states are merged (Chan et al. 1983 for the variance).  That is O(1) per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ohmwatch.config import BLOCK_ROWS, HOUR, KEY, ROLLING_COLUMNS, ROLLING_WINDOWS, TIME
from ohmwatch.functions.axis import POS, TO_DATE, backward, forward, over, without_blocks
from ohmwatch.functions.guards import add, aliased, replace
from ohmwatch.operators.blocks import home_rows, with_halo

STATS = ("mean", "std", "max")
SLIDING_LIMIT = 48


def min_rows(window: int) -> int:
    return max(1, window // 4)


def column_name(column: str, stat: str, window: int) -> str:
    return f"{column}_{stat}_{window}h"


def _state(column: str, spec: str, stats: tuple[str, ...]) -> str:
    """Partial state of a running scan, as a struct."""
    value = f"CAST(`{column}` AS DOUBLE)"
    wanted = {
        "n": ("count", True),
        "mean": ("avg", {"mean", "std"} & set(stats)),
        "var": ("var_pop", "std" in stats),
        "max": ("max", "max" in stats),
        "min": ("min", "min" in stats),
    }
    parts = [f"'{k}', {f}({value}) {spec}" for k, (f, needed) in wanted.items() if needed]
    return f"named_struct({', '.join(parts)})"


def _merged(tail: str, head: str, stats: tuple[str, ...], need: int) -> dict[str, str]:
    """Statistics of the union of two disjoint partial states; ``tail`` may be NULL."""
    n_tail, n_head = f"coalesce({tail}.n, 0)", f"{head}.n"
    n = f"({n_tail} + {n_head})"
    m_tail, m_head = f"coalesce({tail}.mean, 0D)", f"coalesce({head}.mean, 0D)"
    gap = f"({m_head} - {m_tail})"
    spread = (
        f"coalesce({tail}.var, 0D) * {n_tail} + coalesce({head}.var, 0D) * {n_head} "
        f"+ {gap} * {gap} * {n_tail} * {n_head} / {n}"
    )
    out = {
        "mean": f"if({n} >= {need}, ({m_tail} * {n_tail} + {m_head} * {n_head}) / {n}, NULL)",
        "std": f"if({n} >= {max(need, 2)}, sqrt(({spread}) / ({n} - 1)), NULL)",
        "max": f"if({n} >= {need}, greatest({tail}.max, {head}.max), NULL)",
        "min": f"if({n} >= {need}, least({tail}.min, {head}.min), NULL)",
    }
    return {s: out[s] for s in stats}


def _scanned(df: DataFrame, columns, window: int, stats, need: int) -> DataFrame:
    chunk, tail, head, moved = (f"__{k}{window}" for k in ("chunk", "tail", "head", "moved"))
    cut = add(df, {chunk: f"floor({POS} / {window})"})
    for name, spec in ((head, forward(TO_DATE, chunk)), (tail, backward(TO_DATE, chunk))):
        states = ", ".join(f"'{c}', {_state(c, spec, stats)}" for c in columns)
        cut = cut.selectExpr("*", f"named_struct('at', {chunk}, {states}) AS {name}")
    # State of the row the frame starts at; where no such row exists, of the first row.
    cut = cut.selectExpr(
        "*",
        f"coalesce(lag({tail}, {window - 1}) {forward()}, "
        f"first({tail}) {forward(TO_DATE)}) AS {moved}",
    )
    # It counts only when it lies in the chunk before.
    cut = replace(cut, {moved: f"if({moved}.at < {chunk}, {moved}, NULL)"})
    out = {}
    for c in columns:
        merged = _merged(f"{moved}.`{c}`", f"{head}.`{c}`", stats, need)
        out |= {column_name(c, s, window): merged[s] for s in stats}
    return cut.selectExpr(*df.columns, *aliased(out))


FUNCTIONS = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}


def _framed(columns, window: int, stats, need: int, spec: str) -> dict[str, str]:
    return {
        column_name(c, s, window): f"CASE WHEN count(`{c}`) {spec} >= {need} "
        f"THEN {FUNCTIONS[s]}(`{c}`) {spec} END"
        for c in columns
        for s in stats
    }


def _slid(df: DataFrame, columns, window: int, stats, need: int) -> DataFrame:
    frame = forward(f"{window - 1} PRECEDING AND CURRENT ROW")
    return df.selectExpr("*", *aliased(_framed(columns, window, stats, need, frame)))


def rolling_columns(
    haloed: DataFrame,
    columns: list[str],
    windows: tuple[int, ...],
    stats: tuple[str, ...] = STATS,
    need: int | None = None,
    sliding_limit: int = SLIDING_LIMIT,
) -> DataFrame:
    """Add moving statistics to a frame that already carries its halo."""
    for window in windows:
        method = _slid if window <= sliding_limit else _scanned
        haloed = method(
            haloed, columns, window, stats, min_rows(window) if need is None else need
        )
    return haloed


def rolling(
    df: DataFrame,
    columns: list[str] | None = None,
    windows: tuple[int, ...] = ROLLING_WINDOWS,
    stats: tuple[str, ...] = STATS,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
    sliding_limit: int = SLIDING_LIMIT,
) -> DataFrame:
    """Trailing mean, sample deviation and maximum over the last rows of an asset.

    Missing until a quarter of the frame is present.  One shuffle.
    """
    columns = [c for c in (columns or ROLLING_COLUMNS) if c in df.columns]
    haloed = with_halo(df, back=max(windows) - 1, step=step, block_rows=block_rows)
    out = rolling_columns(haloed, columns, windows, stats, sliding_limit=sliding_limit)
    return without_blocks(home_rows(out))


def per_asset_rolling(df: DataFrame, columns, windows, stats=STATS) -> DataFrame:
    """The plain window over whole assets: the yardstick the block form is tested against."""
    out = {}
    for w in windows:
        frame = over((KEY,), TIME, f"{w - 1} PRECEDING AND CURRENT ROW")
        out |= _framed(columns, w, stats, min_rows(w), frame)
    return df.selectExpr("*", *aliased(out))
