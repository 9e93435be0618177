"""Work on long series in bounded pieces.

A window over ``PARTITION BY asset_id`` puts a whole history into one task.
Three building blocks replace it:

* ``with_halo``: copy the rows next to a block border into the neighbouring
  block, so frames of bounded reach never leave their block;
* ``running_totals`` / ``row_index``: total per block, running offset over the
  few block rows, running total inside the block;
* ``attach``: bring one row per asset to all rows of that asset, broadcast
  behind a row count, and beyond it by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.config import BLOCK_ROWS, BROADCAST_ROWS, HOUR, KEY, TIE, TIME
from ohmwatch.functions.axis import (
    BEFORE,
    BLOCK,
    POS,
    TO_DATE,
    block_of,
    over,
    position,
    seconds,
    with_blocks,
)
from ohmwatch.functions.guards import add, num
from ohmwatch.session import shared_dir

HOME = "__home"


def with_halo(
    df: DataFrame,
    back: int = 0,
    ahead: int = 0,
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Copy rows so that each block also holds ``back`` rows before and ``ahead`` after.

    One shuffle on (asset, block) then serves every window of that reach.
    ``HOME`` marks the one copy of a row that belongs to the result.
    """
    first = block_of(f"{POS} - {ahead}", block_rows)
    last = block_of(f"{POS} + {back}", block_rows)
    placed = add(df, {POS: position(step)})
    copied = placed.selectExpr("*", f"explode(sequence({first}, {last})) AS {BLOCK}")
    return add(copied, {HOME: f"{BLOCK} = {block_of(POS, block_rows)}"}).repartition(KEY, BLOCK)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(HOME)


def prefix_over_blocks(
    blocks: DataFrame, keys: tuple[str, ...], block: str, sums: list[str]
) -> DataFrame:
    """Exclusive running sums over block rows (one row per key and block)."""
    spec = over(keys, block, BEFORE)
    return blocks.selectExpr(
        *keys, block, *[f"coalesce(sum({s}) {spec}, 0) AS {s}__before" for s in sums]
    )


def running_totals(
    df: DataFrame, values: dict[str, str], keys: tuple[str, ...], block: str, order: str
) -> DataFrame:
    """Running sum of each value along ``order``, exact across blocks.

    ``block`` must be a monotone coarsening of ``order`` within the keys.
    """
    totals = df.groupBy(*keys, block).agg(
        *[F.expr(f"sum({v})").alias(f"__t_{n}") for n, v in values.items()]
    )
    before = prefix_over_blocks(totals, keys, block, [f"__t_{n}" for n in values])
    spec = over((*keys, block), order, TO_DATE)
    local = df.selectExpr("*", *[f"sum({v}) {spec} AS __l_{n}" for n, v in values.items()])
    return local.join(before, [*keys, block]).selectExpr(
        *df.columns, *[f"__l_{n} + __t_{n}__before AS {n}" for n in values]
    )


#: Parts of a full time block.
SPLITS = 256


def density_blocks(df: DataFrame, target_rows: int = 200_000) -> DataFrame:
    """Cut every asset's time into blocks of about ``target_rows`` readings, however uneven its readings lie.

    An asset starts as one block.  Blocks of more than twice the target are split at the 256-quantiles of their time (a sketch),
    again and again, so a burst gets blocks of its own; only what one second holds stays together.  A pass reads two
    columns, and hands on 255 borders for each split block: fewer than one border per 390 readings at most.
    """
    placed = add(df, {BLOCK: "CAST(0 AS BIGINT)"})
    shares = ", ".join(num(i / SPLITS) for i in range(1, SPLITS))
    at = seconds()
    while True:
        sizes = placed.groupBy(KEY, BLOCK).agg(
            F.count("*").alias("__c"), F.expr(f"max({at}) - min({at})").alias("__span"), F.expr(f"percentile_approx({at}, array({shares})) AS __borders")
        )
        full = held(sizes.filter(f"__c > {2 * target_rows} AND __span > 0").selectExpr(KEY, BLOCK, "array_distinct(__borders) AS __borders"))
        if full.isEmpty():
            return placed
        # A reading before, at or after a border lies in different parts, so a full second is parted from its neighbours.
        below = " + ".join(f"size(filter(__borders, x -> x {how} {at}))" for how in ("<", "<="))
        part = f"if(__borders IS NULL, 0, {below})"
        few = full.limit(BROADCAST_ROWS // SPLITS + 1).count() <= BROADCAST_ROWS // SPLITS
        joined = placed.join(F.broadcast(full) if few else full, [KEY, BLOCK], "left")
        placed = add(joined, {BLOCK: f"{BLOCK} * {2 * SPLITS} + {part}"}).select(*placed.columns)


def row_index(
    df: DataFrame,
    index: str = "__rn",
    total: str = "__n",
    step: int = HOUR,
    block_rows: int = BLOCK_ROWS,
    dense: bool = False,
) -> DataFrame:
    """Row number (from 1) and row count per asset, in time order, for any gaps.

    Blocks follow the clock, which is right for at most one row per step; ``dense`` ones follow the rows,
    for readings that come in bursts.
    """
    placed = density_blocks(df, block_rows) if dense else with_blocks(df, step, block_rows)
    counts = placed.groupBy(KEY, BLOCK).agg(F.count("*").alias("__c"))
    sized = counts.selectExpr(
        KEY,
        BLOCK,
        f"coalesce(sum(__c) {over((KEY,), BLOCK, BEFORE)}, 0) AS __before",
        f"sum(__c) OVER (PARTITION BY {KEY}) AS {total}",
    )
    order = ", ".join(c for c in (TIME, TIE) if c in df.columns)
    numbered = placed.selectExpr("*", f"row_number() {over((KEY, BLOCK), order)} AS __local")
    return numbered.join(sized, [KEY, BLOCK]).selectExpr(
        *df.columns, f"__local + __before AS {index}", total
    )


def held(df: DataFrame) -> DataFrame:
    """A small derived table, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(
    df: DataFrame,
    small: DataFrame,
    keys: tuple[str, ...] = (KEY,),
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join one row per key onto a large frame.

    Up to ``limit`` counted rows the small side is broadcast.  Beyond that it is an ordinary join of two
    shuffles, whose hot keys are Spark's to split (adaptive skew join).
    """
    small = held(small)
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return df.join(small, list(keys), how)
