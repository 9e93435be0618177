"""Exact quantiles and rank statistics without one big sort in one task.

Quantiles: sketches bracket every wanted rank, what lies below a bracket is only counted, and only the values inside
are looked at one by one; wide brackets are narrowed by sketches of their own.

Rank statistics that need every value: values are counted per distinct value (combined before the shuffle), a small group
is ranked whole, a large one along value blocks whose totals give every block its starting rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.functions.axis import TO_DATE, over
from ohmwatch.functions.guards import num, replace
from ohmwatch.operators.blocks import held, running_totals

# Value blocks per group; a power of two, found by binary search in the borders.
SLICES = 1024
ALL = "__all"
#: Distinct values of a group that are ranked in one task; groups whose borders are broadcast.
WHOLE, MANY = 200_000, 1000
#: Ranks of a bracket (as a share) around a wanted one, by the sketch's accuracy; values in brackets that are counted one by one.
ACCURACY, INSIDE = 10_000, 5_000_000


def value_blocks(counts: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Add ``__slice``: how many sketch borders lie below the value (monotone in it); 0 for groups of WHOLE values or fewer."""
    shares = ", ".join(num(i / SLICES) for i in range(1, SLICES))
    large = held(counts.groupBy(*keys).agg(F.count("*").alias("__size")).filter(f"__size > {WHOLE}").select(*keys))
    groups = large.limit(MANY + 1).count()
    if not groups:
        return counts.selectExpr("*", "0 AS __slice")
    small = F.broadcast if groups <= MANY else lambda table: table
    borders = counts.join(small(large), list(keys), "left_semi").groupBy(*keys).agg(
        F.expr(f"percentile_approx({value}, array({shares}), {ACCURACY}) AS __borders")
    )
    placed = counts.join(small(borders), list(keys), "left").selectExpr("*", "0 AS __slice")
    stride = SLICES // 2
    while stride:
        further = f"if(__borders IS NOT NULL AND element_at(__borders, __slice + {stride}) < {value}, {stride}, 0)"
        placed = replace(placed, {"__slice": f"__slice + {further}"})
        stride //= 2
    return placed.drop("__borders")


def ranked_values(df: DataFrame, keys: tuple[str, ...], value: str, sums: dict[str, str]):
    """Distinct values with running totals of ``sums`` up to and including each."""
    counts = df.filter(f"{value} IS NOT NULL").groupBy(*keys, value).agg(
        *[F.expr(f"{text} AS {name}") for name, text in sums.items()]
    )
    sliced = value_blocks(counts, keys, value)
    return running_totals(sliced, {f"{n}_upto": n for n in sums}, keys, "__slice", value)


def _grouped(df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    return (df, keys) if keys else (df.selectExpr("*", f"0 AS {ALL}"), (ALL,))


def quantiles(
    df: DataFrame, keys: tuple[str, ...], value: str, wanted: dict[str, float], inside: int = INSIDE
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key; keys name a small fixed set of groups.

    Up to ``inside`` rows (counted) every value is ranked. Beyond, one pass makes the sketch, one counts, one ranks what
    lies in brackets; more than ``inside`` values there are ranked along value blocks.
    """
    shown = keys
    df, keys = _grouped(df, keys)
    names = list(wanted)
    rows = df.filter(f"{value} IS NOT NULL").selectExpr(*keys, f"CAST({value} AS DOUBLE) AS __v")
    lower = [max(0.0, wanted[n] - 2 / ACCURACY) for n in names]
    upper = [min(1.0, wanted[n] + 2 / ACCURACY) for n in names]

    at = lambda share: f"((__n - 1) * {num(share)})"
    if rows.limit(inside + 1).count() <= inside:
        counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
        whole = f"OVER (PARTITION BY {', '.join(keys)})"
        ranks = counts.selectExpr("*", f"sum(__c) {over(keys, '__v', TO_DATE)} AS __upto", f"sum(__c) {whole} AS __n")
        return _picked(ranks, shown, keys, wanted, at, lambda i: ("true", "__upto"))

    def sketched(shares):
        return f"percentile_approx(__v, array({', '.join(map(num, shares))}), {ACCURACY})"

    # A bracket reaches from a value below the wanted rank to one above it; the outermost are the least and greatest.
    ends = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.expr(f"{sketched(lower)} AS __lo"), F.expr(f"{sketched(upper)} AS __hi"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"),
    )
    # Of few rows a bracket of so many ten-thousandths might miss a neighbour: they are all inside.
    edge = lambda name, at, end: f"transform(__{name}, (x, i) -> if(__n <= {10 * ACCURACY} OR array({', '.join(at)})[i], __{end}, x)) AS __{name}"
    ends = held(ends.selectExpr(
        *keys, "__n",
        edge("lo", ["true" if x <= 0 else "false" for x in lower], "min"),
        edge("hi", ["true" if x >= 1 else "false" for x in upper], "max"),
    ))
    near = " OR ".join(f"__v BETWEEN __lo[{i}] AND __hi[{i}]" for i in range(len(names)))
    placed = rows.join(F.broadcast(ends), list(keys))
    below = [F.expr(f"count_if(__v < __lo[{i}]) AS __below_{i}") for i in range(len(names))]
    started = held(placed.groupBy(*keys).agg(*below, F.expr(f"count_if({near}) AS __inside"), F.first("__n").alias("__n")))
    held_rows = started.agg(F.sum("__inside")).first()[0] or 0
    counts = placed.filter(near).groupBy(*keys, "__v").agg(F.count("*").alias("__c"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
    if held_rows > inside:
        # Too many for one group's window: ranked along value blocks.
        counts = held(counts)
        ranks = running_totals(value_blocks(counts, keys, "__v"), {"__upto": "__c"}, keys, "__slice", "__v")
    else:
        ranks = counts.selectExpr("*", f"sum(__c) {over(keys, '__v', TO_DATE)} AS __upto")
    # Ranks among the values in brackets, moved to ranks among all: what lies below a bracket and outside earlier ones.
    first = ranks.groupBy(*keys).agg(*[F.expr(f"coalesce(max(CASE WHEN __v < __lo[{i}] THEN __upto END), 0) AS __seen_{i}") for i in range(len(names))])
    facts = started.join(first, list(keys))
    inner = ranks.join(F.broadcast(facts), list(keys))
    return _picked(inner, shown, keys, wanted, at, lambda i: (f"__v BETWEEN __lo[{i}] AND __hi[{i}]", f"(__upto - __seen_{i} + __below_{i})"))


def _picked(ranks: DataFrame, shown, keys, wanted, at, place) -> DataFrame:
    """The values at the wanted ranks and the lines between them; ``place(i)``: where to look, and a value's rank there."""
    picked = []
    for i, (name, share) in enumerate(wanted.items()):
        near, here = place(i)
        for part, rank in (("lo", f"floor({at(share)})"), ("hi", f"ceil({at(share)})")):
            hit = f"{near} AND {here} - __c <= {rank} AND {rank} < {here}"
            picked.append(F.expr(f"max(CASE WHEN {hit} THEN __v END) AS __{part}_{name}"))
    found = ranks.groupBy(*keys, "__n").agg(*picked)
    return found.selectExpr(
        *shown,
        *[
            f"__lo_{n} + (__hi_{n} - __lo_{n}) * ({at(s)} - floor({at(s)})) AS {n}"
            for n, s in wanted.items()
        ],
    )


def auc(df: DataFrame, keys: tuple[str, ...], score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties at half weight; NULL with one class only.

    Per distinct score only the two class counts travel; there may be many groups, small or large.
    """
    shown = keys
    df, keys = _grouped(df, keys)
    ranks = ranked_values(
        df, keys, score, {"__pos": f"count_if({label} = 1)", "__neg": f"count_if({label} = 0)"}
    )
    won = "sum(CAST(__pos AS DOUBLE) * ((__neg_upto - __neg) + __neg / 2D))"
    totals = ranks.groupBy(*keys).agg(
        F.expr(f"{won} AS __won"), F.sum("__pos").alias("__p"), F.sum("__neg").alias("__q")
    )
    return totals.selectExpr(
        *shown, "CASE WHEN __p > 0 AND __q > 0 THEN __won / __p / __q END AS auc"
    )
