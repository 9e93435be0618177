"""NULL-aware helpers: missing stays missing, and NaN never enters the engine.

Expressions are SQL text for ``F.expr`` / ``selectExpr``: a wide select is then
one call into the JVM instead of hundreds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def num(value: float) -> str:
    """A DOUBLE literal (a bare decimal point would make a DECIMAL)."""
    return f"{float(value)!r}D"


def clip(value: str, inputs: str | list[str], low=None, high=None) -> str:
    """Bound a value; missing where one of its ``inputs`` is missing.

    ``least`` and ``greatest`` skip NULL, so the input columns are asked instead.
    """
    out = value
    if low is not None:
        out = f"greatest({out}, {num(low)})"
    if high is not None:
        out = f"least({out}, {num(high)})"
    needed = [inputs] if isinstance(inputs, str) else inputs
    present = " AND ".join(f"{c} IS NOT NULL" for c in needed)
    return f"CASE WHEN {present} THEN {out} END"


def rounded(value: str, digits: int) -> str:
    """Nearest multiple, ties to even, on the binary value.

    ``round`` works on the decimal text and moves values such as 69.835, whose
    binary value lies below the tie.
    """
    scale = num(10**digits)
    return f"rint(({value}) * {scale}) / {scale}"


def fixed_text(value: str, digits: int) -> str:
    """Decimal text with so many digits, ties decided by the exact binary value.

    ``%.1f`` of ``format_string`` rounds the shortest decimal text instead and
    shows 50.05 as 50.1.
    """
    return f"replace(format_number({value}, {digits}), ',', '')"


def sum_present(columns: list[str]) -> str:
    """Row-wise sum that counts missing addends as zero."""
    return " + ".join(f"coalesce({c}, 0D)" for c in columns)


def aliased(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS `{name}`" for name, text in columns.items()]


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace columns given as SQL text, in one projection."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *aliased(columns))


def replace(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace columns given as SQL text, keeping the column order."""
    return df.selectExpr(
        *[f"{columns[c]} AS `{c}`" if c in columns else f"`{c}`" for c in df.columns]
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    return replace(
        df,
        {
            f.name: f"CASE WHEN NOT isnan(`{f.name}`) THEN `{f.name}` END"
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        },
    )


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def other_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
