"""The regular time axis: integer positions and time blocks.

On a regular grid a row's distance to another row is the difference of their
positions, so row numbers need no window over a whole asset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ohmwatch.config import BLOCK_ROWS, HOUR, KEY, TIME
from ohmwatch.functions.guards import add

POS = "__pos"
BLOCK = "__block"


MONTH = "month"


@dataclass(frozen=True)
class Anchored:
    """Steps of so many seconds that are counted from ``origin`` (seconds since the epoch)."""

    seconds: int
    origin: int


#: Seconds that divide a day, counted from the epoch; any other number from an origin; or calendar months.
Step = int | Anchored | str


def check_step(step: Step) -> Step:
    if isinstance(step, Anchored):
        if step.seconds <= 0:
            raise ValueError(f"the step must be positive, got {step.seconds} s")
    elif step != MONTH and (isinstance(step, str) or step <= 0 or 86400 % step):
        raise ValueError(f"the step must be '{MONTH}', anchored, or divide a day into whole parts, got {step}")
    return step


def fitted(df: DataFrame, step: Step) -> Step:
    """A number of seconds that does not divide a day, counted from the midnight before the first reading of all."""
    if isinstance(step, int) and step > 0 and 86400 % step:
        first = df.selectExpr(f"min(floor({seconds()} / 86400)) AS day").first()["day"] or 0
        return Anchored(step, int(first) * 86400)
    return step


def seconds(ts: str = TIME) -> str:
    return f"unix_seconds(CAST({ts} AS TIMESTAMP))"


def position(step: Step = HOUR, ts: str = TIME) -> str:
    """Number of whole steps since the epoch or origin: the bucket a time stamp falls in."""
    if step == MONTH:
        return f"CAST(year({ts}) * 12 + month({ts}) - 1 AS BIGINT)"
    if isinstance(step, Anchored):
        return f"CAST(floor(({seconds(ts)} - {step.origin}) / {step.seconds}) AS BIGINT)"
    return f"CAST(floor({seconds(ts)} / {step}) AS BIGINT)"


def start(pos: str, step: Step) -> str:
    """Start of a bucket in seconds since the epoch."""
    if step == MONTH:
        return f"unix_date(make_date(CAST(floor(({pos}) / 12) AS INT), CAST(pmod({pos}, 12) AS INT) + 1, 1)) * 86400L"
    if isinstance(step, Anchored):
        return f"(({pos}) * {step.seconds} + {step.origin})"
    return f"({pos}) * {step}"


def stamp(pos: str, step: Step, like: DataFrame, name: str = TIME) -> str:
    """Start of a bucket, in the type of the frame's time column."""
    return f"CAST(timestamp_seconds({start(pos, step)}) AS {like.schema[name].dataType.simpleString()})"


def apart(earlier: str, later: str, step: Step) -> str:
    """Time between two buckets: in steps, or in seconds where steps differ in length."""
    if step == MONTH:
        return f"({start(later, step)} - {start(earlier, step)})"
    return f"(({later}) - ({earlier}))"


def block_of(pos: str, block_rows: int = BLOCK_ROWS) -> str:
    return f"CAST(floor(({pos}) / {block_rows}) AS BIGINT)"


def with_blocks(df: DataFrame, step: Step = HOUR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return add(add(df, {POS: position(step)}), {BLOCK: block_of(POS, block_rows)})


def without_blocks(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("__")])


def over(partition: tuple[str, ...], order: str, frame: str | None = None) -> str:
    """Text of an OVER clause."""
    rows = f" ROWS BETWEEN {frame}" if frame else ""
    return f"OVER (PARTITION BY {', '.join(partition)} ORDER BY {order}{rows})"


TO_DATE = "UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "UNBOUNDED PRECEDING AND 1 PRECEDING"


def forward(frame: str | None = None, *extra: str) -> str:
    """Rows of a block in time order."""
    return over((KEY, BLOCK, *extra), POS, frame)


def backward(frame: str | None = None, *extra: str) -> str:
    """Rows of a block from its end: a running frame here is "all rows after"."""
    return over((KEY, BLOCK, *extra), f"{POS} DESC", frame)
