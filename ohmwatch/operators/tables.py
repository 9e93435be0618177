"""Fleet questions: latest state, trailing windows, limits, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.config import FAULT_PRIORITY, KEY, LIMITS, TIE, TIME
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.axis import over
from ohmwatch.functions.guards import add, num, numeric_columns, rounded
from ohmwatch.operators.blocks import attach
from ohmwatch.operators.quantiles import quantiles

#: Fault kinds that interval tables may name.
MOST_KINDS = 50


def trailing(df: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days before each asset's newest reading."""
    newest = df.groupBy(KEY).agg(F.max(TIME).alias("__newest"))
    kept = attach(df, newest).filter(f"{TIME} >= __newest - INTERVAL '{int(days)}' DAY")
    return kept.select(*df.columns)


def above(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.filter(f"`{column}` > {num(limit)}")


def latest(df: DataFrame) -> DataFrame:
    """Newest row per asset.  The rank filter also runs before the shuffle."""
    order = ", ".join(f"{c} DESC" for c in (TIME, TIE) if c in df.columns)
    ranked = df.selectExpr("*", f"row_number() {over((KEY,), order)} AS __rank")
    return ranked.filter("__rank = 1").drop("__rank")


def ends(df: DataFrame, n: int, newest: bool = False) -> DataFrame:
    """First or last ``n`` rows of the table in time order (top-k, no full sort)."""
    order = [c for c in (TIME, KEY, TIE) if c in df.columns]
    return df.orderBy(*[F.desc(c) if newest else F.asc(c) for c in order]).limit(n)


def seeded_sample(df: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones on any cluster: smallest MD5 digests of their keys and the seed."""
    keys = [c for c in (TIE, KEY, TIME) if c in df.columns]
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys[:1] if c == TIE] or keys, F.lit(str(seed))))
    return df.orderBy(digest, *keys).limit(n)


def limit_table(spark, limits: dict[str, float] = LIMITS) -> DataFrame:
    return spark.createDataFrame(list(limits.items()), "parameter string, threshold double")


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per (reading, parameter)."""
    columns = columns or [c for c in LIMITS if c in df.columns]
    keys = [c for c in (KEY, TIE, TIME) if c in df.columns]
    typed = df.selectExpr(*keys, *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns])
    return typed.unpivot(keys, columns, "parameter", "value")


def over_limit(df: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Readings joined with the rule table (a handful of rows, broadcast)."""
    columns = [c for c in limits if c in df.columns]
    rules = F.broadcast(limit_table(df.sparkSession, limits))
    return long_form(df, columns).join(rules, "parameter").filter("value > threshold")


def exceedances(df: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """History of limit violations with the excess in percent."""
    keys = [c for c in (KEY, TIE, TIME) if c in df.columns]
    return over_limit(df, limits).selectExpr(
        *keys,
        "parameter",
        f"{rounded('value', 2)} AS value",
        "threshold",
        f"{d.excess_percent()} AS excess_pct",
    )


def exceedance_counts(df: DataFrame, by: tuple[str, ...] = ("parameter",)) -> DataFrame:
    return over_limit(df).groupBy(*by).agg(F.count("*").alias("n"))


def alerts(df: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """One row per alert: parameter, value, threshold, severity, message."""
    keys = [c for c in (KEY, TIE, TIME) if c in df.columns]
    return over_limit(df, limits).selectExpr(
        *keys,
        "parameter",
        f"{d.alert_value()} AS value",
        "threshold",
        f"{d.severity()} AS severity",
        f"{d.alert_text()} AS message",
    )


def alert_array(columns: list[str], limits: dict[str, float] = LIMITS) -> str:
    """The alerts of a row as an array of structs, without leaving the row."""
    rows = [
        f"named_struct('parameter', '{c}', 'value', CAST(`{c}` AS DOUBLE), 'threshold', {num(t)})"
        for c, t in limits.items()
        if c in columns
    ]
    full = (
        f"a -> named_struct('parameter', a.parameter, 'value', {d.alert_value('a.value')}, "
        f"'threshold', a.threshold, 'severity', {d.severity('a.value', 'a.threshold')}, "
        f"'message', {d.alert_text('a.parameter', 'a.value', 'a.threshold')})"
    )
    return f"transform(filter(array({', '.join(rows)}), a -> a.value > a.threshold), {full})"


def with_alerts(df: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    return add(df, {"active_alerts": alert_array(df.columns, limits)})


def window_statistics(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(KEY).agg(
        F.avg(column).alias("mean"),
        F.max(column).alias("max"),
        F.min(column).alias("min"),
        F.stddev_samp(column).alias("std"),
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, long form, one aggregation per asset.

    Each pair uses the rows where both values are present.
    """
    columns = columns or list(LIMITS)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(KEY).agg(
        *[F.expr(f"corr(`{a}`, `{b}`) AS `{a}|{b}`") for a, b in pairs]
    )
    entries = [f"named_struct('x', '{a}', 'y', '{b}', 'corr', `{a}|{b}`)" for a, b in pairs]
    entries += [
        f"named_struct('x', '{b}', 'y', '{a}', 'corr', `{a}|{b}`)" for a, b in pairs if a != b
    ]
    return wide.selectExpr(KEY, f"inline(array({', '.join(entries)}))")


def frequencies(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, column).agg(F.count("*").alias("n"))


def risk_shares(scored: DataFrame) -> DataFrame:
    """Hours and share in percent of every risk level, per asset."""
    shown = add(scored, {"risk_level": d.risk_level("health_score")})
    counts = shown.groupBy(KEY, "risk_level").agg(F.count("*").alias("hours"))
    return counts.selectExpr(
        KEY,
        "risk_level",
        "hours",
        f"100D * hours / sum(hours) OVER (PARTITION BY {KEY}) AS share_pct",
    )


def file_kpis(scored: DataFrame) -> DataFrame:
    shown = add(scored, {"risk_level": d.risk_level("health_score")})
    return shown.groupBy(KEY).agg(
        F.avg("health_score").alias("mean_health"),
        F.max("failure_proba").alias("max_proba"),
        F.expr("count_if(risk_level = 'CRITIQUE') AS n_critical"),
    )


def dataset_summary(df: DataFrame, n_features: int) -> DataFrame:
    return df.groupBy(KEY).agg(
        F.count("*").alias("n_rows"),
        F.min(TIME).alias("first_ts"),
        F.max(TIME).alias("last_ts"),
        F.lit(n_features).alias("n_features"),
    )


def positive_share(df: DataFrame, label: str = "failure_label") -> DataFrame:
    return df.groupBy(KEY).agg(F.expr(f"avg(`{label}`) * 100D AS positive_pct"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of every numeric column, rounded to 2."""
    columns = columns or numeric_columns(df, (KEY, TIE))
    values = long_form(df, columns)
    basic = values.groupBy("parameter").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    cut = quantiles(values, ("parameter",), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    both = basic.join(F.broadcast(cut), "parameter", "left")
    order = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return both.selectExpr("parameter", "count", *[f"{rounded(c, 2)} AS {c}" for c in order])


def label_intervals(
    df: DataFrame, intervals: DataFrame, bin_seconds: int = 6 * 3600
) -> DataFrame:
    """Readings inside fault intervals (ends included); later fault kinds win.

    A kind covers a reading if the latest end of its intervals that have begun lies ahead, so no reading meets an
    interval: both lie on one time axis per (asset, bin), where an interval stands in every bin it touches, and
    running maxima of the ends, one per kind, decide.  Rows are readings plus intervals, however they overlap, and
    intervals of a kind that begin together are one row before the shuffle.
    """
    # A kind outside the table loses to all others and keeps its own name.
    kinds = [r[0] for r in intervals.select("fault_type").distinct().limit(MOST_KINDS + 1).collect() if r[0] is not None]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} fault kinds")
    kinds.sort(key=lambda k: (FAULT_PRIORITY.get(k, 0), k), reverse=True)
    keys = [c for c in (KEY, TIE, TIME) if c in df.columns]
    if not kinds:
        return df.select(*keys, F.lit("").alias("fault_label")).limit(0)
    width = bin_seconds * 1_000_000
    micros = "unix_micros(CAST({} AS TIMESTAMP))".format
    spans = intervals.selectExpr(KEY, "fault_type AS __kind", f"{micros('start_ts')} AS __from", f"{micros('end_ts')} AS __upto")
    spans = spans.filter("__from <= __upto").selectExpr(
        "*", f"explode(sequence(CAST(floor(__from / {width}) AS BIGINT), CAST(floor(__upto / {width}) AS BIGINT))) AS __bin"
    )
    ends = spans.selectExpr(KEY, "__bin", "__kind", f"greatest(__from, __bin * {width}) AS __at", "__upto")
    begun = ends.groupBy(KEY, "__bin", "__at").agg(
        *[F.max(F.when(F.col("__kind") == k, F.col("__upto"))).alias(f"__end_{i}") for i, k in enumerate(kinds)]
    )
    timed = df.selectExpr(*keys, f"{micros(TIME)} AS __at")
    placed = timed.withColumns({"__bin": F.expr(f"CAST(floor(__at / {width}) AS BIGINT)"), "__reading": F.lit(1)})
    axis = placed.unionByName(begun.withColumn("__reading", F.lit(0)), allowMissingColumns=True)
    running = over((KEY, "__bin"), "__at, __reading", "UNBOUNDED PRECEDING AND CURRENT ROW")
    label = " ".join(f"WHEN max(__end_{i}) {running} >= __at THEN {_text(k)}" for i, k in enumerate(kinds))
    marked = axis.selectExpr(*keys, "__reading", f"CASE {label} END AS fault_label")
    return marked.filter("__reading = 1 AND fault_label IS NOT NULL").select(*keys, "fault_label")


def _text(value: str) -> str:
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{quoted}'"
