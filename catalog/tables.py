"""Queries: cleaning, projections, joins, summaries (V, P, J, A, I2-I4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as o
from catalog.registry import hourly, masked, query, r6, readings, scored
from ohmwatch.config import BOUNDS, CHANGE_COLUMNS, LIMITS, REQUIRED, ROLLING_COLUMNS
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.axis import fitted
from ohmwatch.functions.guards import add, numeric_columns, other_columns
from ohmwatch.operators import cleaning as c
from ohmwatch.operators import tables as t
from ohmwatch.plans.features import build_features, feature_columns
from ohmwatch.plans.scoring import full_report, with_health
from ohmwatch.sources import fixtures

COLS = list(REQUIRED)
CELLS = ", ".join(COLS)


# -- validation and cleaning ------------------------------------------------

@query(
    "v1_required_columns",
    f"WITH {o.READINGS}, wanted AS (SELECT unnest([{', '.join(repr(p) for p in BOUNDS)}]) AS parameter) "
    "SELECT parameter, (SELECT count(*) FROM readings) AS n_rows FROM wanted WHERE parameter IN ('CO', 'vibration_mms')",
)
def _(spark, sf):
    """What a table without two of its sensors lacks, beside its number of rows."""
    lacking = readings(spark, sf).drop("CO", "vibration_mms")
    absent = F.explode(F.array(*[F.lit(name) for name in c.missing_columns(lacking)]))
    return lacking.agg(F.count("*").alias("n_rows")).select(absent.alias("parameter"), "n_rows")


@query(
    "v2_bound_violations",
    f"WITH {o.READINGS} "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{p}' AS parameter, count(*) FILTER (WHERE {p} < {lo} OR {p} > {hi}) AS n_out "
        "FROM readings) WHERE n_out > 0"
        for p, (lo, hi) in BOUNDS.items()
    ),
)
def _(spark, sf):
    return c.bound_violations(readings(spark, sf))


@query(
    "v3_mask_bounds",
    f"WITH {o.READINGS}, {o.masked()} SELECT reading_id, asset_id, ts, {o.rounded(COLS)} FROM masked",
)
def _(spark, sf):
    return r6(c.mask_bounds(readings(spark, sf)).drop("fault_type"))


@query(
    "v4_sort_by_time",
    f"WITH {o.READINGS} SELECT asset_id, ts, reading_id FROM readings ORDER BY asset_id, ts, reading_id",
)
def _(spark, sf):
    return c.sort_readings(readings(spark, sf).select("asset_id", "ts", "reading_id"))


@query(
    "v5_keep_first",
    f"WITH {o.COPIES}, {o.masked('readings_dup')}, {o.SINGLE} "
    f"SELECT reading_id, asset_id, ts, {o.rounded(COLS)}, fault_type FROM single",
)
def _(spark, sf):
    copies = fixtures.with_copies(readings(spark, sf))
    return r6(c.keep_first(c.mask_bounds(copies)))


@query(
    "v6_split_columns",
    f"WITH {o.READINGS} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS parameter, count({x}) AS n, '{kind}' AS kind FROM readings"
        for kind, names in (
            ("numeric", ["reading_id", "asset_id", *COLS]),
            ("other", ["ts", "fault_type"]),
        )
        for x in names
    ),
)
def _(spark, sf):
    df = readings(spark, sf)
    numeric = df.agg(*[F.count(x).alias(x) for x in numeric_columns(df)])
    other = df.agg(*[F.count(x).alias(x) for x in other_columns(df)])
    long = lambda x, kind: x.unpivot([], x.columns, "parameter", "n").withColumn(
        "kind", F.lit(kind)
    )
    return long(numeric, "numeric").unionByName(long(other, "other"))


@query(
    "v7_resample_mean",
    f"WITH {o.TO_BUCKETS} SELECT asset_id, ts, {o.rounded(COLS)} FROM buckets",
)
def _(spark, sf):
    return r6(c.resample(c.keep_first(masked(spark, sf)), numeric=COLS, categorical=[]))


FIRST_DAY = "(SELECT date_trunc('day', min(ts)) FROM readings)"
STEPS = {
    "week": f"{FIRST_DAY} + INTERVAL 7 DAY * CAST(floor((epoch(ts) - epoch({FIRST_DAY})) / 604800) AS INTEGER)",
    "month": "date_trunc('month', ts)",
}


def _resampled(name: str):
    @query(
        f"v7_resample_{name}",
        f"WITH {o.READINGS}, {o.masked()}, {o.SINGLE} SELECT asset_id, CAST({STEPS[name]} AS TIMESTAMP) AS ts, "
        + ", ".join(o.r6(f"avg({p})", p) for p in COLS)
        + ", arg_max(fault_type, ts) AS fault_type FROM single GROUP BY 1, 2",
    )
    def _(spark, sf):
        df = masked(spark, sf)
        step = fitted(df, 7 * 86400) if name == "week" else name
        return r6(c.resample(c.keep_first(df), step, COLS, ["fault_type"]))


_resampled("week")
_resampled("month")


@query("v8_resample_last", f"WITH {o.TO_BUCKETS} SELECT asset_id, ts, fault_type FROM buckets")
def _(spark, sf):
    return c.resample(c.keep_first(masked(spark, sf)), numeric=[], categorical=["fault_type"])


def _laid(spark, sf):
    df = masked(spark, sf)
    return c.on_grid(c.resample(c.keep_first(df)), df)


@query("v9_regular_grid", f"WITH {o.TO_LAID} SELECT asset_id, ts FROM grid")
def _(spark, sf):
    return c.time_grid(readings(spark, sf))


@query(
    "v10_align_results",
    f"WITH {o.TO_BUCKETS} SELECT asset_id, ts, {o.rounded(COLS)}, fault_type FROM buckets",
)
def _(spark, sf):
    single = c.keep_first(masked(spark, sf))
    means = c.resample(single, numeric=COLS, categorical=[])
    lasts = c.resample(single, numeric=[], categorical=["fault_type"])
    return r6(c.align(means, lasts))


GAPPY = ["top_oil_temp", "hot_spot_temp", "load_kva"]


@query(
    "v11_interpolate",
    f"WITH {o.TO_LAID}, {o.NEAR} SELECT asset_id, ts, "
    + ", ".join(o.r6(o.line(x), x) for x in GAPPY)
    + " FROM near",
)
def _(spark, sf):
    return r6(c.interpolate(_laid(spark, sf).select("asset_id", "ts", *GAPPY), GAPPY))


@query(
    "v12_forward_fill",
    f"WITH {o.TO_LAID}, {o.NEAR} SELECT asset_id, ts, {o.r6('p_top_oil_temp', 'top_oil_temp')}, "
    "p_fault_type AS fault_type FROM near",
)
def _(spark, sf):
    cols = ["top_oil_temp", "fault_type"]
    return r6(c.forward_fill(_laid(spark, sf).select("asset_id", "ts", *cols), cols))


@query(
    "v13_backward_fill",
    f"WITH {o.TO_LAID}, {o.NEAR} SELECT asset_id, ts, {o.r6('n_top_oil_temp', 'top_oil_temp')}, "
    "n_fault_type AS fault_type FROM near",
)
def _(spark, sf):
    cols = ["top_oil_temp", "fault_type"]
    return r6(c.backward_fill(_laid(spark, sf).select("asset_id", "ts", *cols), cols))


@query(
    "v14_constant_fill",
    f"WITH {o.TO_LAID} SELECT asset_id, ts, {o.r6('coalesce(top_oil_temp, 0)', 'top_oil_temp')}, "
    "coalesce(fault_type, 'normal') AS fault_type FROM laid",
)
def _(spark, sf):
    laid = _laid(spark, sf).select("asset_id", "ts", "top_oil_temp", "fault_type")
    return r6(c.constant_fill(laid, {"top_oil_temp": 0.0, "fault_type": "normal"}))


@query(
    "v15_missing_cells",
    f"WITH {o.TO_LAID} SELECT CAST(sum("
    + " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in [*COLS, "fault_type"])
    + ") AS BIGINT) AS n_missing FROM laid",
)
def _(spark, sf):
    return c.missing_cells(_laid(spark, sf))


@query(
    "v16_clean_series",
    f"WITH {o.HOURLY} SELECT asset_id, ts, {o.rounded(COLS)}, fault_type FROM hourly",
)
def _(spark, sf):
    return r6(hourly(spark, sf))


@query(
    "v17_chronological_split",
    f"WITH {o.TO_LAID} SELECT asset_id, ts, CASE WHEN rn <= floor(n * 8E-1) THEN 'train' ELSE 'test' END AS part "
    "FROM (SELECT asset_id, ts, row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS rn, "
    "count(*) OVER (PARTITION BY asset_id) AS n FROM grid)",
)
def _(spark, sf):
    return c.chronological_split(c.time_grid(readings(spark, sf)))


# -- projections, filters, row limits ----------------------------------------

@query(
    "p1_trailing_window",
    f"WITH {o.READINGS}, m AS (SELECT asset_id, max(ts) AS newest FROM readings GROUP BY 1) "
    "SELECT reading_id, asset_id, r.ts, load_kva FROM readings r JOIN m USING (asset_id) "
    "WHERE r.ts >= newest - INTERVAL 7 DAY",
)
def _(spark, sf):
    return t.trailing(readings(spark, sf).select("reading_id", "asset_id", "ts", "load_kva"), 7)


@query(
    "p2_threshold_filter",
    f"WITH {o.READINGS} SELECT reading_id, asset_id, ts, H2 FROM readings WHERE H2 > 150",
)
def _(spark, sf):
    return t.above(readings(spark, sf), "H2", LIMITS["H2"]).select("reading_id", "asset_id", "ts", "H2")


@query(
    "p3_column_subset",
    f"WITH {o.READINGS} SELECT asset_id, ts, load_kva, ambient_temp, fault_type FROM readings",
)
def _(spark, sf):
    return readings(spark, sf).select("asset_id", "ts", "load_kva", "ambient_temp", "fault_type")


@query(
    "p4_drop_columns",
    f"WITH {o.READINGS} SELECT reading_id, asset_id, ts, {o.rounded(COLS)} FROM readings",
)
def _(spark, sf):
    return r6(readings(spark, sf).drop("fault_type", "degradation_factor", "not_there"))


FEATURE_NAMES = [
    *COLS,
    *[f"{x}_{s}_{w}h" for w in (24, 168) for x in ROLLING_COLUMNS for s in ("mean", "std", "max")],
    *[f"{x}_roc_{p}h" for x in CHANGE_COLUMNS for p in (1, 24, 168)],
    *["duval_pct_CH4", "duval_pct_C2H4", "duval_pct_H2", "duval_zone_code"],
    *["rogers_R1", "rogers_R3", "rogers_R4", "rogers_code", "load_ratio", "temp_gradient"],
    *["hot_spot_gradient", "cumulative_overload", "aging_factor", "cumulative_aging"],
    *[f"{x}_{s}" for x in ("hour", "dow", "month") for s in ("sin", "cos")],
    *["TDCG", "H2_CH4_ratio", "CO_H2_ratio"],
]


@query(
    "p5_feature_columns",
    f"WITH {o.READINGS}, {o.GRID}, names AS (SELECT unnest({FEATURE_NAMES}) AS feature) "
    "SELECT feature, (SELECT count(*) FROM grid) AS n_rows FROM names",
)
def _(spark, sf):
    wide = build_features(hourly(spark, sf), (24, 168))
    names = feature_columns(wide)
    return wide.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "n_rows")


@query(
    "p6_drop_incomplete",
    f"WITH {o.READINGS} SELECT reading_id, asset_id, ts, {o.r6('top_oil_temp', 'top_oil_temp')} "
    "FROM readings WHERE top_oil_temp IS NOT NULL AND load_kva IS NOT NULL",
)
def _(spark, sf):
    kept = readings(spark, sf).dropna(subset=["top_oil_temp", "load_kva"])
    return r6(kept.select("reading_id", "asset_id", "ts", "top_oil_temp"))


@query(
    "p7_latest_reading",
    f"WITH {o.READINGS} SELECT reading_id, asset_id, ts, {o.rounded(COLS)}, fault_type FROM readings "
    "QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, reading_id DESC) = 1",
)
def _(spark, sf):
    return r6(t.latest(readings(spark, sf)))


@query(
    "p8_first_rows",
    f"WITH {o.READINGS} SELECT asset_id, ts, reading_id FROM readings ORDER BY ts, asset_id, reading_id LIMIT 10",
)
def _(spark, sf):
    return t.ends(readings(spark, sf).select("asset_id", "ts", "reading_id"), 10)


@query(
    "p8_last_rows",
    f"WITH {o.READINGS} SELECT asset_id, ts, reading_id FROM readings "
    "ORDER BY ts DESC, asset_id DESC, reading_id DESC LIMIT 10",
)
def _(spark, sf):
    return t.ends(readings(spark, sf).select("asset_id", "ts", "reading_id"), 10, newest=True)


@query(
    "p9_newest_first",
    f"WITH {o.READINGS} SELECT asset_id, ts, reading_id, H2 FROM readings WHERE H2 > 150 "
    "ORDER BY ts DESC, reading_id",
)
def _(spark, sf):
    picked = t.above(readings(spark, sf), "H2", 150.0).select("asset_id", "ts", "reading_id", "H2")
    return picked.orderBy(F.desc("ts"), "reading_id")


@query(
    "p10_seeded_sample",
    f"""WITH {o.READINGS}, picked AS (SELECT *, CH4 + C2H4 + greatest(H2, 0) + 1E-9 AS total FROM readings
      ORDER BY md5(CAST(reading_id AS VARCHAR) || '|42'), reading_id LIMIT 500)
    SELECT reading_id, {o.r6('100 * CH4 / total', 'duval_pct_CH4')}, {o.r6('100 * C2H4 / total', 'duval_pct_C2H4')},
      {o.rounded(['H2', 'CH4', 'C2H4'])} FROM picked""",
)
def _(spark, sf):
    zoned = add(readings(spark, sf), d.duval_percentages())
    zoned = add(zoned, {"duval_zone": d.duval_zone()})
    return r6(t.seeded_sample(zoned, 500, 42).select("reading_id", "duval_pct_CH4", "duval_pct_C2H4", "H2", "CH4", "C2H4"))


@query(
    "p11_deviation_from_nominal",
    f"WITH {o.READINGS} SELECT reading_id, asset_id, ts, {o.r6('top_oil_temp - 60', 'deviation')} FROM readings",
)
def _(spark, sf):
    return r6(
        readings(spark, sf).selectExpr("reading_id", "asset_id", "ts", "top_oil_temp - 60D AS deviation")
    )


def _series(name, columns, expressions=None):
    shown = expressions or {x: x for x in columns}
    sql = (
        f"WITH {o.HOURLY}, m AS (SELECT asset_id, max(ts) AS newest FROM hourly GROUP BY 1) SELECT asset_id, h.ts, "
        + ", ".join(o.r6(text, x) for x, text in shown.items())
        + " FROM hourly h JOIN m USING (asset_id) WHERE h.ts >= newest - INTERVAL 14 DAY"
    )
    return query(name, sql)


@_series("p13_load_and_temperatures", ["load_kva", "ambient_temp", "top_oil_temp", "hot_spot_temp"])
def _(spark, sf):
    shown = ["load_kva", "ambient_temp", "top_oil_temp", "hot_spot_temp"]
    return r6(t.trailing(hourly(spark, sf).select("asset_id", "ts", *shown), 14))


@_series("p13_gas_series", ["H2", "CO", "C2H4", "CH4"])
def _(spark, sf):
    return r6(t.trailing(hourly(spark, sf).select("asset_id", "ts", "H2", "CO", "C2H4", "CH4"), 14))


@_series("p13_health_trend", [], {"health_index": o.HEALTH})
def _(spark, sf):
    shown = hourly(spark, sf).selectExpr("asset_id", "ts", f"{d.health_index()} AS health_index")
    return r6(t.trailing(shown, 14))


@_series("p13_tdcg_trend", [], {"tdcg": o.TDCG})
def _(spark, sf):
    return r6(t.trailing(hourly(spark, sf).selectExpr("asset_id", "ts", f"{d.tdcg()} AS tdcg"), 14))


# -- joins ---------------------------------------------------------------------

HALVES = f"""WITH {o.READINGS},
 a AS (SELECT asset_id, date_trunc('hour', ts) AS ts, avg(H2) AS h2_even FROM readings WHERE H2 > 150 GROUP BY 1, 2),
 b AS (SELECT asset_id, date_trunc('hour', ts) AS ts, avg(CO) AS co_odd FROM readings WHERE CO > 500 GROUP BY 1, 2)
 SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, coalesce(a.ts, b.ts) AS ts,
   {o.r6('h2_even', 'h2_high')}, {o.r6('co_odd', 'co_high')}
 FROM a FULL JOIN b ON a.asset_id = b.asset_id AND a.ts = b.ts"""


@query("j1_align_full_outer", HALVES)
def _(spark, sf):
    df = readings(spark, sf)
    h2 = c.resample(t.above(df, "H2", 150.0), numeric=["H2"], categorical=[])
    co = c.resample(t.above(df, "CO", 500.0), numeric=["CO"], categorical=[])
    both = c.align(h2.withColumnRenamed("H2", "h2_high"), co.withColumnRenamed("CO", "co_high"))
    return r6(both)


@query(
    "j2_grid_left_join",
    f"WITH {o.TO_LAID} SELECT asset_id, ts, {o.rounded(COLS)}, fault_type FROM laid",
)
def _(spark, sf):
    return r6(_laid(spark, sf))


@query(
    "j3_realign_predictions",
    f"WITH {o.HOURLY} SELECT asset_id, ts, {o.r6('top_oil_temp', 'top_oil_temp')}, "
    f"{o.r6('CASE WHEN top_oil_temp > 80 THEN top_oil_temp + 1 END', 'forecast')} FROM hourly",
)
def _(spark, sf):
    from ohmwatch.plans.scoring import realign

    series = hourly(spark, sf).select("asset_id", "ts", "top_oil_temp")
    some = t.above(series, "top_oil_temp", 80.0).selectExpr("asset_id", "ts", "top_oil_temp + 1 AS forecast")
    return r6(realign(series, some))


@query(
    "j4_rule_table_join",
    f"WITH {o.READINGS}, {o.long_cte('readings')}, {o.OVER} "
    f"SELECT reading_id, asset_id, ts, parameter, {o.r6('value', 'value')}, threshold FROM over_limit",
)
def _(spark, sf):
    return r6(
        t.over_limit(readings(spark, sf)).select(
            "reading_id", "asset_id", "ts", "parameter", "value", "threshold"
        )
    )


@query(
    "j5_label_fault_intervals",
    f"""WITH {o.READINGS}, spans AS (SELECT asset_id, fault_type, ts AS start_ts, ts + INTERVAL 36 HOUR AS end_ts,
      CASE fault_type WHEN 'partial_discharge' THEN 1 WHEN 'overheating' THEN 2 ELSE 3 END AS pr
      FROM readings WHERE reading_id % 400 = 0 AND fault_type <> 'normal')
    SELECT r.asset_id, r.reading_id, r.ts, arg_max(s.fault_type, s.pr) AS fault_label
    FROM readings r JOIN spans s ON r.asset_id = s.asset_id AND r.ts BETWEEN s.start_ts AND s.end_ts
    GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    df = readings(spark, sf)
    return t.label_intervals(df, fixtures.fault_intervals(df))


# -- summaries -------------------------------------------------------------------

@query(
    "a1_window_statistics",
    f"WITH {o.READINGS}, m AS (SELECT asset_id, max(ts) AS newest FROM readings GROUP BY 1) SELECT asset_id, "
    f"{o.r6('avg(top_oil_temp)', 'mean')}, {o.r6('max(top_oil_temp)', 'max')}, {o.r6('min(top_oil_temp)', 'min')}, "
    f"{o.r6('stddev_samp(top_oil_temp)', 'std')} FROM readings r JOIN m USING (asset_id) "
    "WHERE r.ts >= newest - INTERVAL 14 DAY GROUP BY 1",
)
def _(spark, sf):
    shown = readings(spark, sf).select("asset_id", "ts", "top_oil_temp")
    return r6(t.window_statistics(t.trailing(shown, 14), "top_oil_temp"))


@query(
    "a2_describe",
    f"WITH {o.READINGS}, long AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS parameter, {x}::DOUBLE AS v FROM readings" for x in COLS)
    + ") SELECT parameter, count(v) AS count, "
    + ", ".join(
        f"{o.even(x, 2)} AS {n}"
        for n, x in {
            "mean": "avg(v)",
            "std": "stddev_samp(v)",
            "min": "min(v)",
            "q25": "quantile_cont(v, 25E-2)",
            "q50": "quantile_cont(v, 5E-1)",
            "q75": "quantile_cont(v, 75E-2)",
            "max": "max(v)",
        }.items()
    )
    + " FROM long GROUP BY 1",
)
def _(spark, sf):
    return t.describe(readings(spark, sf), COLS)


@query(
    "a3_correlations",
    f"WITH {o.READINGS}, w AS (SELECT r.* FROM readings r JOIN (SELECT asset_id, max(ts) AS newest FROM readings GROUP BY 1) "
    "USING (asset_id) WHERE r.ts >= newest - INTERVAL 14 DAY) "
    + " UNION ALL ".join(
        f"SELECT asset_id, '{x}' AS x, '{y}' AS y, {o.r6(f'corr({x}, {y})', 'corr')} FROM w GROUP BY asset_id"
        for x in LIMITS
        for y in LIMITS
    ),
)
def _(spark, sf):
    return r6(t.correlations(t.trailing(readings(spark, sf), 14)))


@query(
    "a4_duval_zone_counts",
    f"WITH {o.READINGS}, {o.duval('readings')} SELECT duval_zone, count(*) AS n FROM duval GROUP BY 1",
)
def _(spark, sf):
    zoned = add(add(readings(spark, sf), d.duval_percentages()), {"duval_zone": d.duval_zone()})
    return t.frequencies(zoned, "duval_zone").orderBy(F.desc("n"), "duval_zone")


@query(
    "a5_exceedance_history",
    f"WITH {o.READINGS}, {o.long_cte('readings')}, {o.OVER} SELECT asset_id, reading_id, ts, parameter, "
    f"{o.even('value', 2)} AS value, threshold, {o.even('(value - threshold) / threshold * 100', 1)} AS excess_pct "
    "FROM over_limit ORDER BY ts DESC, reading_id, parameter",
)
def _(spark, sf):
    return t.exceedances(readings(spark, sf)).orderBy(F.desc("ts"), "reading_id", "parameter")


@query(
    "a6_exceedance_counts",
    f"WITH {o.READINGS}, {o.long_cte('readings')}, {o.OVER} SELECT parameter, count(*) AS n FROM over_limit GROUP BY 1",
)
def _(spark, sf):
    return t.exceedance_counts(readings(spark, sf)).orderBy(F.desc("n"), "parameter")


# Means are rounded before the comparison: a mean equal to a limit must not
# depend on the order of summation.
HOURS = f"(SELECT 0 AS reading_id, asset_id, ts, {o.rounded(list(LIMITS))} FROM buckets)"


@query(
    "a6_fleet_exceedances",
    f"WITH {o.TO_BUCKETS}, {o.long_cte(HOURS)}, {o.OVER} "
    "SELECT asset_id, parameter, count(*) AS n FROM over_limit GROUP BY 1, 2",
)
def exceedances_per_asset(spark, sf):
    """How many hours did each sensor of each asset stand above its limit?"""
    single = c.keep_first(masked(spark, sf))
    buckets = c.resample(single, numeric=list(LIMITS), categorical=[])
    return t.exceedance_counts(r6(buckets), ("asset_id", "parameter"))


@query(
    "a7_risk_distribution",
    f"WITH {o.SCORED}, k AS (SELECT asset_id, {o.RISK} AS risk_level, count(*) AS hours FROM scored GROUP BY 1, 2) "
    "SELECT asset_id, risk_level, hours, "
    f"{o.r6('1E2 * hours / sum(hours) OVER (PARTITION BY asset_id)', 'share_pct')} FROM k",
)
def _(spark, sf):
    return r6(t.risk_shares(scored(spark, sf)))


@query(
    "a8_file_kpis",
    f"WITH {o.SCORED} SELECT asset_id, {o.r6('avg(health_score)', 'mean_health')}, {o.r6('max(failure_proba)', 'max_proba')}, "
    f"count(*) FILTER (WHERE {o.RISK} = 'CRITIQUE') AS n_critical FROM scored GROUP BY 1",
)
def _(spark, sf):
    return r6(t.file_kpis(scored(spark, sf)))


@query(
    "a9_dataset_summary",
    f"WITH {o.READINGS} SELECT asset_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, 11 AS n_features "
    "FROM readings GROUP BY 1",
)
def _(spark, sf):
    df = readings(spark, sf)
    return t.dataset_summary(df, len(feature_columns(df)))


@query(
    "a10_positive_share",
    f"WITH {o.HOURLY}, {o.LABEL} SELECT asset_id, {o.r6('avg(failure_label) * 100', 'positive_pct')} FROM labelled GROUP BY 1",
)
def _(spark, sf):
    from ohmwatch.operators.sequences import failure_label

    rated = add(hourly(spark, sf), {"health_index": d.health_index()})
    return r6(t.positive_share(failure_label(rated, o.LABEL_WINDOW, o.LABEL_LEVEL)))


# -- alerts and reports ------------------------------------------------------------

@query(
    "i2_alerts",
    f"WITH {o.READINGS}, {o.long_cte('readings')}, {o.OVER} SELECT asset_id, reading_id, ts, parameter, "
    f"printf('%.2f', value)::DOUBLE AS value, threshold, {o.SEVERITY} AS severity FROM over_limit",
)
def _(spark, sf):
    return t.alerts(readings(spark, sf)).drop("message")


@query(
    "i3_latest_alerts",
    f"WITH {o.READINGS}, newest AS (SELECT * FROM readings QUALIFY row_number() OVER "
    "(PARTITION BY asset_id ORDER BY ts DESC, reading_id DESC) = 1), "
    f"{o.long_cte('newest')}, {o.OVER} SELECT asset_id, reading_id, ts, parameter, "
    f"printf('%.2f', value)::DOUBLE AS value, threshold, {o.SEVERITY} AS severity FROM over_limit",
)
def _(spark, sf):
    return t.alerts(t.latest(readings(spark, sf))).drop("message")


@query(
    "f18_alert_text",
    f"WITH {o.READINGS}, {o.long_cte('readings')}, {o.OVER} SELECT reading_id, parameter, "
    f"printf('%s = %.1f > seuil %.1f (%s)', parameter, value, threshold, {o.SEVERITY}) AS message FROM over_limit",
)
def _(spark, sf):
    return t.alerts(readings(spark, sf)).select("reading_id", "parameter", "message")


@query("i4_full_report")
def _(spark, sf):
    return full_report(with_health(fixtures.scored(readings(spark, sf))))


@query(
    "i4_report_alerts",
    f"WITH {o.SCORED}, newest AS (SELECT * FROM scored QUALIFY row_number() OVER "
    "(PARTITION BY asset_id ORDER BY ts DESC, reading_id DESC) = 1), "
    f"{o.long_cte('newest')}, {o.OVER}, active AS (SELECT *, {o.SEVERITY} AS severity FROM over_limit), n AS (SELECT asset_id, count(*) AS n_samples FROM scored GROUP BY 1) "
    f"SELECT asset_id, {o.r6('health_score', 'health_score')}, {o.RISK} AS risk_level, n_samples, "
    f"o.parameter, printf('%.2f', o.value)::DOUBLE AS value, o.threshold, o.severity "
    "FROM newest JOIN n USING (asset_id) LEFT JOIN active o USING (asset_id)",
)
def _(spark, sf):
    report = full_report(with_health(fixtures.scored(readings(spark, sf))))
    flat = report.selectExpr(
        "asset_id", "health_score", "risk_level", "n_samples", "explode_outer(active_alerts) AS a"
    )
    return r6(flat.select("asset_id", "health_score", "risk_level", "n_samples", "a.*"))
