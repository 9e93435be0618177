"""Queries: moving windows, sequences, diagnostics, feature table (W, F)."""

from __future__ import annotations

from catalog import sql as o
from catalog.registry import hourly, masked, query, r6, readings, scored
from ohmwatch.config import CHANGE_COLUMNS, ROLLING_COLUMNS
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import add, aliased, replace, rounded
from ohmwatch.operators import cleaning as c
from ohmwatch.operators import sequences as s
from ohmwatch.operators.rolling import rolling
from ohmwatch.plans.features import build_features, gas_diagnostics

KEYS = ["asset_id", "ts"]
WINDOWS = (24, 168)
PERIODS = (1, 24, 168)


# -- moving windows ------------------------------------------------------------

def _rolling(name: str, stat: str):
    names = {f"{c}_{stat}_{w}h": (c, w) for w in WINDOWS for c in ROLLING_COLUMNS}
    text = ", ".join(o.r6(o.rolled(c, stat, w), n) for n, (c, w) in names.items())

    @query(name, f"WITH {o.HOURLY} SELECT asset_id, ts, {text} FROM hourly")
    def _(spark, sf):
        return r6(rolling(hourly(spark, sf), windows=WINDOWS, stats=(stat,)).select(*KEYS, *names))


_rolling("w1_rolling_mean", "mean")
_rolling("w2_rolling_std", "std")
_rolling("w3_rolling_max", "max")

CHANGES = {
    f"{c}_roc_{p}h": f"{c} - lag({c}, {p}) OVER ({o.PER_ASSET})" for c in CHANGE_COLUMNS for p in PERIODS
}


@query(
    "w4_rate_of_change",
    f"WITH {o.HOURLY} SELECT asset_id, ts, " + ", ".join(o.r6(x, n) for n, x in CHANGES.items()) + " FROM hourly",
)
def _(spark, sf):
    return r6(s.rate_of_change(hourly(spark, sf), periods=PERIODS).select(*KEYS, *CHANGES))


@query(
    "w5_cumulative_overload",
    f"WITH {o.HOURLY} SELECT asset_id, ts, {o.r6(f'sum({o.OVERLOAD}) OVER {o.UP}', 'cumulative_overload')} FROM hourly",
)
def _(spark, sf):
    summed = s.cumulative(hourly(spark, sf), {"cumulative_overload": d.overload()})
    return r6(summed.select(*KEYS, "cumulative_overload"))


@query(
    "w6_cumulative_aging",
    f"WITH {o.HOURLY} SELECT asset_id, ts, round(sum({o.AGING}) OVER {o.UP} + 13E-8, 5) + 0 AS cumulative_aging FROM hourly",
)
def _(spark, sf):
    summed = s.cumulative(hourly(spark, sf), {"cumulative_aging": d.aging_factor()})
    return summed.selectExpr(*KEYS, "round(cumulative_aging + 13E-8, 5) + 0 AS cumulative_aging")


LAGS = {f"top_oil_temp_lag{k}": f"lag(top_oil_temp, {k}) OVER ({o.PER_ASSET})" for k in range(1, 25)}


@query(
    "w7_target_lags",
    f"WITH {o.HOURLY} SELECT asset_id, ts, " + ", ".join(o.r6(x, n) for n, x in LAGS.items()) + " FROM hourly",
)
def _(spark, sf):
    return r6(s.lags_and_future(hourly(spark, sf), "top_oil_temp").select(*KEYS, *LAGS))


@query(
    "w8_future_target",
    f"WITH {o.HOURLY} SELECT asset_id, ts, {o.r6(f'lead(top_oil_temp, 24) OVER ({o.PER_ASSET})', 'future_target')} FROM hourly",
)
def _(spark, sf):
    moved = s.lags_and_future(hourly(spark, sf), "top_oil_temp", 0, 24)
    return r6(moved.select(*KEYS, "future_target"))


def _rated(spark, sf):
    return add(hourly(spark, sf), {"health_index": d.health_index()})


@query(
    "w9_failure_label",
    f"WITH {o.HOURLY}, {o.LABEL} SELECT asset_id, ts, {o.r6('health_index', 'health_index')}, failure_label FROM labelled",
)
def _(spark, sf):
    marked = s.failure_label(_rated(spark, sf), o.LABEL_WINDOW, o.LABEL_LEVEL)
    return r6(marked.select(*KEYS, "health_index", "failure_label"))


def _episodes(source: str, order: str) -> str:
    return f"""runs AS (SELECT asset_id, fault_type, ts, sum(fresh) OVER (PARTITION BY asset_id ORDER BY {order}
      ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(fault_type) OVER (PARTITION BY asset_id ORDER BY {order})
      IS NOT DISTINCT FROM fault_type THEN 0 ELSE 1 END AS fresh FROM {source}))
    SELECT asset_id, fault_type, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows
    FROM runs WHERE fault_type <> 'normal' GROUP BY asset_id, fault_type, run"""


@query("w10_fault_episodes", f"WITH {o.READINGS}, {_episodes('readings', 'ts, reading_id')}")
def _(spark, sf):
    return s.fault_episodes(readings(spark, sf))


@query("w10_hourly_episodes", f"WITH {o.HOURLY}, {_episodes('hourly', 'ts')}")
def _(spark, sf):
    return s.fault_episodes(hourly(spark, sf))


@query(
    "w11_expected_oil",
    f"""WITH RECURSIVE {o.HOURLY}, x AS (SELECT asset_id, ts, top_oil_temp, {o.OIL_RISE} AS x,
      row_number() OVER ({o.PER_ASSET}) AS rn FROM hourly),
    y AS (SELECT asset_id, ts, top_oil_temp, rn, x AS y FROM x WHERE rn = 1
      UNION ALL SELECT x.asset_id, x.ts, x.top_oil_temp, x.rn, 85E-2 * y.y + 15E-2 * x.x
      FROM y JOIN x ON x.asset_id = y.asset_id AND x.rn = y.rn + 1)
    SELECT asset_id, ts, {o.r6('y', 'expected_oil_temp')}, {o.r6('top_oil_temp - y', 'oil_residual')} FROM y""",
)
def _(spark, sf):
    return r6(s.expected_oil(hourly(spark, sf)).select(*KEYS, "expected_oil_temp", "oil_residual"))


# -- scalar diagnostics ------------------------------------------------------------

def _scalar(name: str, columns: dict[str, str], twin: dict[str, str], source: str = "readings", ctes: str = ""):
    text = ", ".join(f"{x} AS {n}" for n, x in twin.items())

    @query(name, f"WITH {o.READINGS}{ctes} SELECT reading_id, {text} FROM {source}")
    def _(spark, sf):
        return r6(readings(spark, sf).selectExpr("reading_id", *aliased(columns)))


def _r(columns: dict[str, str]) -> dict[str, str]:
    return {n: o.r6(x) for n, x in columns.items()}


_scalar(
    "f1_duval_percentages",
    d.duval_percentages(),
    _r({"duval_pct_CH4": "d_ch4", "duval_pct_C2H4": "d_c2h4", "duval_pct_H2": "d_h2"}),
    "duval",
    f", {o.duval('readings')}",
)


@query("f2_duval_zone", f"WITH {o.READINGS}, {o.duval('readings')} SELECT reading_id, duval_zone FROM duval")
def _(spark, sf):
    return gas_diagnostics(readings(spark, sf)).select("reading_id", "duval_zone")


@query(
    "f3_duval_code",
    f"WITH {o.READINGS}, {o.duval('readings')} SELECT reading_id, {o.CODE} AS duval_zone_code FROM duval",
)
def _(spark, sf):
    return gas_diagnostics(readings(spark, sf)).select("reading_id", "duval_zone_code")


_scalar(
    "f4_rogers_ratios",
    d.rogers_ratios(),
    _r({"rogers_R1": o.R1, "rogers_R3": o.R3, "rogers_R4": o.R4}),
)


@query("f5_rogers_code", f"WITH {o.READINGS} SELECT reading_id, {o.ROGERS} AS rogers_code FROM readings")
def _(spark, sf):
    return gas_diagnostics(readings(spark, sf)).select("reading_id", "rogers_code")


_scalar("f6_load_ratio", {"load_ratio": d.load_ratio()}, _r({"load_ratio": "load_kva / 1E3"}))
_scalar(
    "f7_gradients",
    {"temp_gradient": d.TEMP_GRADIENT, "hot_spot_gradient": d.HOT_SPOT_GRADIENT},
    _r({"temp_gradient": "top_oil_temp - ambient_temp", "hot_spot_gradient": "hot_spot_temp - top_oil_temp"}),
)
_scalar("f8_overload", {"overload": d.overload()}, _r({"overload": o.OVERLOAD}))
_scalar("f9_aging_factor", {"aging_factor": d.aging_factor()}, _r({"aging_factor": o.AGING}))


@query("f10_cyclic_time", f"WITH {o.READINGS} SELECT reading_id, {o.CYCLIC} FROM readings")
def _(spark, sf):
    return r6(readings(spark, sf).selectExpr("reading_id", *aliased(d.cyclic_time())))


_scalar("f11_tdcg", {"TDCG": d.tdcg()}, _r({"TDCG": o.TDCG}))
_scalar(
    "f12_gas_ratios",
    {"H2_CH4_ratio": d.ratio("H2", "CH4"), "CO_H2_ratio": d.ratio("CO", "H2")},
    _r({"H2_CH4_ratio": "H2 / (CH4 + 1E-9)", "CO_H2_ratio": "CO / (H2 + 1E-9)"}),
)
_scalar("f13_health_index", {"health_index": d.health_index()}, _r({"health_index": o.HEALTH_OR_NULL}))
HOT = f"top_oil_temp + 23 * pow({o.LOADED}, 13E-1)"
_scalar(
    "f14_expected_hot_spot",
    {
        "expected_hot_spot": d.expected_hot_spot(),
        "hot_spot_residual": f"hot_spot_temp - ({d.expected_hot_spot()})",
    },
    _r({"expected_hot_spot": HOT, "hot_spot_residual": f"hot_spot_temp - ({HOT})"}),
)


@query(
    "f15_health_score",
    f"WITH {o.SCORED} SELECT reading_id, {o.r6('health_score', 'health_score')} FROM scored",
)
def _(spark, sf):
    return r6(scored(spark, sf).select("reading_id", "health_score"))


@query("f16_risk_level", f"WITH {o.SCORED} SELECT reading_id, {o.RISK} AS risk_level FROM scored")
def _(spark, sf):
    return scored(spark, sf).selectExpr("reading_id", f"{d.risk_level()} AS risk_level")


_scalar(
    "f17_severity",
    {"severity": f"CASE WHEN H2 > 150D THEN {d.severity('H2', '150D')} END"},
    {"severity": "CASE WHEN H2 > 150 THEN CASE WHEN H2 > 150 * 13E-1 THEN 'CRITIQUE' ELSE 'ALERTE' END END"},
)
_scalar(
    "f19_excess_percent",
    {"excess_pct": d.excess_percent("H2", "150D"), "value": rounded("H2", 2)},
    _r({"excess_pct": o.even("(H2 - 150) / 150 * 100", 1), "value": o.even("H2", 2)}),
)
_scalar(
    "f20_tdcg_level",
    {"level": d.tdcg_level(f"({d.tdcg()})")},
    {
        "level": f"CASE WHEN {o.TDCG} > 4630 THEN 3 WHEN {o.TDCG} > 1920 THEN 2 WHEN {o.TDCG} > 720 THEN 1 ELSE 0 END"
    },
)

# -- the wide table ------------------------------------------------------------

BFILL = f"OVER ({o.PER_ASSET} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
GAPPY = {f"{c}_{st}_{w}h": o.rolled(c, st, w) for w in WINDOWS for c in ROLLING_COLUMNS for st in ("mean", "std", "max")}
GAPPY |= CHANGES
PLAIN = {
    "duval_pct_CH4": "d_ch4",
    "duval_pct_C2H4": "d_c2h4",
    "duval_pct_H2": "d_h2",
    "rogers_R1": o.R1,
    "rogers_R3": o.R3,
    "rogers_R4": o.R4,
    "load_ratio": "load_kva / 1E3",
    "temp_gradient": "top_oil_temp - ambient_temp",
    "hot_spot_gradient": "hot_spot_temp - top_oil_temp",
    "aging_factor": o.AGING,
    "TDCG": o.TDCG,
    "H2_CH4_ratio": "H2 / (CH4 + 1E-9)",
    "CO_H2_ratio": "CO / (H2 + 1E-9)",
} | {c: c for c in o.COLS}
SUMS = {"cumulative_overload": "run_overload", "cumulative_aging": "run_aging"}
WIDE = (
    f"WITH {o.HOURLY}, {o.duval('hourly')}, moving AS (SELECT *, "
    + ", ".join(f"{x} AS {n}" for n, x in GAPPY.items())
    + f", sum({o.OVERLOAD}) OVER {o.UP} AS run_overload, sum({o.AGING}) OVER {o.UP} AS run_aging FROM duval) "
    "SELECT asset_id, ts, duval_zone, "
    + f"{o.CODE} AS duval_zone_code, {o.ROGERS} AS rogers_code, {o.CYCLIC.replace('13E-9, 6)', '13E-8, 5)')}, "
    + ", ".join(f"round({x} + 13E-8, 5) + 0 AS {n}" for n, x in (PLAIN | SUMS).items())
    + ", "
    + ", ".join(f"round(first_value({n} IGNORE NULLS) {BFILL} + 13E-8, 5) + 0 AS {n}" for n in GAPPY)
    + " FROM moving"
)



# The laid series with its gaps: no cell is interpolated, H2 starts ten days late,
# load_kva has holes of 40 hours in every 200.
LATE, HOLES = "ts >= TIMESTAMP '2024-01-11 00:00:00'", "(day(ts) * 24 + hour(ts)) % 200 >= 40"
GAPS = (
    f"gaps AS (SELECT * REPLACE (CASE WHEN {LATE} THEN H2 END AS H2, "
    f"CASE WHEN {HOLES} THEN load_kva END AS load_kva) FROM laid)"
)
CARRIED = PLAIN | GAPPY | {
    "cumulative_overload": f"CASE WHEN load_kva IS NOT NULL THEN sum({o.OVERLOAD}) OVER {o.UP} END",
    "cumulative_aging": f"CASE WHEN hot_spot_temp IS NOT NULL THEN sum({o.AGING}) OVER {o.UP} END",
}
WIDE_GAPS = (
    f"WITH {o.TO_LAID}, {GAPS}, {o.duval('gaps')}, moving AS (SELECT asset_id, ts, duval_zone, {o.CODE} AS duval_zone_code, "
    f"{o.ROGERS} AS rogers_code, {o.CYCLIC.replace('13E-9, 6)', '13E-8, 5)')}, "
    + ", ".join(f"{x} AS {n}" for n, x in CARRIED.items())
    + " FROM duval) SELECT * REPLACE ("
    + ", ".join(
        f"round(coalesce(last_value({n} IGNORE NULLS) OVER {o.UP}, first_value({n} IGNORE NULLS) OVER {o.DOWN}) "
        f"+ 13E-8, 5) + 0 AS {n}"
        for n in CARRIED
    )
    + ") FROM moving"
)


def _rounded(wide):
    doubles = {n for n, kind in wide.dtypes if kind == "double"}
    return wide.selectExpr(
        *[f"round(`{n}` + 13E-8, 5) + 0 AS `{n}`" if n in doubles else f"`{n}`" for n in wide.columns]
    )


@query("f21_feature_table", WIDE)
def _(spark, sf):
    return _rounded(build_features(hourly(spark, sf), WINDOWS, PERIODS))


@query("f21_feature_table_gaps", WIDE_GAPS)
def _(spark, sf):
    raw = masked(spark, sf)
    numeric, _ = c.split_columns(raw)
    laid = c.on_grid(c.resample(c.keep_first(raw), numeric=numeric, categorical=[]), raw)
    gaps = replace(
        laid,
        {"H2": f"CASE WHEN {LATE} THEN H2 END", "load_kva": f"CASE WHEN {HOLES} THEN load_kva END"},
    )
    return _rounded(build_features(gaps, WINDOWS, PERIODS))
