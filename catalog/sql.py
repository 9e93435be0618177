"""Building blocks of the oracle SQL (DuckDB dialect).

Written from the definitions, with plain windows over whole assets, so that
they share nothing with the block-wise Spark operators they check.
"""

from __future__ import annotations

from ohmwatch.config import BOUNDS, LIMITS, REQUIRED
from ohmwatch.sources.fixtures import READINGS_SQL

COLS = list(REQUIRED)
PER_ASSET = "PARTITION BY asset_id ORDER BY ts"


# Means of decimals often end in an exact 5 behind the last digit shown; the same
# tiny step on both sides keeps float noise from deciding such ties.
NUDGE = "13E-9"


def r6(text: str, name: str | None = None) -> str:
    """Rounded to absorb float noise; adding zero turns -0.0 into 0.0."""
    return f"round({text} + {NUDGE}, 6) + 0" + (f" AS {name}" if name else "")


def rounded(names: list[str]) -> str:
    return ", ".join(r6(n, n) for n in names)


READINGS = f"readings AS ({READINGS_SQL.format(assets=5, events='events')})"
COPIES = f"""{READINGS}, readings_dup AS (
  SELECT * FROM readings UNION ALL
  SELECT * REPLACE (reading_id + 1000000 AS reading_id, H2 + 1 AS H2)
  FROM readings WHERE reading_id % 50 = 0)"""


def masked(source: str = "readings") -> str:
    cells = ", ".join(
        f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN {c} END AS {c}" for c, (lo, hi) in BOUNDS.items()
    )
    return f"masked AS (SELECT reading_id, asset_id, ts, {cells}, fault_type FROM {source})"


SINGLE = """single AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id, ts ORDER BY reading_id) AS rk FROM masked)
  WHERE rk = 1)"""
MEANS = ", ".join(f"avg({c}) AS {c}" for c in COLS)
BUCKETS = f"""buckets AS (
  SELECT asset_id, date_trunc('hour', ts) AS ts, {MEANS},
    arg_max(fault_type, ts) FILTER (WHERE fault_type IS NOT NULL) AS fault_type
  FROM single GROUP BY 1, 2)"""
GRID = """grid AS (
  SELECT asset_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT asset_id, min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi
        FROM readings GROUP BY asset_id))"""
LAID = f"""laid AS (
  SELECT g.asset_id, g.ts, {', '.join('b.' + c for c in COLS)}, b.fault_type
  FROM grid g LEFT JOIN buckets b ON g.asset_id = b.asset_id AND g.ts = b.ts)"""

UP = f"({PER_ASSET} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DOWN = f"({PER_ASSET} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def near(c: str) -> str:
    known = f"CASE WHEN {c} IS NOT NULL THEN ts END"
    return (
        f"last_value({c} IGNORE NULLS) OVER {UP} AS p_{c}, last_value({known} IGNORE NULLS) OVER {UP} AS pt_{c}, "
        f"first_value({c} IGNORE NULLS) OVER {DOWN} AS n_{c}, first_value({known} IGNORE NULLS) OVER {DOWN} AS nt_{c}"
    )


def line(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN n_{c} IS NULL THEN p_{c} "
        f"WHEN p_{c} IS NULL THEN NULL ELSE "
        f"p_{c} + (n_{c} - p_{c}) * (epoch(ts) - epoch(pt_{c})) / (epoch(nt_{c}) - epoch(pt_{c})) END"
    )


NEAR = f"near AS (SELECT *, {', '.join(near(c) for c in [*COLS, 'fault_type'])} FROM laid)"
HOURLY_CTE = f"""hourly AS (
  SELECT asset_id, ts, {', '.join(f"coalesce({line(c)}, n_{c}) AS {c}" for c in COLS)},
    coalesce(p_fault_type, n_fault_type, 'normal') AS fault_type
  FROM near)"""

TO_BUCKETS = f"{READINGS}, {masked()}, {SINGLE}, {BUCKETS}"
TO_LAID = f"{TO_BUCKETS}, {GRID}, {LAID}"
HOURLY = f"{TO_LAID}, {NEAR}, {HOURLY_CTE}"

SCORED = f"""{READINGS}, scored AS (
  SELECT *, CASE WHEN failure_proba + ((reading_id * 31) % 100) / 2E2 > 75E-2 THEN 1 ELSE 0 END AS y_true,
    CASE WHEN failure_proba > 5E-1 THEN 1 ELSE 0 END AS y_pred,
    least(greatest((1 - failure_proba) * 100, 0), 100) AS health_score
  FROM (SELECT *, ((reading_id * 7919) % 1001) / 1E3 AS failure_proba FROM readings))"""
RISK = (
    "CASE WHEN health_score <= 40 THEN 'CRITIQUE' WHEN health_score <= 65 THEN 'ALERTE' "
    "ELSE 'NORMAL' END"
)

LIMIT_ROWS = ", ".join(f"('{p}', {t}::DOUBLE)" for p, t in LIMITS.items())
LIMIT_CTE = f"limits AS (SELECT * FROM (VALUES {LIMIT_ROWS}) v(parameter, threshold))"


def long_cte(source: str, name: str = "long") -> str:
    parts = [
        f"SELECT reading_id, asset_id, ts, '{p}' AS parameter, {p}::DOUBLE AS value FROM {source}" for p in LIMITS
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


OVER = f"{LIMIT_CTE}, over_limit AS (SELECT l.*, m.threshold FROM long l JOIN limits m USING (parameter) WHERE l.value > m.threshold)"
SEVERITY = "CASE WHEN value > 13E-1 * threshold THEN 'CRITIQUE' ELSE 'ALERTE' END"

HEALTH = """least(greatest(100 * (
   2E-1 * least(greatest(1 - (top_oil_temp - 40) / 65, 0), 1) + 2E-1 * least(greatest(1 - (hot_spot_temp - 50) / 90, 0), 1)
 + 15E-2 * least(greatest(1 - H2 / 150, 0), 1) + 1E-1 * least(greatest(1 - C2H4 / 50, 0), 1)
 + 1E-1 * least(greatest(1 - CH4 / 120, 0), 1) + 5E-2 * least(greatest(1 - CO / 500, 0), 1)
 + 1E-1 * least(greatest(1 - moisture_ppm / 30, 0), 1) + 1E-1 * least(greatest(1 - vibration_mms / 5, 0), 1)), 0), 100)"""
HEALTH_OR_NULL = (
    f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in LIMITS)} THEN {HEALTH} END"
)

DUVAL_TOTAL = "(CH4 + C2H4 + CASE WHEN H2 IS NOT NULL THEN greatest(H2, 0) END + 1E-9)"
ZONE = """CASE WHEN d_h2 > 98 THEN 'PD' WHEN d_ch4 > 80 THEN 'T1'
  WHEN d_c2h4 > 20 AND d_c2h4 <= 50 AND d_ch4 > 40 THEN 'T2' WHEN d_c2h4 > 50 THEN 'T3'
  WHEN d_h2 > 40 AND d_h2 <= 98 AND d_ch4 < 40 THEN 'D1' WHEN d_h2 > 20 AND d_h2 <= 40 THEN 'D2' ELSE 'DT' END"""


def duval(source: str) -> str:
    return (
        f"duval AS (SELECT *, {ZONE} AS duval_zone FROM (SELECT *, 100 * CH4 / {DUVAL_TOTAL} AS d_ch4, "
        f"100 * C2H4 / {DUVAL_TOTAL} AS d_c2h4, 100 * H2 / {DUVAL_TOTAL} AS d_h2 FROM {source}))"
    )


CODE = (
    "CASE duval_zone WHEN 'PD' THEN 0 WHEN 'T1' THEN 1 WHEN 'T2' THEN 2 WHEN 'T3' THEN 3 "
    "WHEN 'D1' THEN 4 WHEN 'D2' THEN 5 ELSE 6 END"
)
R1, R3, R4 = "CH4 / (H2 + 1E-9)", "C2H4 / (CH4 + 1E-9)", "CO / (CH4 + 1E-9)"
ROGERS = (
    f"CASE WHEN {R1} < 1E-1 THEN 1 WHEN {R1} >= 1E-1 AND {R1} < 1 AND {R3} < 1 THEN 0 "
    f"WHEN {R1} >= 1 AND {R3} < 1 THEN 2 WHEN {R3} >= 1 AND {R3} < 3 THEN 3 WHEN {R3} >= 3 THEN 4 ELSE 0 END"
)
AGING = "CASE WHEN hot_spot_temp IS NOT NULL THEN least(exp((hot_spot_temp - 98) / 6), 50) END"
OVERLOAD = "CASE WHEN load_kva IS NOT NULL THEN greatest(load_kva / 1E3 - 1, 0) END"
TDCG = "coalesce(H2, 0) + coalesce(CO, 0) + coalesce(C2H4, 0) + coalesce(CH4, 0)"
LOADED = "CASE WHEN load_kva IS NOT NULL THEN greatest(load_kva / 1E3, 0) END"
OIL_RISE = f"ambient_temp + 55 * pow({LOADED}, 16E-1)"


def cyclic(name: str, value: str, period: int) -> list[str]:
    return [
        f"round(sin(2 * pi() * {value} / {period}) + {NUDGE}, 6) + 0 AS {name}_sin",
        f"round(cos(2 * pi() * {value} / {period}) + {NUDGE}, 6) + 0 AS {name}_cos",
    ]


CYCLIC = ", ".join(
    cyclic("hour", "hour(ts)", 24) + cyclic("dow", "(isodow(ts) - 1)", 7) + cyclic("month", "month(ts)", 12)
)


def even(text: str, digits: int) -> str:
    """Ties to even on the binary value, as NumPy rounds."""
    scale = f"1E{digits}"
    return f"round_even(({text}) * {scale}, 0) / {scale} + 0"


def frame(w: int) -> str:
    return f"({PER_ASSET} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def rolled(c: str, stat: str, w: int) -> str:
    f = {"mean": "avg", "std": "stddev_samp", "max": "max"}[stat]
    return (
        f"CASE WHEN count({c}) OVER {frame(w)} >= {max(1, w // 4)} THEN {f}({c}) OVER {frame(w)} END"
    )


LABEL_WINDOW, LABEL_LEVEL = 48, 5
LABEL = f"""labelled AS (
  SELECT *, CASE WHEN n <= {LABEL_WINDOW} THEN 0
      WHEN rn <= n - {LABEL_WINDOW} THEN CASE WHEN ahead < {LABEL_LEVEL} THEN 1 ELSE 0 END
      ELSE CASE WHEN tail < {LABEL_LEVEL} THEN 1 ELSE 0 END END AS failure_label
  FROM (SELECT *, min(CASE WHEN rn > n - {LABEL_WINDOW} THEN health_index END) OVER (PARTITION BY asset_id) AS tail
    FROM (SELECT *, row_number() OVER ({PER_ASSET}) AS rn, count(*) OVER (PARTITION BY asset_id) AS n,
            min(health_index) OVER ({PER_ASSET} ROWS BETWEEN 1 FOLLOWING AND {LABEL_WINDOW} FOLLOWING) AS ahead
          FROM (SELECT *, {HEALTH} AS health_index FROM hourly))))"""
