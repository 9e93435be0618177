"""Scalar diagnostics: gas ratios, zones, thermal ageing, health, risk, bands.

Every function returns SQL text (see ``guards``); all of it compiles into
whole-stage code.
"""

from __future__ import annotations

import math

from ohmwatch.config import (
    CRITICAL,
    DUVAL_CODES,
    EPS,
    GASES,
    HEALTH_WEIGHTS,
    NORMAL,
    RATED_KVA,
    RISK_BOUNDS,
    SEVERE_FACTOR,
    TDCG_LEVELS,
    WARNING,
)
from ohmwatch.functions.guards import clip, fixed_text, num, rounded, sum_present


def ratio(top: str, bottom: str) -> str:
    """Quotient kept finite by a tiny constant in the denominator."""
    return f"{top} / ({bottom} + {num(EPS)})"


def duval_percentages() -> dict[str, str]:
    """Shares of CH4, C2H4 and H2 in their sum; H2 stands in for acetylene."""
    total = f"CH4 + C2H4 + ({clip('H2', 'H2', low=0)})"
    return {
        f"duval_pct_{gas}": f"100D * {gas} / ({total} + {num(EPS)})"
        for gas in ("CH4", "C2H4", "H2")
    }


def duval_zone(ch4="duval_pct_CH4", c2h4="duval_pct_C2H4", h2="duval_pct_H2") -> str:
    """Zone of the simplified triangle; the first rule that holds decides."""
    return f"""CASE
        WHEN {h2} > 98 THEN 'PD'
        WHEN {ch4} > 80 THEN 'T1'
        WHEN {c2h4} > 20 AND {c2h4} <= 50 AND {ch4} > 40 THEN 'T2'
        WHEN {c2h4} > 50 THEN 'T3'
        WHEN {h2} > 40 AND {h2} <= 98 AND {ch4} < 40 THEN 'D1'
        WHEN {h2} > 20 AND {h2} <= 40 THEN 'D2'
        ELSE 'DT' END"""


def duval_code(zone: str = "duval_zone") -> str:
    cases = " ".join(f"WHEN '{name}' THEN {code}" for name, code in DUVAL_CODES.items())
    return f"CASE {zone} {cases} ELSE {DUVAL_CODES['DT']} END"


def rogers_ratios() -> dict[str, str]:
    return {
        "rogers_R1": ratio("CH4", "H2"),
        "rogers_R3": ratio("C2H4", "CH4"),
        "rogers_R4": ratio("CO", "CH4"),
    }


def rogers_code(r1: str = "rogers_R1", r3: str = "rogers_R3") -> str:
    """Fault code; a low first ratio decides before the third one is looked at."""
    return f"""CASE
        WHEN {r1} < 0.1D THEN 1
        WHEN {r3} < 1 AND {r1} < 1 THEN 0
        WHEN {r3} < 1 AND {r1} >= 1 THEN 2
        WHEN {r3} >= 1 AND {r3} < 3 THEN 3
        WHEN {r3} >= 3 THEN 4
        ELSE 0 END"""


def load_ratio(rated_kva: float = RATED_KVA) -> str:
    return f"load_kva / {num(rated_kva)}"


def overload(rated_kva: float = RATED_KVA) -> str:
    return clip(f"{load_ratio(rated_kva)} - 1D", "load_kva", low=0)


def aging_factor() -> str:
    """Relative ageing rate of the insulation, 1 at 98 degrees, at most 50."""
    return clip("exp((hot_spot_temp - 98D) / 6D)", "hot_spot_temp", high=50)


TEMP_GRADIENT = "top_oil_temp - ambient_temp"
HOT_SPOT_GRADIENT = "hot_spot_temp - top_oil_temp"


def cyclic_time(ts: str = "ts") -> dict[str, str]:
    """Hour, weekday (Monday 0) and month as points on a circle."""
    parts = {"hour": (f"hour({ts})", 24), "dow": (f"weekday({ts})", 7), "month": (f"month({ts})", 12)}
    out = {}
    for name, (value, period) in parts.items():
        angle = f"{num(2 * math.pi)} * {value} / {num(period)}"
        out[f"{name}_sin"] = f"sin({angle})"
        out[f"{name}_cos"] = f"cos({angle})"
    return out


def tdcg(present: tuple[str, ...] = GASES) -> str:
    """Total dissolved combustible gas; a missing gas counts as zero."""
    return sum_present(list(present))


def tdcg_level(total: str) -> str:
    """0 to 3: how many of the published levels the total has passed."""
    low, middle, high = (num(x) for x in TDCG_LEVELS)
    return (
        f"CASE WHEN {total} > {high} THEN 3 WHEN {total} > {middle} THEN 2 "
        f"WHEN {total} > {low} THEN 1 ELSE 0 END"
    )


def health_index() -> str:
    """Weighted score 0-100 of eight sensors; any missing sensor gives missing."""
    parts = [
        f"{num(weight)} * least(greatest(1D - ({name} - {num(level)}) / {num(span)}, 0D), 1D)"
        for name, (weight, level, span) in HEALTH_WEIGHTS.items()
    ]
    return clip(f"100D * ({' + '.join(parts)})", list(HEALTH_WEIGHTS), 0, 100)


def _loaded(rated_kva: float) -> str:
    return f"({clip(load_ratio(rated_kva), 'load_kva', low=0)})"


def oil_rise(rated_kva: float = RATED_KVA) -> str:
    """Steady-state oil temperature for the present load and ambient air."""
    return f"ambient_temp + 55D * pow({_loaded(rated_kva)}, 1.6D)"


def expected_hot_spot(rated_kva: float = RATED_KVA) -> str:
    return f"top_oil_temp + 23D * pow({_loaded(rated_kva)}, 1.3D)"


def health_score(probability: str = "failure_proba") -> str:
    return clip(f"(1D - {probability}) * 100D", probability, 0, 100)


def risk_level(score: str = "health_score") -> str:
    """Risk class of a health score; a score of exactly 0 is critical."""
    critical, warning = (num(x) for x in RISK_BOUNDS)
    return (
        f"CASE WHEN {score} <= {critical} THEN '{CRITICAL}' WHEN {score} <= {warning} "
        f"THEN '{WARNING}' WHEN {score} IS NOT NULL THEN '{NORMAL}' END"
    )


def severity(value: str = "value", limit: str = "threshold") -> str:
    return (
        f"CASE WHEN {value} > {limit} * {num(SEVERE_FACTOR)} "
        f"THEN '{CRITICAL}' ELSE '{WARNING}' END"
    )


def alert_text(parameter: str = "parameter", value: str = "value", limit: str = "threshold") -> str:
    # Wording of an alert.
    return (
        f"concat({parameter}, ' = ', {fixed_text(value, 1)}, ' > seuil ', "
        f"CAST({limit} AS STRING), ' (', {severity(value, limit)}, ')')"
    )


def alert_value(value: str = "value") -> str:
    return f"CAST({fixed_text(value, 2)} AS DOUBLE)"


def excess_percent(value: str = "value", limit: str = "threshold") -> str:
    return rounded(f"({value} - {limit}) / {limit} * 100D", 1)
