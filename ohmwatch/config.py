"""Fixed values and default parameters of the engine."""

from __future__ import annotations

KEY = "asset_id"
TIME = "ts"
TIE = "reading_id"

HOUR = 3600

# Sensor columns every reading must carry.
REQUIRED = (
    "load_kva",
    "ambient_temp",
    "top_oil_temp",
    "hot_spot_temp",
    "H2",
    "CO",
    "C2H4",
    "CH4",
    "moisture_ppm",
    "vibration_mms",
)

# Physically possible range (low, high) per sensor, inclusive.
BOUNDS = {
    "load_kva": (0.0, 1500.0),
    "ambient_temp": (-20.0, 50.0),
    "top_oil_temp": (0.0, 150.0),
    "hot_spot_temp": (0.0, 200.0),
    "H2": (0.0, 2000.0),
    "CO": (0.0, 5000.0),
    "C2H4": (0.0, 1000.0),
    "CH4": (0.0, 2000.0),
    "moisture_ppm": (0.0, 100.0),
    "vibration_mms": (0.0, 20.0),
}

# Alarm limit per monitored parameter (alert when strictly above).
LIMITS = {
    "top_oil_temp": 100.0,
    "hot_spot_temp": 130.0,
    "H2": 150.0,
    "CO": 500.0,
    "C2H4": 50.0,
    "CH4": 120.0,
    "moisture_ppm": 30.0,
    "vibration_mms": 5.0,
}
SEVERE_FACTOR = 1.3

# Column names of a stored time axis, compared in lower case.
TIME_NAMES = ("timestamp", "date", "datetime", "time", "index")

# Dissolved gases and the column sets of the moving statistics.
GASES = ("H2", "CO", "C2H4", "CH4")
ROLLING_COLUMNS = (
    "top_oil_temp",
    "hot_spot_temp",
    "load_kva",
    "H2",
    "CO",
    "C2H4",
    "CH4",
    "moisture_ppm",
    "vibration_mms",
)
CHANGE_COLUMNS = ("H2", "CO", "C2H4", "CH4", "top_oil_temp", "hot_spot_temp", "moisture_ppm")
ROLLING_WINDOWS = (168, 720)
CHANGE_PERIODS = (1, 24, 168)

# Duval zones with their numeric codes.
DUVAL_CODES = {"PD": 0, "T1": 1, "T2": 2, "T3": 3, "D1": 4, "D2": 5, "DT": 6}

# Health index, per sensor (weight, healthy level, span to zero score).
HEALTH_WEIGHTS = {
    "top_oil_temp": (0.20, 40.0, 65.0),
    "hot_spot_temp": (0.20, 50.0, 90.0),
    "H2": (0.15, 0.0, 150.0),
    "C2H4": (0.10, 0.0, 50.0),
    "CH4": (0.10, 0.0, 120.0),
    "CO": (0.05, 0.0, 500.0),
    "moisture_ppm": (0.10, 0.0, 30.0),
    "vibration_mms": (0.10, 0.0, 5.0),
}

# Combustible-gas levels in ppm, and risk bounds of the health score.
TDCG_LEVELS = (720.0, 1920.0, 4630.0)
RISK_BOUNDS = (40.0, 65.0)
CRITICAL, WARNING, NORMAL = "CRITIQUE", "ALERTE", "NORMAL"

# Fault kinds; the higher number wins where intervals overlap.
FAULT_PRIORITY = {"partial_discharge": 1, "overheating": 2, "moisture_fault": 3}
NO_FAULT = "normal"

RATED_KVA = 1000.0
EPS = 1e-9
LABEL_WINDOW = 720
LABEL_LEVEL = 50.0

# What is forecast, and how many hours ahead.
FORECAST_TARGETS = ("top_oil_temp", "hot_spot_temp", "H2", "CO", "C2H4", "CH4", "moisture_ppm")
FORECAST_HORIZONS = {"7d": 168, "30d": 720}
N_LAGS = 24
N_SPLITS = 5

TARGET_COLUMNS = ("health_index", "failure_label")
DROPPED_COLUMNS = ("fault_type", "degradation_factor")

# Rows of one asset that one task works on (plus halo): about a year of hours.
BLOCK_ROWS = 8192
# A side is broadcast only after its rows were counted and are not more than this.
BROADCAST_ROWS = 200_000
