"""Fixed values the results depend on.

FIXED VALUES -- these must stay exactly as written for results to match the
behaviour being re-implemented (names, coordinates, thresholds, defaults).
"""

from __future__ import annotations

# --- fixed values: indicator names, in this order -------------------------
INDICATORS = [
    "Nitrogen dioxide",
    "Particulate matter < 10 µm",
    "Particulate matter < 2.5 µm",
]

# --- fixed values: monitored stations and their coordinates (lat, lon) -----
REFERENCE_STATIONS = [
    ("Helsinki Kallio 2", 60.1878, 24.9508),
    ("Espoo Leppävaara Läkkisepänkuja", 60.2191, 24.8130),
    ("Espoo Luukki", 60.1625, 24.6683),
    ("Helsinki Mannerheimintie", 60.1699, 24.9384),
    ("Vantaa Tikkurila Neilikkatie", 60.2925, 25.0442),
    ("Vantaa Kehä III Viinikkala", 60.2708, 24.8875),
    ("Helsinki Kustaa Vaasan tie", 60.1985, 24.9675),
]

# --- fixed values: name normalisation for forecast keys --------------------
PM_LONG_PREFIX = "Particulate matter < "
PM_SHORT_PREFIX = "PM"
MICRON_SUFFIX = " µm"
UNKNOWN_STATION = "Unknown Station"

# --- fixed values: safe-level thresholds by pollutant (µg/m³) --------------
POLLUTANT_THRESHOLDS = [
    ("Nitrogen dioxide", 10.0),
    ("PM10", 15.0),
    ("PM2.5", 5.0),
]

# --- fixed values: PM10 colour bands (strictly greater than) ---------------
PM10_COLOUR_BANDS = [(50.0, "red"), (30.0, "orange"), (20.0, "yellow")]
PM10_COLOUR_DEFAULT = "green"

# --- fixed values: R2 quality bands (strictly greater than) ---------------
R2_BANDS = [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")]
R2_BAND_DEFAULT = "poor"

# --- fixed values: map defaults when a value is absent ---------------------
MAP_DEFAULT_PM10 = 25.0
MAP_DEFAULT_PM25 = 15.0
MAP_DEFAULT_NO2 = 20.0

# --- fixed values: model defaults -------------------------------------------
TRAINING_HOURS = 24
N_STEPS = 6
LASSO_ALPHA = 1.0
N_SPLITS = 3
TIME_FEATURES = ["hour_sin", "hour_cos", "day_sin", "day_cos"]
MODEL_NAME = "pollution_predictor"
MODEL_TYPE = "Lasso Regression with MultiOutput"
STAGE_PRODUCTION = "Production"
STAGE_NONE = "None"
METRIC_NAMES = ["mae", "mse", "rmse", "r2_score", "training_samples", "validation_samples"]

# --- fixed values: fetch defaults -------------------------------------------
SQUARE_SIDE_KM = 20.0
KM_PER_DEGREE = 111.0
CHUNK_HOURS = 24 * 7
TRAIN_CHUNKS = 2
PREDICT_WINDOW_HOURS = 48
AIR_LOOKBACK_MINUTES = 100
WEATHER_LOOKBACK_MINUTES = 60
TRAIN_EXTRA_ROWS = 10

# --- test bed: the five event types play the first five of the monitored stations ---
TESTBED_STATIONS = [(event, 100001 + i, lat, lon) for i, (event, (_, lat, lon)) in enumerate(
    zip(["click", "error", "purchase", "signup", "view"], REFERENCE_STATIONS))]
TESTBED_UNITS = "µg/m³"
