"""Fixed values of the sensor domain, and the settings built from them.

Everything in the upper part has to equal the published values for results to match: column
aliases, cleaning bounds, advisory levels, thresholds, window lengths.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------------------------

ALIASES = {
    "timestamp": ["timestamp", "time", "dt", "datetime", "data.time.iso"],
    "aqi": ["aqi", "data.aqi"],
    "dominant_pollutant": ["dominant_pollutant", "data.dominentpol", "dominentpol"],
    "pm25": ["pm25", "data.iaqi.pm25.v", "iaqi.pm25.v", "pm2_5"],
    "pm10": ["pm10", "data.iaqi.pm10.v", "iaqi.pm10.v", "pm10_v"],
    "o3": ["o3", "data.iaqi.o3.v", "iaqi.o3.v", "o3_v"],
    "no2": ["no2", "data.iaqi.no2.v", "iaqi.no2.v", "no2_v"],
    "so2": ["so2", "data.iaqi.so2.v", "iaqi.so2.v", "so2_v"],
    "co": ["co", "data.iaqi.co.v", "iaqi.co.v", "co_v"],
    "station_name": ["station_name", "data.city.name", "city.name", "city"],
    "time": ["time", "hourly.time"],
    "temperature": ["temperature", "temperature_2m", "temp", "hourly.temperature_2m"],
    "humidity": ["humidity", "relativehumidity_2m", "relative_humidity", "hourly.relativehumidity_2m"],
    "pressure": ["pressure", "surface_pressure", "barometer", "hourly.surface_pressure"],
    "wind_speed": ["wind_speed", "windspeed_10m", "wind", "hourly.windspeed_10m"],
}
TIMESTAMP_NAMES = ["timestamp", "time", "date", "datetime", "dt", "ts", "ingestion_timestamp"]
METADATA = ["timestamp", "station_name", "time", "ingestion_timestamp", "dominant_pollutant", "city"]

# level, lowest and highest rounded value, colour, advice
LEVELS = [
    ("Good", 0, 50, "green", "Air quality is satisfactory. Enjoy outdoor activities."),
    ("Moderate", 51, 100, "yellow",
     "Acceptable. Sensitive individuals should reduce prolonged outdoor exertion."),
    ("Unhealthy for Sensitive Groups", 101, 150, "orange",
     "Wear masks outdoors. Reduce prolonged outdoor exertion."),
    ("Unhealthy", 151, 200, "red",
     "Everyone may experience health effects. Avoid prolonged outdoor exertion."),
    ("Very Unhealthy", 201, 300, "purple",
     "Health alert: Avoid all outdoor activities. Stay indoors."),
    ("Hazardous", 301, 500, "maroon",
     "Health emergency: Stay indoors, seal windows, use air purifiers."),
]
UNKNOWN_LEVEL = ("Unknown", "gray", "AQI data unavailable. Exercise caution.")
BEYOND_LEVEL = ("Hazardous", "maroon", "Extreme hazard: Stay indoors with air filtration.")

# place, rounded value, level
ALERT_SUBJECT = "⚠️ AQI ALERT — %s AQI: %d (%s)"
# rounded value, level, advice, time
ALERT_BODY = "Current AQI: %d\nRisk Level: %s\nAdvisory: %s\nTimestamp: %s"

ROLLING_HOURS = [6, 12, 24]
LAG_HOURS = [1, 3, 6, 12, 24]
LONG_ROLLING_HOURS = [3, 6, 24]
LONG_LAG_HOURS = [1, 2, 6, 24, 48, 168]
SEASON_ROWS = 24
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
HORIZONS = [24, 48, 72]
TEST_SHARE = 0.2
TTL_HOURS = 72
AQI_RANGE = (0.0, 500.0)

MIN_TRAIN_ROWS = 50
MIN_DRIFT_ROWS = 30
MIN_VALID_ROWS = 5000
KS_LIMIT = 0.1
HIGH_DRIFT = 0.3
ALERT_AQI = 200.0
STALE_HOURS = 6
FRESH_HOURS = 24
FILL_LIMIT = 3
NEIGHBOURS = 5
MISSING_LIMIT = 10.0
GAP_LIMIT = 20.0
OUTLIER_FACTOR = 3.0
OUTLIER_LIMIT = 5.0
TAIL_ROWS = 500
SAMPLE_ROWS = 100
LOG_ROWS = 100

# Retrieval groups and importance tiers of the long feature set.
FEATURE_GROUPS = {
    "lag_features": [f"aqi_lag_{h}h" for h in LONG_LAG_HOURS],
    "rolling_mean": [f"aqi_rolling_mean_{h}h" for h in LONG_ROLLING_HOURS],
    "rolling_volatility": [f"aqi_rolling_std_{h}h" for h in LONG_ROLLING_HOURS],
    "cyclical": ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"],
    "temporal_binary": ["is_weekend", "is_rush_hour"],
    "meteorological": ["temp_normalized", "humidity_normalized", "atmospheric_stability", "pm_ratio"],
    "interactions": ["dispersion_factor", "aqi_momentum", "temp_humidity_interaction",
                     "pm25_accumulation", "aqi_change_1h", "aqi_change_6h"],
}
FEATURE_TIERS = {
    "critical": ["aqi_lag_24h", "aqi_rolling_mean_24h", "hour_sin", "hour_cos", "is_rush_hour",
                 "pm25_lag_24h"],
    "high_impact": ["aqi_lag_6h", "aqi_rolling_mean_6h", "temperature", "humidity",
                    "atmospheric_stability", "dispersion_factor"],
    "moderate": ["aqi_lag_2h", "aqi_lag_48h", "pm25_rolling_mean_24h", "day_sin", "day_cos",
                 "aqi_momentum", "temp_normalized"],
    "exploratory": ["month_sin", "month_cos", "pm_ratio", "pm25_accumulation"],
}

# --- Settings ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """How one column is cleaned: allowed range, and the cap applied after filling."""

    cap: str = "clip"
    low: float | None = None
    high: float | None = None
    deviations: float = 3.0


# Cleaning bounds and caps per column.
RULES = {
    "aqi": Rule("iqr", 0, 500),
    "pm25": Rule("iqr", 0, 1000),
    "pm10": Rule("iqr", 0, 1000),
    "o3": Rule("iqr", 0, 600),
    "no2": Rule("iqr", 0, 500),
    "so2": Rule("iqr", 0, 500),
    "co": Rule("iqr", 0, 200),
    "temperature": Rule("zscore", -10, 55, 3.0),
    "humidity": Rule("clip", 0, 100),
    "pressure": Rule("clip", 870, 1085),
    "wind_speed": Rule("clip", 0, 80),
}


@dataclass(frozen=True)
class FeatureSettings:
    """Row counts of the short feature set."""

    targets: tuple[str, ...] = ("aqi", "pm25", "pm10")
    rolling: tuple[int, ...] = tuple(ROLLING_HOURS)
    lags: tuple[int, ...] = tuple(LAG_HOURS)


@dataclass(frozen=True)
class LongFeatureSettings:
    """Row counts of the long feature set. ``backfill`` copies later values into the warm-up rows."""

    rolling: tuple[int, ...] = tuple(LONG_ROLLING_HOURS)
    lags: tuple[int, ...] = tuple(LONG_LAG_HOURS)
    season_rows: int = SEASON_ROWS
    seasonal: bool = True
    backfill: bool = False


@dataclass(frozen=True)
class AlertSettings:
    enabled: bool = True
    threshold: float = ALERT_AQI
    place: str = "city"


@dataclass(frozen=True)
class CleaningSettings:
    rules: dict[str, Rule] = field(default_factory=lambda: dict(RULES))
    aliases: dict[str, list[str]] = field(default_factory=lambda: dict(ALIASES))
