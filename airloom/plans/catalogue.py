"""Feature catalogue: what each feature is, where it comes from, what it needs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.config import FEATURE_GROUPS, FEATURE_TIERS, LongFeatureSettings
from airloom.functions.scalars import cyclical
from airloom.operators.features import LAGGED, ROLLED
from airloom.operators.ordered import first_rows

SCHEMA = (
    "name string, dtype string, category string, source string, low double, high double, "
    "dependencies array<string>, tags array<string>"
)

# Sensor features with source, range and tags.
SENSORS = [
    ("aqi", "raw_data", "aqicn_api", 0, 500, ["target", "primary", "air_quality"]),
    ("pm25", "raw_data", "aqicn_api", 0, 500, ["pollutant", "health", "primary"]),
    ("pm10", "raw_data", "aqicn_api", 0, 500, ["pollutant", "health"]),
    ("temperature", "meteorological", "open_meteo_api", -10, 55, ["weather", "meteorological"]),
    ("humidity", "meteorological", "open_meteo_api", 0, 100, ["weather", "meteorological"]),
    ("wind_speed", "meteorological", "open_meteo_api", 0, 30, ["weather", "dispersion"]),
]
# Range and tags of derived features by category; no range where none is published.
DERIVED = {
    "temporal": (["temporal", "categorical"], {"is_weekend": (0, 1), "is_rush_hour": (0, 1), "hour": (0, 23), "day_of_week": (0, 6), "month": (1, 12)}),
    "meteorological": (["derived", "meteorological"], {
        "temp_normalized": (-1, 1), "humidity_normalized": (-1, 1), "atmospheric_stability": (0, 1), "pm_ratio": (0, 1)}),
    "interaction": (["derived", "interaction", "nonlinear"], {
        "dispersion_factor": (0, 10), "aqi_momentum": (-50, 50), "temp_humidity_interaction": (-1, 1), "pm25_accumulation": (0, 1),
        "aqi_change_1h": (-100, 100), "aqi_change_6h": (-200, 200)}),
    "seasonal": (["time_series", "seasonal", "decomposition"], {
        "aqi_trend": (-100, 100), "aqi_seasonal": (-50, 50), "aqi_trend_simple": (None, None)}),
}

#: What each derived feature is computed from; calendar features only need the time.
INPUTS = {
    "temp_normalized": ["temperature"], "humidity_normalized": ["humidity"], "atmospheric_stability": ["temperature", "humidity"],
    "pm_ratio": ["pm25", "pm10"], "dispersion_factor": ["temperature", "humidity"], "aqi_momentum": ["aqi"],
    "temp_humidity_interaction": ["temperature", "humidity"], "pm25_accumulation": ["pm25"], "aqi_change_1h": ["aqi"],
    "aqi_change_6h": ["aqi"], "aqi_trend": ["aqi"], "aqi_seasonal": ["aqi"], "aqi_trend_simple": ["aqi"],
}


def catalogue(spark: SparkSession, settings: LongFeatureSettings = LongFeatureSettings()) -> DataFrame:
    """The sensor readings and every feature that ``long_features`` makes of them with these settings."""
    rows = [(n, "float", cat, src, float(lo), float(hi), [], tags) for n, cat, src, lo, hi, tags in SENSORS]

    def add(name, category, tags, inputs=(), bounds=(None, None), kind="float"):
        low, high = (None if b is None else float(b) for b in bounds)
        rows.append((name, kind, category, "computed", low, high, list(inputs), tags))

    for column in LAGGED:
        for hours in settings.lags:
            add(f"{column}_lag_{hours}h", "lag_features", ["temporal", "autoregressive", f"lag_{hours}h"] if column == "aqi" else ["temporal", "pollutant"], [column])
    for column, stats in ROLLED.items():
        for hours, stat in product(settings.rolling, stats):
            add(f"{column}_rolling_{stat}_{hours}h", "rolling_stats", ["rolling", "statistical", f"window_{hours}h"], [column])
    for name in cyclical("timestamp"):
        add(name, "cyclical", ["temporal", "cyclical", "periodic"], bounds=(-1, 1))
    for category, (tags, features) in DERIVED.items():
        for name, bounds in features.items():
            add(name, category, tags, INPUTS.get(name, ()), bounds, "int" if category == "temporal" else "float")
    return spark.createDataFrame(rows, SCHEMA)


def catalogue_register(known: DataFrame, new: DataFrame, name: str = "name", order: Sequence[str] = ()) -> DataFrame:
    """Definitions by name, a new one replaces the old.

    Of several new ones the last by ``order`` stays, of equal ones the last by all columns.
    """
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("_new", name, *order)]
    ranked = [F.col("_new").desc(), *[F.col(c).desc() for c in order], *[F.to_json(F.struct(c)).desc() for c in rest]]
    return first_rows(both, [name], ranked).drop("_new")


def get_feature(known: DataFrame, name: str) -> DataFrame:
    return known.where(F.col("name") == name)


def catalogue_stats(known: DataFrame) -> DataFrame:
    """Number of features per category and source."""
    return known.groupBy("category", "source").agg(F.count(F.lit(1)).alias("features"))


def by_category(known: DataFrame, category: str) -> DataFrame:
    return known.where(F.col("category") == category)


def by_tag(known: DataFrame, tag: str) -> DataFrame:
    return known.where(F.array_contains("tags", tag))


def feature_groups(spark: SparkSession) -> DataFrame:
    """feature, group, tier: the named groups and the expected importance."""
    groups = {f: g for g, fs in FEATURE_GROUPS.items() for f in fs}
    tiers = {f: t for t, fs in FEATURE_TIERS.items() for f in fs}
    names = [*groups, *[f for f in tiers if f not in groups]]
    return spark.createDataFrame([(f, groups.get(f), tiers.get(f)) for f in names], "feature string, group string, tier string")


def with_groups(ranked: DataFrame, groups: DataFrame, column: str = "feature") -> DataFrame:
    """Group and tier beside each ranked feature."""
    return ranked.join(groups, column, "left")


# The columns of the stored feature view and their types.
VIEW_SCHEMA = {
    **{c: "double" for c in ("aqi", "pm25", "pm10", "o3", "no2", "so2", "co", "temperature", "humidity", "pressure", "wind_speed")},
    **{c: "string" for c in ("dominant_pollutant", "station_name", "time", "ingestion_timestamp")},
    **{c: "int" for c in ("hour", "day_of_week", "day_of_month", "month", "is_weekend", "season")},
    **{c: "double" for c in ("hour_sin", "hour_cos", "month_sin", "month_cos")},
    **{f"{c}_roll_{s}_{h}h": "double" for c in ("aqi", "pm25", "pm10") for h in (6, 12, 24) for s in ("mean", "std")},
    **{f"aqi_lag_{h}h": "double" for h in (1, 3, 6, 12, 24)},
    **{c: "double" for c in ("aqi_change", "aqi_pct_change", "pm25_pm10_ratio", "o3_no2_ratio")},
}


def as_view(features: DataFrame, key: Sequence[str] = ("city",), ts: str = "timestamp") -> DataFrame:
    """Exactly the columns of the feature view, missing ones null, all cast to their types."""
    have = set(features.columns)
    cols = [
        (F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in VIEW_SCHEMA.items()
    ]
    return features.select(*key, F.col(ts), *cols)
