"""From landed payloads to the stored feature table, one run at a time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.config import FeatureSettings
from airloom.operators.joins import source_merge
from airloom.operators.ordered import Series, first_rows, join_back, same_key
from airloom.operators.features import short_features
from airloom.sources.payloads import json_hourly_asof, json_reading
from airloom.session import settled
from airloom.sources.tables import append_raw, read_table, upsert_features


def land(air: DataFrame, weather: DataFrame, payload: str, key: Sequence[str], now: Column, path: str) -> None:
    """Merge the readings of two feeds, one per key, and append them to the raw table.

    ``air`` and ``weather`` hold a payload per key; a key that only one feed has gets a partial reading.
    """
    readings = json_reading(air, payload, now, place=key[0]).drop(payload)
    current = json_hourly_asof(weather, payload, list(key), now)
    merged = source_merge(readings, current, key).withColumn("timestamp", F.coalesce("timestamp", now))
    append_raw(merged, path, "timestamp")


def refresh(
    clean_readings: DataFrame, since: Column, path: str, series: Series, partition: str,
    settings: FeatureSettings = FeatureSettings(), rows_back: int | None = None, reach: timedelta | None = None,
) -> DataFrame:
    """Recompute the features of rows from ``since`` on, and upsert only those; returns them.

    Frames count rows, so the last ``rows_back`` rows of each series before ``since`` are read, by
    default the longest frame and a day more. Where the readings have no holes they lie within
    ``reach`` (as many hours), and a run costs what is new; only for series with fewer rows there are
    older readings looked at.
    """
    back = rows_back or max(*settings.rolling, *settings.lags) + 25
    reach = F.lit(reach or timedelta(hours=back))
    ts = F.col(series.ts)
    new = settled(clean_readings.where(ts >= since), "new")
    near = clean_readings.where((ts >= since - reach) & (ts < since))
    near = settled(near.join(*_of_keys(near, new, series), "left_semi"), "near")
    counts = near.groupBy(*series.key).agg(F.count(F.lit(1)).alias("_n"))
    known = join_back(new.select(*series.key).distinct(), counts, series.key)
    short = settled(known.where(F.coalesce("_n", F.lit(0)) < back).drop("_n"), "short")
    before = near
    if short.count():
        older = clean_readings.where(ts < since - reach)
        older = older.join(*_of_keys(older, short, series), "left_semi")
        before = before.unionByName(first_rows(older, series.key, series.descending(), back))
    fresh = short_features(before.unionByName(new), series, settings).where(ts >= since)
    upsert_features(fresh, path, [*series.key, series.ts], partition)
    return fresh


def _of_keys(rows: DataFrame, keys: DataFrame, series: Series) -> tuple[DataFrame, Column]:
    """The different keys of ``keys`` under other names, and the condition that a row has one of them."""
    names = {k: f"_k{i}" for i, k in enumerate(series.key)}
    listed = keys.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    return listed, same_key(rows, listed, names)


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """The raw table with the columns of all runs."""
    return read_table(spark, path, merge=True)
