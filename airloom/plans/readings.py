"""Raw readings to clean readings to features, as one lazy plan per table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.config import METADATA, CleaningSettings, FeatureSettings, Rule
from airloom.functions.advice import advisory
from airloom.operators.features import short_features
from airloom.operators.impute import handle_missing
from airloom.operators.latest import dedup_last
from airloom.operators.ordered import Layout, Series
from airloom.operators.outliers import cap
from airloom.operators.predicates import range_null
from airloom.operators.schema import coerce_numeric, infer_numeric, map_columns, parse_ts, typed_fill
from airloom.session import settled


def clean(
    raw: DataFrame,
    key: Sequence[str],
    ties: Sequence[str] = (),
    settings: CleaningSettings = CleaningSettings(),
    now: Column | None = None,
    chunk_rows: int | None = None,
    settle: bool = True,
    apart: Sequence[str] = (),
) -> DataFrame:
    """The seven steps in their fixed order: map, time, numbers, duplicates, ranges, fill, cap.

    Of rows with equal key and time the last by ``ties`` stays. Where a series may have several readings
    at one time, ``apart`` names what else tells them apart: only rows equal in that too are duplicates.
    Caps look at filled data. The table is written once between filling and capping, so the
    statistics of the caps do not run the earlier steps again, unless ``settle`` is off.
    """
    df = map_columns(raw, settings.aliases, keep=key)
    df = parse_ts(df, now=now)
    cols = infer_numeric(df, tuple(settings.rules), [*METADATA, *key, *ties])
    df = coerce_numeric(df, cols)
    series = Series(tuple(key), "timestamp", tuple(ties))
    if chunk_rows:
        series = series.cut_at(chunk_rows)
    df = dedup_last(df, replace(series, key=(*series.key, *apart)))
    rules = {c: settings.rules.get(c, Rule()) for c in cols}
    df = range_null(df, rules)
    df = handle_missing(df, series, cols)
    if settle:
        df = settled(df, "filled")
    return cap(df, key, {c: r for c, r in rules.items() if r != Rule()})


def gold(
    clean_readings: DataFrame,
    key: Sequence[str],
    settings: FeatureSettings = FeatureSettings(),
    fill: bool = True,
    layout: Layout | None = None,
) -> DataFrame:
    """Clean readings to the feature table; ``fill`` turns warm-up nulls into 0 and ''."""
    out = short_features(clean_readings, Series(tuple(key), "timestamp"), settings, layout)
    return typed_fill(out, skip=key) if fill else out


def level_profile(readings: DataFrame, key: Sequence[str], ts: str, value: str, rolling: str) -> DataFrame:
    """Rows and mean rolling value per series, hour of day and advisory level."""
    levelled = readings.withColumns({"hour_of_day": F.hour(ts), "level": advisory(value)["level"]})
    return levelled.groupBy(*key, "hour_of_day", "level").agg(
        F.count(F.lit(1)).alias("readings"), F.round(F.avg(rolling), 6).alias("mean_rolling")
    )
