"""Landed JSON payloads to flat readings.

Payloads are text columns; a field is looked up along its alias paths, first hit wins. A path may
also be a literal key with dots in it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.config import ALIASES, METADATA
from airloom.functions.scalars import default_text, fresh_time, number


def json_path(dotted: str) -> str:
    return "$" + "".join(f"['{part}']" for part in dotted.split("."))


def resolve_path(payload: Column, paths: Sequence[str], kind: str = "string") -> Column:
    """The first non-null value among dotted ``paths`` of a VARIANT, as ``kind``."""
    return F.coalesce(*[F.try_variant_get(payload, json_path(p), kind) for p in paths])


def parsed(payload: Column | str) -> Column:
    """Text to VARIANT; broken text to null."""
    return F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)


def json_reading(
    df: DataFrame,
    payload: str,
    now: Column | None = None,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    station: str = "Islamabad",
    status: str | None = "ok",
    place: str | None = None,
) -> DataFrame:
    """Nested air-quality payloads to standard readings.

    Payloads with another ``status`` are dropped (``status=None`` keeps all). The index is cut to
    a whole number, ``-`` and unreadable values are null. Times are UTC; with ``now`` given, times
    that are missing, unreadable or a day old become ``now``. A payload without a station name gets
    that of the column ``place`` or else ``station``.
    """
    # As a generated column the parsed payload is made once; a filter on it cannot move below it.
    out = df.select("*", F.explode(F.array(parsed(payload))).alias("_v"))
    if status is not None:
        out = out.where(resolve_path(F.col("_v"), ["status"]) == status)
    texts = [c for c in aliases if c in METADATA]
    made = {c: resolve_path(F.col("_v"), aliases[c]) for c in texts if c != "timestamp"}
    made |= {c: number(resolve_path(F.col("_v"), p)) for c, p in aliases.items() if c not in texts}
    ts = resolve_path(F.col("_v"), aliases.get("timestamp", ["timestamp"])).try_cast("timestamp")
    made["timestamp"] = ts if now is None else fresh_time(ts, now)
    out = out.withColumns(made).drop("_v")
    final = {}
    if "aqi" in made:
        final["aqi"] = F.when(F.col("aqi") < 0, F.ceil("aqi")).otherwise(F.floor("aqi")).cast("double")
    if "dominant_pollutant" in made:
        final["dominant_pollutant"] = default_text("dominant_pollutant", "unknown")
    if "station_name" in made:
        known = F.coalesce("station_name", F.col(place)) if place else F.col("station_name")
        final["station_name"] = default_text(known, station)
    return out.withColumns(final)


HOURLY = "hourly struct<time array<string>, temperature_2m array<double>, relativehumidity_2m array<double>, windspeed_10m array<double>, surface_pressure array<double>>"

# Feed name of each weather column.
WEATHER = {
    "temperature": "temperature_2m",
    "humidity": "relativehumidity_2m",
    "wind_speed": "windspeed_10m",
    "pressure": "surface_pressure",
}


def json_hourly_explode(df: DataFrame, payload: str, keep: Sequence[str], schema: str = HOURLY, names=WEATHER) -> DataFrame:
    """Parallel hourly arrays to one row per listed hour; arrays that are too short give nulls."""
    hourly = F.from_json(payload, schema)["hourly"]
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(hourly["time"].alias("time"), *[F.coalesce(hourly[f], none).alias(f) for f in names.values()])
    out = df.select(*keep, F.posexplode(zipped).alias("place", "_one"))
    out = out.where(F.col("_one.time").isNotNull())
    return out.select(
        *keep, "place", F.col("_one.time").try_cast("timestamp").alias("timestamp"), *[F.col(f"_one.{f}").alias(c) for c, f in names.items()]
    )


def json_hourly_asof(df: DataFrame, payload: str, keep: Sequence[str], now: Column, schema: str = HOURLY, names=WEATHER) -> DataFrame:
    """Parallel hourly arrays to the reading of the last listed hour not after ``now``.

    When no hour qualifies, the last element counts. Each payload is handled inside its own row,
    so nothing is exploded or shuffled.
    """
    hourly = F.from_json(payload, schema)["hourly"]
    past = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(hourly["time"]), F.lit(1))),
        lambda i: F.try_element_at(hourly["time"], i).try_cast("timestamp") <= now,
    )
    out = df.withColumn("_h", hourly).where(F.size("_h.time") > 0)
    out = out.withColumn("_i", F.when(F.size(past) > 0, F.array_max(past)).otherwise(-1))
    return out.select(*keep, *[F.try_element_at(F.col(f"_h.{f}"), F.col("_i")).alias(c) for c, f in names.items()])
