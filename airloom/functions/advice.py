"""Index value to advisory level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.config import ALERT_BODY, ALERT_SUBJECT, BEYOND_LEVEL, LEVELS, UNKNOWN_LEVEL, AlertSettings
from airloom.functions.scalars import col


def level_table(spark, levels=LEVELS) -> DataFrame:
    """The advisory levels as a table: level, low, high, color, advice."""
    return spark.createDataFrame(levels, "level string, low int, high int, color string, advice string")


def advisory(aqi, levels=LEVELS) -> Column:
    """Struct of level, color, advice and the shown value, as one CASE on the rounded value.

    Rounding is half to even, so 50.5 is still Good. Values outside every level, negative ones
    too, get the advice for values beyond the scale.
    """
    value = col(aqi)
    rounded = F.bround(value, 0)

    def text(i: int, unknown: str, beyond: str) -> Column:
        out = F.when(value.isNull(), F.lit(unknown))
        for level in levels:
            out = out.when(rounded.between(level[1], level[2]), F.lit(level[i]))
        return out.otherwise(F.lit(beyond))

    return F.struct(
        text(0, UNKNOWN_LEVEL[0], BEYOND_LEVEL[0]).alias("level"),
        text(3, UNKNOWN_LEVEL[1], BEYOND_LEVEL[1]).alias("color"),
        text(4, UNKNOWN_LEVEL[2], BEYOND_LEVEL[2]).alias("advice"),
        F.bround(value, 1).alias("shown"),
    )


def alert_subject(aqi, level, place: Column) -> Column:
    """Subject line; the value is shown without decimals, half to even."""
    shown = F.bround(col(aqi), 0).cast("long")
    return F.format_string(ALERT_SUBJECT, place, shown, col(level))


def alert_body(aqi, level, advice, ts) -> Column:
    shown = F.bround(col(aqi), 0).cast("long")
    when = F.date_format(col(ts), "yyyy-MM-dd HH:mm")
    return F.format_string(ALERT_BODY, shown, col(level), col(advice), when)


def alerts(
    df: DataFrame, aqi: str, ts: str, settings: AlertSettings = AlertSettings(), place: str | None = None
) -> DataFrame:
    """The rows at or above the threshold, with rendered subject and body. Works on streams too.

    ``place`` is a column with each row's place; rows without one, and all rows if there is no such
    column, get the place of the settings.
    """
    where = F.lit(settings.place) if place is None else F.coalesce(F.col(place), F.lit(settings.place))
    found = advisory(aqi)
    keep = df.where(F.lit(settings.enabled) & (F.col(aqi) >= settings.threshold))
    return keep.withColumns({
        "level": found["level"],
        "subject": alert_subject(aqi, found["level"], where),
        "body": alert_body(aqi, found["level"], found["advice"], ts),
    })
