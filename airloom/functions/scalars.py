"""Calendar, ratio and formatting functions on single rows."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom.config import AQI_RANGE, RUSH_HOURS, STALE_HOURS


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hour(ts):
    return F.hour(col(ts))


def day_of_week(ts):
    """Monday is 0."""
    return F.weekday(col(ts))


def day_of_month(ts):
    return F.dayofmonth(col(ts))


def month(ts):
    return F.month(col(ts))


def day_of_year(ts):
    return F.dayofyear(col(ts))


def is_weekend(ts):
    return (day_of_week(ts) >= 5).cast("int")


def season(ts):
    """1 from December, then 2, 3, 4 for each following quarter."""
    return F.floor((month(ts) % 12) / 3).cast("int") + 1


def is_rush_hour(ts):
    return hour(ts).isin(RUSH_HOURS).cast("int")


def turn(value, period: int) -> tuple[Column, Column]:
    """Sine and cosine of the place of ``value`` on a circle of ``period``."""
    angle = col(value) * (2 * pi) / period
    return F.sin(angle), F.cos(angle)


def cyclical(ts) -> dict[str, Column]:
    made = {}
    for name, value, period in (("hour", hour(ts), 24), ("day", day_of_week(ts), 7), ("month", month(ts), 12)):
        made[f"{name}_sin"], made[f"{name}_cos"] = turn(value, period)
    return made


def ratio(top, bottom):
    """Null where the denominator is 0."""
    return F.try_divide(col(top), col(bottom))


def pm_ratio(pm25, pm10):
    return F.try_divide(col(pm25), col(pm10) + 1e-8)


def stability(temperature, humidity):
    return F.try_divide(100 - col(temperature), col(humidity) + 1)


def dispersion(temperature, humidity):
    return col(temperature) * (100 - col(humidity)) / 1000


def temp_humidity(temperature, humidity):
    return col(temperature) * col(humidity) / 100


def standard_score(value, mean, deviation):
    return (col(value) - mean) / (deviation + 1e-8)


def number(value):
    """Text or number to DOUBLE; anything unreadable, and NaN, becomes null."""
    return F.nanvl(col(value).try_cast("double"), F.lit(None).cast("double"))


def bounded(value, low, high):
    """Clip; a null value or bound leaves the value as it is."""
    c = col(value)
    raised = F.when(c < low, low).otherwise(c)
    return F.when(raised > high, high).otherwise(raised)


def clamp_round(prediction):
    """A prediction as it is shown: inside the index range, one decimal, half to even."""
    return F.bround(bounded(prediction, F.lit(AQI_RANGE[0]), F.lit(AQI_RANGE[1])), 1)


def number_text(value, decimals: int = 1):
    """Whole numbers without decimals, others with ``decimals`` (half to even), null as ``N/A``."""
    c = number(value)
    whole = F.abs(c - F.rint(c)) < 1e-9
    return (
        F.when(c.isNull(), F.lit("N/A"))
        .when(whole, F.rint(c).cast("long").cast("string"))
        .otherwise(F.format_string(f"%.{decimals}f", F.bround(c, decimals)))
    )


def time_text(ts):
    """The first 19 characters, null as ``N/A``."""
    return F.coalesce(F.substring(col(ts).cast("string"), 1, 19), F.lit("N/A"))


def default_text(value, default: str):
    """Null and empty text become ``default``."""
    return F.coalesce(F.nullif(col(value), F.lit("")), F.lit(default))


def hours_between(start, end):
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / 3_600_000_000


def stale(ts, fetched, now: Column):
    """True when the fetch failed, the time is missing, or the reading is older than six hours."""
    old = col(ts) < now - F.expr(f"INTERVAL {STALE_HOURS} HOURS")
    return ~F.coalesce(col(fetched), F.lit(False)) | F.coalesce(old, F.lit(True))


def fresh_time(ts, now: Column, hours: int = 24):
    """``ts``, or ``now`` where it is missing or more than ``hours`` old."""
    c = col(ts)
    return F.when(c < now - F.expr(f"INTERVAL {hours} HOURS"), now).otherwise(F.coalesce(c, now))
