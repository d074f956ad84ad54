"""Registration, and the driver tables as readings."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators.ordered import Series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Chunk size of the ``*_cut`` queries: small enough that the check runs the split path.
CUT_ROWS = 300

RAW = """
    event_id, user_id, event_type AS city, ts,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS aqi,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 2 END AS pm25,
    value + 10 AS pm10,
    CAST(user_id % 40 AS DOUBLE) AS temperature,
    CAST(event_id % 100 AS DOUBLE) AS humidity
"""
HOURLY_SQL = """
    SELECT event_type AS city, date_trunc('hour', ts) AS ts,
           avg(value) AS aqi, max(value) AS pm25, min(value) AS pm10, min(event_id) AS event_id
    FROM events GROUP BY 1, 2
"""
READ = Series(("city",), "ts", ("event_id",))


class Tables:
    """The driver tables of one scale, and readings derived from ``events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        """Every event as a reading with some nulls; series is the event type."""
        return self.events.selectExpr(*[c for c in _columns(RAW)])

    @cached_property
    def hourly(self) -> DataFrame:
        """One reading per event type and hour, hours without events missing."""
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return self.events.groupBy(F.col("event_type").alias("city"), hour.alias("ts")).agg(
            F.avg("value").alias("aqi"),
            F.max("value").alias("pm25"),
            F.min("value").alias("pm10"),
            F.min("event_id").alias("event_id"),
        )


def _columns(text: str) -> list[str]:
    """Split a select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def query(name: str, sql: str | None = None):
    """Register ``make(tables)`` under ``name``; in ``sql``, {readings} and {hourly} are those tables."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            SQL[name] = filled(sql)
        return make

    return add


def filled(sql: str) -> str:
    return sql.replace("{readings}", f"(SELECT {RAW} FROM events)").replace("{hourly}", f"({HOURLY_SQL})")


# Means of two-digit values often end in a 5 just behind the rounded digits, where the last bit of
# a sum would choose the side. Both engines move such halves up by this much first.
NUDGE = 1e-10


def r6(value: Column | str) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + NUDGE, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def sr6(expr: str, name: str) -> str:
    """The same rounding in SQL; adding 0 turns a negative zero into zero."""
    return f"round({expr} + {NUDGE}, 6) + 0.0 AS {name}"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
