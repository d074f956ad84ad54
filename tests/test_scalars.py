"""Scalar functions, advice, schema, filters."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airloom.config import LEVELS, AlertSettings
from airloom.functions import scalars as S
from airloom.functions.advice import advisory, alerts, level_table
from airloom.operators import predicates as P
from airloom.operators import schema as M


def now():
    return F.lit("2026-07-01 10:00:00").cast("timestamp")


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("z")])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("aqi, level", [
    (25.0, "Good"), (50.5, "Good"), (51.5, "Moderate"), (75.0, "Moderate"), (100.5, "Moderate"),
    (125.0, "Unhealthy for Sensitive Groups"), (175.0, "Unhealthy"), (250.0, "Very Unhealthy"),
    (400.0, "Hazardous"), (500.4, "Hazardous"), (500.6, "Hazardous"), (560.0, "Hazardous"), (-5.0, "Hazardous"),
])
def test_levels(spark, aqi, level):
    got = one(spark, advisory("aqi"), aqi=aqi)
    assert got.level == level
    beyond = aqi < 0 or aqi > 500.5
    assert got.advice.startswith("Extreme") == beyond


def test_unknown_level(spark):
    got = spark.range(1).select(advisory(F.lit(None).cast("double")).alias("x")).first().x
    assert (got.level, got.color, got.shown) == ("Unknown", "gray", None)
    assert level_table(spark).count() == len(LEVELS)


def test_alerts(spark):
    df = spark.createDataFrame([(199.9, datetime(2026, 7, 1)), (200.0, datetime(2026, 7, 1)), (None, None)], "aqi double, ts timestamp")
    got = alerts(df, "aqi", "ts", AlertSettings(place="Islamabad")).collect()
    assert [r.subject for r in got] == ["⚠️ AQI ALERT — Islamabad AQI: 200 (Unhealthy)"]
    assert "2026-07-01 00:00" in got[0].body
    assert alerts(df, "aqi", "ts", AlertSettings(enabled=False)).count() == 0


def test_calendar(spark):
    days = [datetime(2026, m, 4, 8) for m in range(1, 13)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    got = df.select(S.season("ts").alias("s"), S.day_of_week("ts").alias("d"), S.is_weekend("ts").alias("w"), S.is_rush_hour("ts").alias("r")).collect()
    assert [r.s for r in got] == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]
    assert [r.d for r in got] == [d.weekday() for d in days]
    assert all(r.w == (r.d >= 5) and r.r == 1 for r in got)


def test_numbers_and_text(spark):
    df = spark.createDataFrame([("1.5",), ("-",), ("nan",), (None,), ("2",)], "v string")
    assert [r[0] for r in df.select(S.number("v")).collect()] == [1.5, None, None, None, 2.0]
    assert [r[0] for r in df.select(S.number_text("v")).collect()] == ["1.5", "N/A", "N/A", "N/A", "2"]
    assert one(spark, S.number_text(F.lit(12.25))) == "12.2"
    assert one(spark, S.clamp_round(F.lit(50.25))) == 50.2 and one(spark, S.clamp_round(F.lit(-3.0))) == 0
    assert one(spark, S.clamp_round(F.lit(812.0))) == 500
    assert one(spark, S.bounded(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.time_text(F.lit(None).cast("timestamp"))) == "N/A"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=20))
def test_bounding_twice_changes_nothing(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    once = df.select(S.bounded("v", F.lit(-5.0), F.lit(5.0)).alias("v"))
    twice = once.select(S.bounded("v", F.lit(-5.0), F.lit(5.0)).alias("v"))
    assert once.collect() == twice.collect() == [(min(5.0, max(-5.0, v)),) for v in values]


def test_times(spark):
    at = datetime(2026, 7, 1, 10)
    df = spark.createDataFrame([(at - timedelta(hours=h) if h is not None else None,) for h in (1, 7, 30, None)], "ts timestamp")
    assert [r[0] for r in df.select(S.stale("ts", F.lit(True), now())).collect()] == [False, True, True, True]
    assert df.select(S.stale("ts", F.lit(False), now())).first()[0]
    assert [r[0] for r in df.select(S.fresh_time("ts", now())).collect()][2:] == [at, at]


def test_mapping(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "x")], "pm2_5 double, `hourly.temperature_2m` double, temp double, city string")
    with pytest.warns(UserWarning):
        assert M.map_columns(df, keep=["city"]).columns == ["pm25", "hourly.temperature_2m", "temperature", "city"]
    with pytest.warns(UserWarning):
        assert M.map_columns(df.drop("temp"), keep=["city"]).columns == ["pm25", "temperature", "city"]


def test_time_columns(spark):
    def frame(schema):
        return spark.createDataFrame([], schema)

    assert M.detect_ts(frame("a int, time string")) == "time"
    assert M.detect_ts(frame("a int, `Date` string")) == "Date"
    assert M.detect_ts(frame("a int, seen timestamp_ntz")) == "seen"
    assert M.detect_ts(frame("a int")) is None
    bad = spark.createDataFrame([("x",), ("y",)], "time string")
    assert M.parse_ts(bad).count() == 0
    assert [r.timestamp for r in M.parse_ts(bad, now=now()).collect()] == [datetime(2026, 7, 1, 10)] * 2
    assert M.parse_ts(spark.range(2), now=now()).count() == 2
    with pytest.raises(ValueError):
        M.parse_ts(spark.range(2))


def test_column_lists(spark):
    df = spark.createDataFrame([], "aqi string, pm25 double, n int, city string, aqi_change double, aqi_target_24h double")
    assert M.infer_numeric(df) == ["aqi", "pm25", "n", "aqi_change", "aqi_target_24h"]
    assert M.select_features(df) == ["pm25", "n"]
    assert M.missing_columns(df, ["aqi", "o3"]) == ["o3"]


def test_filters(spark):
    df = spark.createDataFrame([("a", 24), ("a", 36), ("b", None)], "k string, h int")
    good, bad = P.split_horizons(df, "h")
    assert good.count() == 1 and bad.count() == 2
    assert {r.k for r in P.min_rows_guard(df, ["k"], 2).collect()} == {"a"}


def test_pushdown_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    plan = P.lookback(df, "ts", 7, F.lit("2024-01-20").cast("timestamp_ntz"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]
