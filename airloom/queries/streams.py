"""Streaming jobs over ``events`` as a stream, compared with what the batch tables say."""

from datetime import timedelta

from pyspark.sql import functions as F

from airloom.operators.features import lags, rolling
from airloom.queries.base import READ, _columns, RAW, query, rounded, sr6
from airloom.queries.batch import _level_sql
from airloom.queries.windows import W, frame
from airloom.session import scratch
from airloom.streaming import jobs as S


def _events(t):
    return S.read_stream(t.spark, t.folder, t.events.schema, "ts", "events.parquet")


def _fed(t, rows, run, closed=False, shuffled=False):
    """Call ``run`` on a stream of the rows, which arrive in four parts: in time order, or dealt by a hash.

    Each run takes what has arrived, as one micro-batch of as many files as tasks have written. ``closed``:
    a heartbeat comes last.
    """
    landed = scratch(t.spark, "landed")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for week in range(4):
        last = week == 3
        if shuffled:
            part = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == week)
        else:
            part = rows.where((F.dayofmonth("ts") > 7 * week) & (F.lit(last) | (F.dayofmonth("ts") <= 7 * week + 7)))
        part.write.mode("append").parquet(landed)
        run(t.spark.readStream.schema(rows.schema).parquet(landed)).awaitTermination()
    if closed:
        S.heartbeat(t.spark, landed, rows.schema, "ts", _CLOSE)
        run(t.spark.readStream.schema(rows.schema).parquet(landed)).awaitTermination()


def _readings(t):
    return _events(t).selectExpr(*_columns(RAW))


def _ran(t, stream, mode="append"):
    """Run a stream to its end and read what it wrote, local times again."""
    target, checkpoint = scratch(t.spark, "stream"), scratch(t.spark, "checkpoint")
    S.start(stream, target, checkpoint, mode).awaitTermination()
    return _local(t.spark.read.schema(stream.schema).parquet(target))


def _ran_closed(t, rows, job):
    """``job`` on the rows in time order, closed by a heartbeat, and what it wrote, local times again."""
    target, checkpoint = scratch(t.spark, "stream"), scratch(t.spark, "checkpoint")
    made = []

    def run(stream):
        made.append(job(stream))
        return S.start(made[-1], target, checkpoint)

    _fed(t, rows, run, closed=True)
    return _local(t.spark.read.schema(made[-1].schema).parquet(target))


def _local(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


@query("st_ingest", "SELECT event_id, ts, value FROM events")
def _(t):
    target, checkpoint = scratch(t.spark, "stream"), scratch(t.spark, "checkpoint")
    S.st_ingest(_events(t).select("event_id", "ts", "value"), target, checkpoint).awaitTermination()
    return _local(t.spark.read.parquet(target))


_CLOSE = "2100-01-01"


@query("st_dedup", """SELECT city, ts, event_id, aqi FROM (SELECT *, row_number() OVER (PARTITION BY city, ts ORDER BY event_id DESC) AS n FROM
    (SELECT city, date_trunc('hour', ts) AS ts, event_id, aqi FROM {readings})) WHERE n = 1""")
def _(t):
    hourly = t.readings.select("city", F.date_trunc("hour", "ts").alias("ts"), "event_id", "aqi")
    return _ran_closed(t, hourly, lambda stream: S.st_dedup(stream, READ))


@query("st_rolling", f"""SELECT city, w AS start, w + INTERVAL 6 HOURS AS "end", {sr6('avg(pm10)', 'mean')}, count(pm10) AS n FROM
    (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 5 HOURS, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM {{readings}}) GROUP BY 1, 2""")
def _(t):
    return rounded(_ran_closed(t, t.readings.select("city", "ts", "pm10"), lambda stream: S.st_rolling(stream, READ, "pm10")), "mean")


@query("st_alert", f"SELECT event_id, ts, aqi, {_level_sql('aqi')} AS level FROM {{readings}} WHERE aqi >= 200")
def _(t):
    return _ran(t, S.st_alert(_readings(t), "aqi", "ts").select("event_id", "ts", "aqi", "level"))


_FEATURES = f"""SELECT event_id, lag(aqi, 24) OVER {W} AS aqi_lag_24h, {sr6('avg(aqi) OVER ' + frame('5 PRECEDING AND CURRENT ROW'), 'aqi_roll_mean_6h')}
    FROM {{readings}}"""


def _features(t, late=None):
    target, history, checkpoint = scratch(t.spark, "features"), scratch(t.spark, "history"), scratch(t.spark, "checkpoint")
    stages = [lambda w: lags(w, "aqi", [24]) | rolling(w, "aqi", [6], ["mean"])]
    _fed(t, t.readings, lambda stream: S.st_features(stream, READ, stages, history, target, checkpoint, late=late), shuffled=late is not None)
    out = S.features_table(t.spark, target, READ)
    return rounded(out.select("event_id", "aqi_lag_24h", "aqi_roll_mean_6h"), "aqi_roll_mean_6h")


query("st_features", _FEATURES)(lambda t: _features(t))
# Rows in any order: those that come late change the rows after them, which are emitted again.
query("st_features_late", _FEATURES)(lambda t: _features(t, timedelta(days=40)))


@query("st_online", """SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def _(t):
    from airloom.operators.ordered import Series

    target, checkpoint = scratch(t.spark, "online"), scratch(t.spark, "checkpoint")
    _fed(t, t.events, lambda stream: S.st_online(stream, Series(("user_id",), "ts", ("event_id",)), target, checkpoint))
    return _local(t.spark.read.parquet(target).select("user_id", "ts", "value"))


_HALVES = """(SELECT city, ts >= TIMESTAMP '2024-01-16' AS cur, aqi, pm10 FROM {readings})"""
_SIDES = """(SELECT city, cur, 'aqi' AS feature, aqi AS value FROM s WHERE aqi IS NOT NULL UNION ALL SELECT city, cur, 'pm10', pm10 FROM s)"""


@query("st_drift", f"""WITH s AS (SELECT * FROM {_HALVES}), l AS (SELECT * FROM {_SIDES}),
    d AS (SELECT city, feature, value, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM l GROUP BY ALL),
    f AS (SELECT *, abs(sum(r) OVER w / sum(r) OVER p - sum(c) OVER w / sum(c) OVER p) AS gap FROM d
        WINDOW w AS (PARTITION BY city, feature ORDER BY value), p AS (PARTITION BY city, feature)),
    k AS (SELECT city, feature, max(gap) > 0.1 AS hit FROM f GROUP BY ALL)
    SELECT city, count(*) AS total_features, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS drifted_features, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (hit), '') AS drifted_names,
        round(avg(CAST(hit AS INT)), 4) + 0.0 AS drift_ratio, CASE WHEN avg(CAST(hit AS INT)) > 0.3 THEN 'high_drift' WHEN max(hit) THEN 'moderate_drift' ELSE 'no_drift' END AS status
    FROM k GROUP BY city""")
def _(t):
    target = scratch(t.spark, "drift")
    reference = t.readings.where("ts < '2024-01-16'")
    S.st_drift(_readings(t).where("ts >= '2024-01-16'"), reference, ["aqi", "pm10"], target, scratch(t.spark, "checkpoint"), ["city"]).awaitTermination()
    return t.spark.read.parquet(target).drop("batch")
