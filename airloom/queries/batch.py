"""Projection, coercion, filters and scalar functions."""

from pyspark.sql import functions as F

from airloom.config import LEVELS, AlertSettings, Rule
from airloom.functions import scalars as S
from airloom.functions.advice import advisory, alert_subject, alerts
from airloom.operators import predicates as P
from airloom.operators import schema as M
from airloom.queries.base import ntz, query, r6, rounded, sr6
from airloom.sources.payloads import parsed, resolve_path

NOW = "2024-01-20 12:00:00"

# --- schema, projection, coercion --------------------------------------------------------------


@query("map_columns", "SELECT event_id, city, ts AS timestamp, value AS pm25, k AS temperature FROM "
       "(SELECT event_id, event_type AS city, ts, value, user_id AS k FROM events)")
def _(t):
    raw = t.events.selectExpr("event_id", "event_type AS city", "ts AS dt", "value AS pm2_5", "user_id AS `hourly.temperature_2m`")
    return M.map_columns(raw, keep=["city"])


@query("resolve_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS pm25, NULL::DOUBLE AS temperature FROM events")
def _(t):
    v = parsed("props")
    return t.events.select(
        "event_id",
        resolve_path(v, ["data.iaqi.pm25.v", "k"], "double").alias("pm25"),
        resolve_path(v, ["temp", "hourly.temperature_2m"], "double").alias("temperature"),
    )


@query("parse_ts", "SELECT event_id, ts AS timestamp FROM events WHERE event_id % 5 <> 0")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    out = M.parse_ts(t.events.select("event_id", text.alias("time")))
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("stale_ts", f"""SELECT event_id,
    CASE WHEN t IS NULL OR t < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS THEN TIMESTAMP '{NOW}' ELSE t END AS resolved
    FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS t FROM events)""")
def _(t):
    ts = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return t.events.select("event_id", S.fresh_time(ts, ntz(NOW)).alias("resolved"))


@query("coerce_numeric", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS aqi,
    CAST(user_id AS DOUBLE) AS pm25 FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 9 == 0, F.lit("-")).otherwise(F.col("value").cast("string"))
    return M.coerce_numeric(t.events.select("event_id", text.alias("aqi"), F.col("user_id").cast("string").alias("pm25")), ["aqi", "pm25"])


@query("default_fill", """SELECT event_id, CASE WHEN event_type = 'click' OR event_type = 'view' THEN 'unknown' ELSE event_type END
    AS dominant_pollutant FROM events""")
def _(t):
    kind = F.col("event_type")
    raw = F.when(kind == "click", F.lit("")).when(kind != "view", kind)
    return t.events.select("event_id", S.default_text(raw, "unknown").alias("dominant_pollutant"))


@query("typed_fill", """SELECT event_id, coalesce(aqi, 0) AS aqi, coalesce(pm25, 0) AS pm25,
    CASE WHEN city = 'view' THEN '' ELSE city END AS station FROM {readings}""")
def _(t):
    station = F.when(F.col("city") != "view", F.col("city"))
    return M.typed_fill(t.readings.select("event_id", "aqi", "pm25", station.alias("station")))


@query("add_entity", "SELECT event_id, ts, 'islamabad' AS city FROM events")
def _(t):
    out = M.add_entity(t.events.select("event_id", "ts"), "city", "islamabad", "ts")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("split_raw_cols", "SELECT ts, aqi, pm25, pm10 FROM {readings}")
def _(t):
    return M.split_raw_cols(t.readings, ["ts", "aqi", "pm25", "pm10", "o3"])[0]


@query("infer_numeric", "SELECT aqi, pm25, pm10, temperature, humidity FROM {readings}")
def _(t):
    return t.readings.select(*M.infer_numeric(t.readings.drop("event_id", "user_id")))


@query("detect_ts", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events")
def _(t):
    c = M.detect_ts(t.events)
    return t.events.agg(F.min(c).alias("first_ts"), F.max(c).alias("last_ts"), F.count(F.lit(1)).alias("n"))


# --- filters -----------------------------------------------------------------------------------


@query("range_null", """SELECT event_id, CASE WHEN value BETWEEN 0 AND 100 THEN value END AS aqi,
    CASE WHEN user_id <= 50 THEN CAST(user_id AS DOUBLE) END AS pm25 FROM events""")
def _(t):
    df = t.events.select("event_id", F.col("value").alias("aqi"), F.col("user_id").cast("double").alias("pm25"))
    return P.range_null(df, {"aqi": Rule("iqr", 0, 100), "pm25": Rule("clip", None, 50), "o3": Rule()})


@query("lookback", f"SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS")
def _(t):
    return P.lookback(t.events.select("event_id", "ts", "value"), "ts", 7, ntz(NOW))


@query("any_not_null", "SELECT event_id, aqi, pm25 FROM {readings} WHERE aqi IS NOT NULL OR pm25 IS NOT NULL")
def _(t):
    return P.any_not_null(t.readings.select("event_id", "aqi", "pm25"), ["aqi", "pm25"])


@query("chart_series", "SELECT ts, aqi FROM {readings} WHERE aqi IS NOT NULL")
def _(t):
    return P.chart_series(t.readings.withColumn("aqi", F.col("aqi").cast("string")), "ts", "aqi")


def _level_sql(value: str) -> str:
    cases = " ".join(f"WHEN round_even({value}, 0) BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi, _, _ in LEVELS)
    return f"CASE WHEN {value} IS NULL THEN 'Unknown' {cases} ELSE 'Hazardous' END"


@query("alert_filter", f"""SELECT event_id, aqi, {_level_sql('aqi')} AS level,
    '⚠️ AQI ALERT — Islamabad AQI: ' || CAST(round_even(aqi, 0) AS BIGINT) || ' (' || {_level_sql('aqi')} || ')' AS subject
    FROM (SELECT event_id, value AS aqi FROM events) WHERE aqi >= 200""")
def _(t):
    df = t.events.select("event_id", "ts", F.col("value").alias("aqi"))
    return alerts(df, "aqi", "ts", AlertSettings(place="Islamabad")).select("event_id", "aqi", "level", "subject")


@query("stale_flag", f"""SELECT event_id, (NOT fetched) OR t IS NULL OR t < TIMESTAMP '{NOW}' - INTERVAL 6 HOURS AS is_stale
    FROM (SELECT event_id, event_type <> 'error' AS fetched, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS t FROM events)""")
def _(t):
    ts = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return t.events.select("event_id", S.stale(ts, F.col("event_type") != "error", ntz(NOW)).alias("is_stale"))


@query("min_rows_guard", """SELECT event_id, user_id FROM events WHERE user_id IN
    (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 50)""")
def _(t):
    return P.min_rows_guard(t.events.select("event_id", "user_id"), ["user_id"], 50)


_HORIZON = "CASE event_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 WHEN 2 THEN 72 ELSE 36 END"


@query("valid_horizon", f"SELECT event_id, h FROM (SELECT event_id, {_HORIZON} AS h FROM events) WHERE h NOT IN (24, 48, 72)")
def _(t):
    return P.split_horizons(t.events.selectExpr("event_id", f"{_HORIZON} AS h"), "h")[1]


# --- scalar functions --------------------------------------------------------------------------


@query("time_parts", """SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
    CAST(day(ts) AS INT) AS day_of_month, CAST(month(ts) AS INT) AS month, CAST(dayofyear(ts) AS INT) AS day_of_year FROM events""")
def _(t):
    return t.events.select(
        "event_id", S.hour("ts").alias("hour"), S.day_of_week("ts").alias("day_of_week"),
        S.day_of_month("ts").alias("day_of_month"), S.month("ts").alias("month"), S.day_of_year("ts").alias("day_of_year"),
    )


@query("is_weekend", "SELECT event_id, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM events")
def _(t):
    return t.events.select("event_id", S.is_weekend("ts").alias("is_weekend"))


@query("season", """SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1 WHEN month(o_orderdate) <= 5 THEN 2
    WHEN month(o_orderdate) <= 8 THEN 3 ELSE 4 END AS INT) AS season FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.season("o_orderdate").alias("season"))


def _wave(name, value, period):
    return ", ".join(sr6(f"{f}(2 * pi() * ({value}) / {period})", f"{name}_{f}") for f in ("sin", "cos"))


@query("cyclical", f"SELECT event_id, {_wave('hour', 'hour(ts)', 24)}, {_wave('day', 'isodow(ts) - 1', 7)}, "
       f"{_wave('month', 'month(ts)', 12)} FROM events")
def _(t):
    return t.events.select("event_id", *[r6(c).alias(n) for n, c in S.cyclical("ts").items()])


@query("is_rush_hour", "SELECT event_id, CAST(hour(ts) IN (7, 8, 9, 17, 18, 19) AS INT) AS is_rush_hour FROM events")
def _(t):
    return t.events.select("event_id", S.is_rush_hour("ts").alias("is_rush_hour"))


@query("ratios", f"""SELECT event_id, {sr6('aqi / nullif(pm25, 0)', 'ratio')}, {sr6('pm25 / (pm10 + 1e-8)', 'pm_ratio')}
    FROM {{readings}}""")
def _(t):
    return t.readings.select(
        "event_id", r6(S.ratio("aqi", "pm25")).alias("ratio"), r6(S.pm_ratio("pm25", "pm10")).alias("pm_ratio")
    )


@query("stability", f"SELECT event_id, {sr6('(100 - temperature) / (humidity + 1)', 'stability')} FROM {{readings}}")
def _(t):
    return t.readings.select("event_id", r6(S.stability("temperature", "humidity")).alias("stability"))


@query("dispersion", f"SELECT event_id, {sr6('temperature * (100 - humidity) / 1000', 'dispersion')} FROM {{readings}}")
def _(t):
    return t.readings.select("event_id", r6(S.dispersion("temperature", "humidity")).alias("dispersion"))


@query("temp_humidity", f"SELECT event_id, {sr6('temperature * humidity / 100', 'th')} FROM {{readings}}")
def _(t):
    return t.readings.select("event_id", r6(S.temp_humidity("temperature", "humidity")).alias("th"))


@query("clamp_round", """SELECT event_id, CAST(round_even(greatest(least(value * 2 - 50, 500), 0), 1) AS DOUBLE) + 0.0 AS prediction
    FROM events""")
def _(t):
    return t.events.select("event_id", S.clamp_round(F.col("value") * 2 - 50).alias("prediction"))


@query("number_format", """SELECT event_id, CASE WHEN v IS NULL THEN 'N/A' WHEN abs(v - round(v)) < 1e-9 THEN CAST(CAST(v AS BIGINT) AS VARCHAR)
    ELSE printf('%.1f', v) END AS shown, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value * 4) / 4 + 0.005 * (user_id % 2) END AS v FROM events)""")
def _(t):
    v = F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 4) / 4 + 0.005 * (F.col("user_id") % 2))
    return t.events.select("event_id", S.number_text(v, 1).alias("shown"), S.time_text("ts").alias("at"))


@query("alert_text", f"""SELECT event_id, '⚠️ AQI ALERT — ' || event_type || ' AQI: ' || CAST(round_even(value, 0) AS BIGINT) || ' ('
    || {_level_sql('value')} || ')' AS subject FROM events""")
def _(t):
    return t.events.select("event_id", alert_subject("value", advisory("value")["level"], F.col("event_type")).alias("subject"))
