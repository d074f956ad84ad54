"""Sources, sinks, snapshots, keyed tables, payloads, catalogue.

Queries that write go to a fresh path below the shared folder and read back what they wrote.
"""

from pyspark.sql import functions as F

from airloom.operators.features import short_features
from airloom.operators.ordered import Series
from airloom.plans import catalogue as C
from airloom.plans.ingest import refresh
from airloom.queries.base import ntz, query, rounded, sr6
from airloom.queries.joins import METRICS_SQL, _metrics, catalogue_of
from airloom.session import scratch, settled
from airloom.sources import payloads as J
from airloom.sources import tables as T

_BY_TIME = "(PARTITION BY city ORDER BY ts)"

# --- Parquet and CSV ---------------------------------------------------------------------------


@query("src_parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double"
    return T.read_table(t.spark, f"{t.folder}/orders.parquet", schema)


@query("snk_parquet", "SELECT event_id, ts, value, event_type FROM events")
def _(t):
    path = scratch(t.spark, "snk")
    T.write_table(t.events.select("event_id", "ts", "value", "event_type"), path, ["event_type"])
    return t.spark.read.parquet(path)


@query("append_raw", """SELECT event_id, ts, value, NULL::DOUBLE AS temperature FROM events WHERE event_type <> 'view'
    UNION ALL SELECT event_id, ts, NULL, temperature FROM {readings} WHERE city = 'view'""")
def _(t):
    path = scratch(t.spark, "raw")
    T.append_raw(t.events.where("event_type <> 'view'").select("event_id", "ts", "value"), path, "ts")
    late = t.readings.where("city = 'view'").select("event_id", F.col("ts").cast("string").alias("ts"), "temperature")
    T.append_raw(late, path, "ts")
    return T.read_table(t.spark, path, merge=True).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("append_union", """SELECT event_id, ts, value, NULL::DOUBLE AS temperature FROM events
    UNION ALL SELECT event_id, ts, NULL, temperature FROM {readings}""")
def _(t):
    late = t.readings.select("event_id", F.col("ts").cast("string").alias("ts"), "temperature")
    return T.appended(t.events.select("event_id", "ts", "value"), late, "ts")


@query("src_csv", "SELECT event_id, ts AS timestamp, value FROM events WHERE event_id % 50 <> 0")
def _(t):
    path = scratch(t.spark, "csv")
    text = F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("ts").cast("string"))
    t.events.select(F.col("event_id").alias("EVENT_ID"), text.alias("Timestamp"), F.col("value").alias("Value")).write.option("header", True).csv(path)
    out = T.read_csv(t.spark, path, schema="EVENT_ID long, Timestamp string, Value double")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# --- payloads ----------------------------------------------------------------------------------


@query("json_reading", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS aqi, 'unknown' AS dominant_pollutant, 'Islamabad' AS station_name,
    NULL::DOUBLE AS pm25 FROM events""")
def _(t):
    aliases = {"aqi": ["data.aqi", "k"], "pm25": ["data.iaqi.pm25.v"], "dominant_pollutant": ["data.dominentpol"],
               "station_name": ["data.city.name"], "timestamp": ["data.time.iso"]}
    out = J.json_reading(t.events, "props", aliases=aliases, status=None)
    return out.select("event_id", "aqi", "dominant_pollutant", "station_name", "pm25")


@query("json_nested", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE trunc(value) END AS aqi, value / 2 AS pm25, ts AS timestamp, event_type AS station_name,
    CASE WHEN event_type = 'click' THEN 'unknown' ELSE 'pm25' END AS dominant_pollutant FROM events WHERE event_type <> 'error'""")
def _(t):
    """The feed's nested shape, made from events: status, index as text, sub-values, station, time."""
    text = F.when(F.col("event_type") == "view", "-").otherwise(F.col("value").cast("string"))
    payload = F.to_json(F.struct(
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.struct(
            text.alias("aqi"),
            F.struct(F.struct((F.col("value") / 2).alias("v")).alias("pm25")).alias("iaqi"),
            F.when(F.col("event_type") != "click", F.lit("pm25")).otherwise("").alias("dominentpol"),
            F.struct(F.col("event_type").alias("name")).alias("city"),
            F.struct(F.concat(F.col("ts").cast("string"), F.lit("+00:00")).alias("iso")).alias("time"),
        ).alias("data"),
    ))
    out = J.json_reading(t.events.select("event_id", payload.alias("body")), "body")
    out = out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return out.select("event_id", "aqi", "pm25", "timestamp", "station_name", "dominant_pollutant")


def _daily(t):
    """One payload per city and day with parallel arrays of at most 24 hours."""
    rows = t.hourly.withColumn("day", F.to_date("ts"))
    hours = F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), "pm25", "pm10")))
    packed = rows.groupBy("city", "day").agg(hours.alias("h"))
    body = F.to_json(F.struct(F.struct(
        F.col("h.time").alias("time"), F.col("h.pm25").alias("temperature_2m"), F.col("h.pm10").alias("windspeed_10m")).alias("hourly")))
    return packed.select("city", "day", body.alias("body"))


@query("json_hourly_explode", "SELECT city, ts AS timestamp, pm25 AS temperature, pm10 AS wind_speed, NULL::DOUBLE AS humidity FROM {hourly}")
def _(t):
    out = J.json_hourly_explode(_daily(t), "body", ["city"])
    return out.select("city", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "temperature", "wind_speed", "humidity")


@query("json_hourly_asof", """SELECT city, CAST(ts AS DATE)::TIMESTAMP AS day,
    coalesce(arg_max(pm25, ts) FILTER (ts <= TIMESTAMP '2024-01-15 10:30:00'), arg_max(pm25, ts)) AS temperature FROM {hourly} GROUP BY 1, 2""")
def _(t):
    now = F.lit("2024-01-15 10:30:00").cast("timestamp")
    out = J.json_hourly_asof(_daily(t), "body", ["city", F.col("day").cast("timestamp_ntz").alias("day")], now)
    return out.select("city", "day", "temperature")


# --- snapshots and keyed tables ----------------------------------------------------------------


@query("snapshot_write", """SELECT '20240131T000000' AS version, count(*) AS rows, 4 AS columns, min(ts) AS min_ts, max(ts) AS max_ts,
    true AS same_when_repeated, true AS other_when_changed FROM events""")
def _(t):
    path = scratch(t.spark, "snap")
    rows = t.events.select("event_id", "ts", "event_type", "value")
    first = rows.agg(F.min("event_id")).first()[0]
    changed = rows.withColumn("value", F.when(F.col("event_id") == first, F.lit(-1.0)).otherwise(F.col("value")))
    versions = {"20240131T000000": rows, "20240201T000000": rows.repartition(7, "value"), "20240202T000000": changed}
    meta, again, other = (T.snapshot_write(df, path, version, "ts") for version, df in versions.items())
    for name, one in (("again", again), ("other", other)):
        meta = meta.join(F.broadcast(one.select(F.col("fingerprint").alias(name))), F.lit(True))
    same, differs = F.col("fingerprint") == F.col("again"), F.col("fingerprint") != F.col("other")
    return meta.withColumns({"same_when_repeated": same, "other_when_changed": differs}).drop("path", "fingerprint", "again", "other")


@query("snapshot_latest", """SELECT event_id, ts, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def _(t):
    path = scratch(t.spark, "snap")
    days = t.events.select("event_id", "ts", "value", F.date_format("ts", "yyyyMMdd").alias("version"))
    T.write_table(days.repartition("version"), f"{path}/data", ["version"])
    return T.read_latest(t.spark, path).drop("version")


@query("store_health", """SELECT count(*) AS versions, CAST(sum(n) AS BIGINT) AS rows, 'healthy' AS status, round(date_diff('second', max(m), TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 3) + 0.0 AS age_hours FROM
    (SELECT event_type, count(*) AS n, date_trunc('second', max(ts)) AS m FROM events GROUP BY 1)""")
def _(t):
    meta = t.events.groupBy(F.col("event_type").alias("version")).agg(
        F.count(F.lit(1)).alias("rows"), F.date_trunc("second", F.max("ts")).alias("max_ts"))
    out = T.store_health(meta, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("versions", "rows", "status", F.round("age_hours", 3).alias("age_hours"))


_UPSERT = """SELECT city, ts, pm25 FROM {hourly} WHERE city <> 'view' AND NOT (city = 'click' AND day(ts) >= 20)
    UNION ALL SELECT city, ts, pm25 + 1000 FROM {hourly} WHERE city = 'view' OR (city = 'click' AND day(ts) >= 20)"""


@query("upsert_features", _UPSERT)
def _(t):
    path = scratch(t.spark, "keyed")
    table = t.hourly.select("city", "ts", "pm25")
    T.upsert_features(table.where("city <> 'view'"), path, ["city", "ts"], "city")
    new = table.where("city = 'view' OR (city = 'click' AND day(ts) >= 20)").withColumn("pm25", F.col("pm25") + 1000)
    T.upsert_features(new, path, ["city", "ts"], "city")
    return T.read_keyed(t.spark, path, table.schema, "city").select("city", "ts", "pm25")


@query("upsert_plan", _UPSERT)
def _(t):
    table = t.hourly.select("city", "ts", "pm25")
    new = table.where("city = 'view' OR (city = 'click' AND day(ts) >= 20)").withColumn("pm25", F.col("pm25") + 1000)
    return T.upserted(table, new, ["city", "ts"])


@query("read_features", """SELECT user_id, ts, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    asked = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return T.read_features(t.events, ["value"], ["user_id", "ts"], asked)


@query("retrieval_meta", "SELECT count(*) AS rows, 5 AS features FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return T.retrieval_meta(df, ["l_orderkey", "l_linenumber"])


@query("metrics_scan", f"SELECT model_name, horizon_hours, {sr6('rmse', 'rmse')} FROM {METRICS_SQL}")
def _(t):
    path = scratch(t.spark, "metrics")
    meta = _metrics(t).select(
        "model_name", "horizon_hours", F.struct("rmse", "mae", "r2").alias("metrics"),
        F.array(F.lit("pm25")).alias("feature_names"), ntz("2024-01-31").cast("timestamp").alias("trained_at"), F.lit("none").alias("model_path"))
    meta.write.option("maxRecordsPerFile", 1).json(path)  # one document per file
    out = T.metrics_scan(t.spark, path).select("model_name", "horizon_hours", F.col("metrics.rmse").alias("rmse"))
    return rounded(out, "rmse")


# A chain of runs: what is older is stored, what is new is recomputed with the rows before it.
@query("ingest_refresh", f"""SELECT city, ts, aqi_lag_24h, aqi_roll_mean_6h FROM (SELECT city, ts, lag(aqi, 24) OVER {_BY_TIME} AS aqi_lag_24h,
    {sr6(f"avg(aqi) OVER ({_BY_TIME[1:-1]} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)", 'aqi_roll_mean_6h')} FROM {{hourly}})""")
def _(t):
    series, path = Series(("city",), "ts"), scratch(t.spark, "refreshed")
    rows = settled(t.hourly.drop("event_id"), "hourly")
    for begin, end in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        refresh(rows.where(F.col("ts") < ntz(end)), ntz(begin), path, series, "city")
    shape = short_features(rows.limit(0), series).schema
    return rounded(T.read_keyed(t.spark, path, shape, "city").select("city", "ts", "aqi_lag_24h", "aqi_roll_mean_6h"), "aqi_roll_mean_6h")


# --- catalogue ---------------------------------------------------------------------------------

_CATALOGUE = """(SELECT c_name AS name, 'customer' AS source, c_mktsegment AS category FROM customer
    UNION ALL SELECT n_name, 'nation', 'PLACE' FROM nation UNION ALL SELECT r_name, 'region', 'PLACE' FROM region)"""


@query("manifest_export", f"""SELECT '{{"catalogue":' || to_json({{features: (SELECT count(*) FROM {_CATALOGUE}), groups: (SELECT count(*) FROM (SELECT DISTINCT source, category FROM {_CATALOGUE}))}})
    || ',"store":' || to_json({{rows: (SELECT count(*) FROM events), newest: (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') FROM events)}}) || '}}' AS value""")
def _(t):
    stats = C.catalogue_stats(catalogue_of(t)).agg(F.sum("features").alias("features"), F.count(F.lit(1)).alias("groups"))
    newest = F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("newest")
    store = t.events.agg(F.count(F.lit(1)).alias("rows"), newest)
    return T.manifest_export({"catalogue": stats, "store": store}, scratch(t.spark, "manifest"))


@query("catalogue_stats", f"SELECT category, source, count(*) AS features FROM {_CATALOGUE} GROUP BY ALL")
def _(t):
    return C.catalogue_stats(catalogue_of(t))


@query("catalogue_category", f"SELECT name, source FROM {_CATALOGUE} WHERE category = 'BUILDING'")
def _(t):
    return C.by_category(catalogue_of(t), "BUILDING").select("name", "source")


@query("catalogue_tag", f"SELECT name FROM {_CATALOGUE} WHERE source <> 'customer'")
def _(t):
    return C.by_tag(catalogue_of(t), "geo").select("name")


@query("catalogue_register", """SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE c_mktsegment END AS category FROM customer""")
def _(t):
    known = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    new = t.customer.where("c_acctbal < 0").select(F.col("c_name").alias("name"), F.lit("closed").alias("category"))
    return C.catalogue_register(known, new)


@query("catalogue_lookup", "SELECT c_name AS name, c_mktsegment AS category FROM customer WHERE c_name = 'Customer#000000007'")
def _(t):
    known = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return C.get_feature(known, "Customer#000000007")




@query("feature_groups", f"""SELECT feature, n, CASE WHEN feature LIKE 'aqi_lag%' THEN 'lag_features' WHEN feature LIKE 'aqi_roll%' THEN 'rolling_mean' END AS "group",
    CASE feature WHEN 'aqi_lag_24h' THEN 'critical' WHEN 'aqi_lag_6h' THEN 'high_impact' WHEN 'aqi_rolling_mean_24h' THEN 'critical' END AS tier
    FROM (SELECT CASE event_type WHEN 'click' THEN 'aqi_lag_24h' WHEN 'view' THEN 'aqi_lag_6h' WHEN 'purchase' THEN 'aqi_rolling_mean_24h' ELSE event_type END AS feature,
    count(*) AS n FROM events GROUP BY 1)""")
def _(t):
    name = F.expr("CASE event_type WHEN 'click' THEN 'aqi_lag_24h' WHEN 'view' THEN 'aqi_lag_6h' WHEN 'purchase' THEN 'aqi_rolling_mean_24h' ELSE event_type END")
    used = t.events.groupBy(name.alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return C.with_groups(used, C.feature_groups(t.spark))
