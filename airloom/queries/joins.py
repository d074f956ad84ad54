"""Joins and lookups."""

from pyspark.sql import functions as F

from airloom.config import BEYOND_LEVEL, LEVELS, UNKNOWN_LEVEL
from airloom.operators import joins as J
from airloom.operators.features import rolling
from airloom.operators.ordered import Series, with_rows
from airloom.queries.base import CUT_ROWS, READ, query, rounded, sr6
from airloom.queries.batch import _level_sql
from airloom.queries.windows import frame

_PIT = """SELECT c.event_id, CASE WHEN v.ts >= c.ts - INTERVAL 72 HOURS THEN v.ts END AS feature_ts,
    CASE WHEN v.ts >= c.ts - INTERVAL 72 HOURS THEN v.value END AS value
    FROM (SELECT * FROM events WHERE event_type NOT IN ('view', 'purchase')) c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('view', 'purchase')) v
    ON c.{0} = v.{0} AND c.ts >= v.ts"""


def _pit(t, key, rows):
    asked = t.events.where("event_type NOT IN ('view', 'purchase')").select("event_id", key, "ts")
    known = t.events.where("event_type IN ('view', 'purchase')").select(key, "ts", "value")
    out = J.pit_join(asked, known, [key], "ts", "ts", ["value"], chunk_rows=rows)
    return out.select("event_id", "feature_ts", "value")


query("pit_join", _PIT.format("user_id"))(lambda t: _pit(t, "user_id", 1_000_000))
# Three keys hold everything, so each is larger than the chunk.
@query("pit_join_cut", _PIT.format("site").replace("SELECT * FROM events", "SELECT *, user_id % 3 AS site FROM events"))
def _(t):
    site = (F.col("user_id") % 3).alias("site")
    asked = t.events.where("event_type NOT IN ('view', 'purchase')").select("event_id", site, "ts")
    known = t.events.where("event_type IN ('view', 'purchase')").select(site, "ts", "value")
    return J.pit_join(asked, known, ["site"], "ts", "ts", ["value"], chunk_rows=CUT_ROWS).select("event_id", "feature_ts", "value")


@query("source_merge", """SELECT coalesce(a.city, b.city) AS city, coalesce(a.ts, b.ts) AS ts, a.pm25, coalesce(a.temperature, b.temperature) AS temperature FROM
    (SELECT city, ts, pm25, CASE WHEN event_id % 2 = 0 THEN pm10 END AS temperature FROM {hourly} WHERE city <> 'view') a
    FULL JOIN (SELECT city, date_trunc('hour', ts) AS ts, max(temperature) AS temperature FROM {readings} WHERE city <> 'click' GROUP BY 1, 2) b
    ON a.city = b.city AND a.ts = b.ts""")
def _(t):
    half = F.when(F.col("event_id") % 2 == 0, F.col("pm10"))
    air = t.hourly.where("city <> 'view'").select("city", "ts", "pm25", half.alias("temperature"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    weather = t.readings.where("city <> 'click'").groupBy("city", hour.alias("ts")).agg(F.max("temperature").alias("temperature"))
    weather = weather.withColumn("pm25", F.lit(None).cast("double"))  # the weather feed lists what it does not have
    return J.source_merge(air, weather, ["city", "ts"])


def _text_sql(value: str, i: int) -> str:
    cases = " ".join(f"WHEN round_even({value}, 0) BETWEEN {v[1]} AND {v[2]} THEN '{v[i]}'" for v in LEVELS)
    k = {3: 1, 4: 2}[i]
    return f"CASE WHEN {value} IS NULL THEN '{UNKNOWN_LEVEL[k]}' {cases} ELSE '{BEYOND_LEVEL[k]}' END"


@query("advisory_lookup", f"""SELECT event_id, {_level_sql('v')} AS level, {_text_sql('v', 3)} AS color, {_text_sql('v', 4)} AS advice,
    CAST(round_even(v, 1) AS DOUBLE) + 0.0 AS shown FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value * 4) / 4 - 2 END AS v FROM events)""")
def _(t):
    v = F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 4) / 4 - 2)
    return J.advisory_lookup(t.events.select("event_id", v.alias("v")), "v").drop("v")


@query("multi_horizon_advice", " UNION ALL ".join(
    f"SELECT event_id, {h} AS horizon_hours, {v} AS prediction, {_level_sql(v)} AS level FROM {{readings}}" for h, v in ((24, "aqi"), (48, "pm10"))))
def _(t):
    out = J.multi_horizon_advice(t.readings, {24: "aqi", 48: "pm10"}, ["event_id"])
    return out.select("event_id", "horizon_hours", "prediction", "level")


@query("online_lookup", """SELECT u.user_id, l.ts, l.value, NULL::DOUBLE AS o3 FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) u LEFT JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) l ON l.user_id = u.user_id""")
def _(t):
    asked = t.customer.select(F.col("c_custkey").alias("user_id"))
    return J.online_lookup(asked, t.events, Series(("user_id",), "ts", ("event_id",)), ["value", "o3"])


@query("fallback_source", """SELECT event_id, user_id, value, 'live' AS origin FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, user_id, value, 'stored' FROM events WHERE event_type <> 'purchase'
    AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def _(t):
    def part(live, origin):
        return t.events.where((F.col("event_type") == "purchase") == live).select("event_id", "user_id", "value", F.lit(origin).alias("origin"))

    return J.fallback_source(part(True, "live"), part(False, "stored"), ["user_id"])


def catalogue_of(t):
    """A catalogue that grows with the data: customers depend on nations, nations on regions."""
    none = F.array().cast("array<string>")
    parts = [
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_name").alias("name"), F.lit("customer").alias("source"), F.col("c_mktsegment").alias("category"),
            F.array("n_name").alias("dependencies"), F.array(F.lower("c_mktsegment"), F.lit("raw")).alias("tags")),
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("name"), F.lit("nation").alias("source"), F.lit("PLACE").alias("category"),
            F.array("r_name").alias("dependencies"), F.array(F.lit("geo")).alias("tags")),
        t.region.select(
            F.col("r_name").alias("name"), F.lit("region").alias("source"), F.lit("PLACE").alias("category"),
            none.alias("dependencies"), F.array(F.lit("geo")).alias("tags")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("lineage", """SELECT c_name AS feature, n_name AS dependency, 'nation' AS source, 'PLACE' AS category FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_name, r_name, 'region', 'PLACE' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    return J.lineage(catalogue_of(t))


# --- forecasts compared ------------------------------------------------------------------------

# Three simple forecasts of the value h rows ahead, as models to compare.
_AHEAD = ", ".join(f"lead(pm25, {h}) OVER (PARTITION BY city ORDER BY ts, event_id) AS y{h}" for h in (24, 48, 72))
FORECASTS_SQL = f"""(WITH f AS (SELECT city, pm25 AS last_value, avg(pm25) OVER {frame('5 PRECEDING AND CURRENT ROW')} AS mean_6,
        avg(pm25) OVER {frame('23 PRECEDING AND CURRENT ROW')} AS mean_24, {_AHEAD} FROM {{hourly}})
    SELECT * FROM ({' UNION ALL '.join(f"SELECT city, '{m}' AS model_name, {h} AS horizon_hours, y{h} AS label, {m} AS prediction FROM f" for h in (24, 48, 72) for m in ('last_value', 'mean_6', 'mean_24'))})
    WHERE label IS NOT NULL)"""


def forecasts(t):
    def stage(w):
        made = {"last_value": F.col("pm25"), **{f"y{h}": F.lead("pm25", h).over(w) for h in (24, 48, 72)}}
        return made | rolling(w, "pm25", [6, 24], ["mean"], "mean_{n}")

    wide = with_rows(t.hourly, READ, stage, before=24, after=72)
    rows = [
        F.struct(F.lit(m).alias("model_name"), F.lit(h).alias("horizon_hours"), F.col(f"y{h}").alias("label"), F.col(m).alias("prediction"))
        for h in (24, 48, 72) for m in ("last_value", "mean_6", "mean_24")
    ]
    return wide.select("city", F.explode(F.array(*rows)).alias("r")).select("city", "r.*").where(F.col("label").isNotNull())


METRICS_SQL = f"""(SELECT model_name, horizon_hours, count(*) AS rows, sqrt(avg((label - prediction) ** 2)) AS rmse, avg(abs(label - prediction)) AS mae,
    1 - sum((label - prediction) ** 2) / (sum(label * label) - sum(label) ** 2 / count(*)) AS r2 FROM {FORECASTS_SQL} GROUP BY ALL)"""


def _metrics(t):
    from airloom.plans.training import reg_metrics

    return reg_metrics(forecasts(t), ["model_name", "horizon_hours"])


_SHOWN = f"{sr6('rmse', 'rmse')}, {sr6('mae', 'mae')}, {sr6('r2', 'r2')}"


@query("reg_metrics", f"SELECT model_name, horizon_hours, rows, {_SHOWN} FROM {METRICS_SQL}")
def _(t):
    return rounded(_metrics(t), "rmse", "mae", "r2")


@query("best_model", f"SELECT horizon_hours, arg_min(model_name, rmse) AS model_name, {sr6('min(rmse)', 'rmse')} FROM {METRICS_SQL} GROUP BY 1")
def _(t):
    from airloom.plans.training import best_models

    return rounded(best_models(_metrics(t)), "rmse")


@query("model_report", f"SELECT horizon_hours, model_name, {_SHOWN}, rmse = min(rmse) OVER (PARTITION BY horizon_hours) AS is_best FROM {METRICS_SQL}")
def _(t):
    from airloom.plans.training import model_report

    return rounded(model_report(_metrics(t)).select("horizon_hours", "model_name", "rmse", "mae", "r2", "is_best"), "rmse", "mae", "r2")


@query("best_model_join", f"""SELECT m.model_name, m.horizon_hours, rows, {_SHOWN} FROM {METRICS_SQL} m JOIN
    (SELECT horizon_hours, arg_min(model_name, rmse) AS model_name FROM {METRICS_SQL} GROUP BY 1) b ON b.model_name = m.model_name AND b.horizon_hours = m.horizon_hours""")
def _(t):
    from airloom.plans.training import best_models

    metrics = _metrics(t)
    best = best_models(metrics).select("horizon_hours", "model_name")
    return rounded(J.best_model_join(best, metrics), "rmse", "mae", "r2")


@query("train_summary", f"SELECT coalesce(CAST(horizon_hours AS VARCHAR), 'all') AS horizon, count(*) AS models FROM {METRICS_SQL} GROUP BY ROLLUP (horizon_hours)")
def _(t):
    from airloom.plans.training import train_summary

    return train_summary(_metrics(t)).select(F.coalesce(F.col("horizon_hours").cast("string"), F.lit("all")).alias("horizon"), "models")
