"""Model fitting, scoring and explanation on hourly readings."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.config import HORIZONS
from airloom.operators.features import lag_features, rolling_features, time_parts
from airloom.operators.features import lead_target
from airloom.operators.drift import split_tail
from airloom.plans import explain as E
from airloom.plans import training as M
from airloom.plans.registry import Registry
from airloom.queries.base import READ, query, r6, rounded, sr6
from airloom.queries.batch import _level_sql
from airloom.session import scratch, settled

INPUTS = ["hour", "hour_sin", "pm25_lag_1h", "pm25_lag_24h", "pm25_roll_mean_6h", "pm25_roll_mean_24h"]
H = 24


def table(t):
    out = lag_features(t.hourly, READ, ["pm25"], [1, 24])
    return time_parts(rolling_features(out, READ, ["pm25"], [6, 24], ["mean"]), "ts")


def _split(t, h=H):
    rows = lead_target(table(t), READ, "pm25", h, "label").na.fill(0.0, INPUTS)
    return split_tail(rows, READ, 0.2, True)


def _fitted(t, make):
    split = _split(t)
    return M.fit(split.where(~F.col("in_tail")), INPUTS, "label", make), split


def _scores(t, make):
    model, split = _fitted(t, make)
    return rounded(M.reg_metrics(model.transform(split.where("in_tail")), ["city"]), "rmse", "mae", "r2")


query("fit_ridge_wide")(lambda t: _scores(t, M.ridge))
query("fit_forest")(lambda t: _scores(t, M.forest))
query("fit_boost")(lambda t: _scores(t, M.boost))


def _properties(model, split, name):
    """What must hold for a model: predictions in the range of the labels (means of labels never leave it;
    sums and lines by less than its width), and on the training rows a smaller error than that of the mean."""
    error, label, tail = F.col("label") - F.col("prediction"), F.col("label"), F.col("in_tail")
    train = F.when(~tail, label)
    slack = (F.max(train) - F.min(train)) * (0.0 if name == "random_forest" else 1.0) + 1e-9
    return model.transform(split).agg(
        F.lit(name).alias("model_name"), F.count(train).alias("train_rows"),
        F.avg(train).alias("train_mean"), F.avg(F.when(tail, label)).alias("test_mean"),
        ((F.min("prediction") >= F.min(train) - slack) & (F.max("prediction") <= F.max(train) + slack)).alias("in_range"),
        (F.avg(F.when(~tail, error * error)) < F.var_pop(train)).alias("below_mean"),
    )


# Ridge on one input has a closed form, which SQL can state.
ONE = ["pm25_lag_24h"]


def _line(h: int) -> str:
    """Test rows with the ridge prediction of the value ``h`` rows ahead: city, x, label, prediction."""
    return f"""(WITH a AS (SELECT *, coalesce(lag(pm25, 24) OVER w, 0) AS x, lead(pm25, {h}) OVER w AS label FROM {{hourly}} WINDOW w AS (PARTITION BY city ORDER BY ts, event_id)),
        s AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts, event_id) > count(*) OVER (PARTITION BY city) - ceil(count(*) OVER (PARTITION BY city) * 2 / 10.0) AS tail
            FROM a WHERE label IS NOT NULL),
        c AS (SELECT avg(x) AS mx, avg(label) AS my, covar_pop(x, label) * count(*) / (var_pop(x) * count(*) + 1) AS slope FROM s WHERE NOT tail)
        SELECT a.city, a.ts, a.event_id, a.x, s.label, my + slope * (a.x - mx) AS prediction, slope, s.tail, {h} AS horizon_hours
        FROM c, a LEFT JOIN s ON s.event_id = a.event_id)"""


_FIT = f"""count(*) AS rows, {sr6('sqrt(avg((label - prediction) ** 2))', 'rmse')}, {sr6('avg(abs(label - prediction))', 'mae')},
    {sr6('1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*))', 'r2')}"""


def _one_table(t):
    return lag_features(t.hourly, READ, ["pm25"], [24])


@query("fit_ridge", f"SELECT city, {_FIT} FROM {_line(H)} WHERE tail GROUP BY city")
def _(t):
    rows = split_tail(lead_target(_one_table(t), READ, "pm25", H, "label").na.fill(0.0, ONE), READ, 0.2, True)
    model = M.fit(rows.where(~F.col("in_tail")), ONE, "label", M.ridge)
    return rounded(M.reg_metrics(model.transform(rows.where("in_tail")), ["city"]), "rmse", "mae", "r2")


# Two inputs: their normal equations, solved by Cramer's rule.
TWO = ["pm25_lag_24h", "hour"]


@query("fit_ridge_two", f"""WITH a AS (SELECT *, hour(ts) AS z FROM {_line(H)} WHERE label IS NOT NULL),
    c AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(label) AS my, var_pop(x) * count(*) + 1 AS xx, var_pop(z) * count(*) + 1 AS zz, covar_pop(x, z) * count(*) AS xz,
        covar_pop(x, label) * count(*) AS xy, covar_pop(z, label) * count(*) AS zy FROM a WHERE NOT tail),
    p AS (SELECT city, label, my + (xy * zz - zy * xz) / (xx * zz - xz * xz) * (x - mx) + (zy * xx - xy * xz) / (xx * zz - xz * xz) * (z - mz) AS prediction FROM a, c WHERE tail)
    SELECT city, {_FIT} FROM p GROUP BY city""")
def _(t):
    table = time_parts(_one_table(t), "ts")
    rows = split_tail(lead_target(table, READ, "pm25", H, "label").na.fill(0.0, TWO), READ, 0.2, True)
    model = M.fit(rows.where(~F.col("in_tail")), TWO, "label", M.ridge)
    return rounded(M.reg_metrics(model.transform(rows.where("in_tail")), ["city"]), "rmse", "mae", "r2")


def _each(pick):
    return " UNION ALL ".join(pick(h) for h in (24, 48, 72))


@query("train_grid_ridge", _each(lambda h: f"SELECT 'ridge' AS model_name, {h} AS horizon_hours, {_FIT} FROM {_line(h)} WHERE tail"))
def _(t):
    metrics, _models = M.train_grid(_one_table(t), READ, "pm25", (24, 48, 72), {"ridge": M.ridge}, ONE)
    return rounded(metrics, "rmse", "mae", "r2")


def _ridges(t):
    _metrics, models = M.train_grid(_one_table(t), READ, "pm25", (24, 48, 72), {"ridge": M.ridge}, ONE)
    return {h: m for (_n, h), m in models.items()}


_NEWEST = "SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) AS n FROM"
_SHOWN = "CAST(round_even(greatest(least(prediction, 500), 0), 1) AS DOUBLE) + 0.0"


@query("score", f"SELECT *, {_level_sql('prediction')} AS level FROM (" + _each(
    lambda h: f"SELECT city, ts, {h} AS horizon_hours, {_SHOWN} AS prediction FROM ({_NEWEST} {_line(h)}) WHERE n = 1") + ")")
def _(t):
    return M.score(_one_table(t), READ, _ridges(t), ONE).drop("color", "advice")


@query("importance_all", _each(lambda h: f"""SELECT 'pm25_lag_24h' AS feature, {h} AS horizon_hours, {sr6('any_value(abs(slope)) * avg(abs(x - m))', 'importance')}
    FROM (SELECT *, avg(x) OVER () AS m FROM (SELECT * FROM ({_NEWEST} {_line(h)}) WHERE n <= 100))"""))
def _(t):
    return rounded(E.importance_all(_ridges(t), _one_table(t).na.fill(0.0, ONE), READ, ONE), "importance")


@query("train_grid")
def _(t):
    metrics, _models = M.train_grid(table(t), READ, "pm25", HORIZONS, M.MODELS, INPUTS)
    return rounded(M.model_report(metrics), "rmse", "mae", "r2")


# Whole forests have no closed form. SQL states what must hold for each model of the grid, see _properties.
def _properties_sql(name: str, h: int) -> str:
    return f"""SELECT '{name}' AS model_name, {h} AS horizon_hours, count(*) FILTER (NOT tail) AS train_rows,
        count(*) FILTER (tail) AS test_rows, {sr6('avg(label) FILTER (NOT tail)', 'train_mean')}, {sr6('avg(label) FILTER (tail)', 'test_mean')},
        true AS in_range, true AS below_mean FROM {_line(h)} WHERE label IS NOT NULL"""


@query("train_grid_properties", " UNION ALL ".join(_properties_sql(n, h) for n in M.MODELS for h in HORIZONS))
def _(t):
    metrics, models = M.train_grid(table(t), READ, "pm25", HORIZONS, M.MODELS, INPUTS)
    found = []
    for h in HORIZONS:
        split = settled(_split(t, h), "properties")
        found += [_properties(models[name, h], split, name).withColumn("horizon_hours", F.lit(h)) for name in M.MODELS]
    tested = metrics.select("model_name", "horizon_hours", F.col("rows").alias("test_rows"))
    return rounded(reduce(DataFrame.unionByName, found).join(tested, ["model_name", "horizon_hours"]), "train_mean", "test_mean")


# One tree of one split on the hour can be stated whole: every cut, the gain of each, both leaves, and
# what the hour moves the prediction away from the mean.
@query("fit_boost_stump", f"""WITH a AS (SELECT event_id, hour(ts) AS x, label, tail FROM {_line(H)} WHERE label IS NOT NULL),
    m AS (SELECT avg(label) AS mean FROM a WHERE NOT tail),
    v AS (SELECT x, count(*) AS h, sum(mean - label) AS g FROM a, m WHERE NOT tail GROUP BY x),
    c AS (SELECT x AS cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS ga, sum(h) OVER () AS ha FROM v WINDOW w AS (ORDER BY x)),
    b AS (SELECT * FROM c WHERE hl < ha ORDER BY gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) DESC, cut LIMIT 1),
    p AS (SELECT event_id, tail, mean - 0.1 * CASE WHEN x <= cut THEN gl / (hl + 1) ELSE (ga - gl) / (ha - hl + 1) END AS prediction FROM a, m, b)
    SELECT event_id, {sr6('prediction', 'prediction')}, {sr6('prediction - avg(prediction) FILTER (NOT tail) OVER ()', 'attribution')} FROM p""")
def _(t):
    split = settled(_split(t), "stump")
    model = M.fit(split.where(~F.col("in_tail")), ["hour"], "label", lambda train, label: M.boost(train, label, maxIter=1, maxDepth=1, subsamplingRate=1.0))
    out = E.attributions(model, model.transform(split), ["hour"])
    return rounded(out.select("event_id", "prediction", F.get("attributions", F.lit(0)).alias("attribution")), "prediction", "attribution")


# Attributions of the whole model add up to the prediction, row by row.
@query("importance_boost", f"SELECT event_id, true AS adds_up, 6 AS inputs FROM ({_NEWEST} {_line(H)}) WHERE n <= 100")
def _(t):
    model, _split_rows = _fitted(t, M.boost)
    sample = settled(E.sample_tail(table(t).na.fill(0.0, INPUTS), READ), "sample")
    out = E.attributions(model, model.transform(sample), INPUTS)
    total = F.aggregate("attributions", F.col("expected"), lambda a, b: a + b)
    return out.select("event_id", (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"), F.size("attributions").alias("inputs"))


@query("registry")
def _(t):
    store = Registry(t.spark, scratch(t.spark, "registry"))
    metrics, models = M.train_grid(table(t), READ, "pm25", HORIZONS, M.MODELS, INPUTS)
    for row in metrics.collect():  # one row per trained model
        scores = {"rmse": row.rmse, "mae": row.mae, "r2": row.r2}
        store.save(models[row.model_name, row.horizon_hours], row.model_name, row.horizon_hours, scores, INPUTS, datetime(2024, 1, 31))
    return store.best().select("model_name", "horizon_hours", r6("rmse").alias("rmse"), "feature_names")


@query("importance")
def _(t):
    model, _split_rows = _fitted(t, M.ridge)
    return rounded(E.importance(model, table(t).na.fill(0.0, INPUTS), READ, INPUTS), "importance")


@query("importance_forest")
def _(t):
    model, _split_rows = _fitted(t, M.forest)
    return rounded(E.importance(model, table(t).na.fill(0.0, INPUTS), READ, INPUTS), "importance")


@query("importance_permuted")
def _(t):
    model, split = _fitted(t, M.forest)
    sample = E.sample_tail(split, READ)
    return rounded(M.ranked(E.permutation_importance(model, sample, INPUTS, "label")), "importance")


@query("importance_rank", f"""SELECT event_type AS feature, {sr6('avg(abs(value - m))', 'importance')} FROM events,
    (SELECT avg(value) AS m FROM events) GROUP BY 1""")
def _(t):
    mean = F.broadcast(t.events.agg(F.avg("value").alias("m")))
    rows = t.events.join(mean, F.lit(True)).groupBy(F.col("event_type").alias("feature"))
    return rounded(M.ranked(rows.agg(F.avg(F.abs(F.col("value") - F.col("m"))).alias("importance"))), "importance")


@query("select_features", "SELECT hour(ts) AS hour, value AS pm25 FROM events")
def _(t):
    from airloom.operators.schema import select_features

    df = t.events.select(F.hour("ts").cast("long").alias("hour"), F.col("value").alias("pm25"), F.col("value").alias("aqi"),
                         F.col("value").alias("aqi_change"), F.col("value").alias("aqi_target_24h"), F.col("event_type").alias("station_name"))
    return df.select(*select_features(df))
