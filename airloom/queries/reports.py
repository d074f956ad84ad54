"""Caps, quality reports, drift, metrics."""

from pyspark.sql import functions as F

from airloom.config import Rule
from airloom.operators import drift as D
from airloom.operators import outliers as O
from airloom.operators import quality as Q
from airloom.operators.quantiles import quantiles
from airloom.operators.ordered import Series
from airloom.operators.schema import column_report
from airloom.queries.base import CUT_ROWS, READ, ntz, query, r6, rounded, sr6
from airloom.session import scratch

LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NOW = "2024-01-31 06:30:00"

# --- caps --------------------------------------------------------------------------------------

_CAP = """SELECT o_orderkey, o_orderpriority, {0} FROM orders JOIN (SELECT o_orderpriority AS p,
    quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3,
    avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1) ON p = o_orderpriority"""
_IQR = "least(greatest(o_totalprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))"


@query("iqr_cap", _CAP.format(sr6(_IQR, "o_totalprice")))
def _(t):
    out = O.iqr_cap(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], ["o_totalprice"])
    return rounded(out, "o_totalprice")


@query("iqr_cap_cut", _CAP.format(sr6(_IQR, "o_totalprice")))
def _(t):
    out = O.iqr_cap(
        t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], ["o_totalprice"], buffer_rows=CUT_ROWS
    )
    return rounded(out, "o_totalprice")


@query("zscore_cap", _CAP.format(sr6("least(greatest(o_totalprice, m - 1.5 * s), m + 1.5 * s)", "o_totalprice")))
def _(t):
    out = O.zscore_cap(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], ["o_totalprice"], 1.5)
    return rounded(out, "o_totalprice")


@query("clip_cap", """SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 40) AS l_quantity, greatest(l_discount, 0.03) AS l_discount
    FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return O.clip_cap(df, {"l_quantity": (10, 40), "l_discount": (0.03, None)})


@query("cap_dispatch", f"""WITH s AS (SELECT city, quantile_cont(aqi, 0.25) AS q1, quantile_cont(aqi, 0.75) AS q3, avg(pm10) AS m, stddev_samp(pm10) AS d
        FROM {{readings}} GROUP BY city),
    c AS (SELECT r.*, CASE WHEN aqi IS NULL THEN NULL ELSE least(greatest(aqi, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS a,
        least(greatest(pm10, m - 2 * d), m + 2 * d) AS p, least(greatest(temperature, 5), 30) AS t FROM {{readings}} r JOIN s ON r.city = s.city)
    SELECT event_id, {sr6('a', 'aqi')}, {sr6('p', 'pm10')}, t AS temperature,
        CAST(coalesce(CAST(aqi <> a AS INT), 0) + CAST(pm10 <> p AS INT) + CAST(temperature <> t AS INT) AS INT) AS changed FROM c""")
def _(t):
    rules = {"aqi": Rule("iqr"), "pm10": Rule("zscore", deviations=2.0), "temperature": Rule("no such way", 5, 30)}
    out = O.cap(t.readings, ["city"], rules, count_as="changed")
    return rounded(out.select("event_id", "aqi", "pm10", "temperature", "changed"), "aqi", "pm10")


# --- quality -----------------------------------------------------------------------------------


def _stack(cols, pick):
    return " UNION ALL ".join(pick(c) for c in cols)


_MISSING = _stack(["aqi", "pm25", "pm10"], lambda c: f"""SELECT city, '{c}' AS column, count(*) - count({c}) AS missing,
    100.0 * (count(*) - count({c})) / count(*) AS pct FROM {{readings}} GROUP BY city""")


@query("missing_report", f"""SELECT city, "column", missing, round(pct, 2) + 0.0 AS percentage, CASE WHEN pct > 10 THEN 'error' WHEN missing > 0 THEN 'warning'
    ELSE 'ok' END AS severity FROM ({_MISSING})""".replace("AS column", 'AS "column"'))
def _(t):
    return Q.missing_report(t.readings, ["aqi", "pm25", "pm10"], ["city"])


def _outliers(c):
    return f"""SELECT '{c}' AS "column", CAST(count(*) FILTER ({c} < q1 - 0.5 * (q3 - q1) OR {c} > q3 + 0.5 * (q3 - q1)) AS BIGINT) AS outliers, count(*) AS n,
        any_value(q1 - 0.5 * (q3 - q1)) AS lo, any_value(q3 + 0.5 * (q3 - q1)) AS hi
        FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""


_OUTLIERS = f"""SELECT "column", outliers, round(100.0 * outliers / n, 2) + 0.0 AS percentage, round(lo, 2) + 0.0 AS lower, round(hi, 2) + 0.0 AS upper,
    CASE WHEN 100.0 * outliers / n > 5 THEN 'high' WHEN outliers > 0 THEN 'warning' ELSE 'ok' END AS severity FROM ({_stack(LINES, _outliers)})"""


@query("outlier_report", _OUTLIERS)
def _(t):
    return Q.outlier_report(t.lineitem, LINES, factor=0.5)


@query("outlier_report_cut", _OUTLIERS)
def _(t):
    return Q.outlier_report(t.lineitem, LINES, factor=0.5, buffer_rows=CUT_ROWS)


@query("dup_count", "SELECT o_orderstatus, count(*) - count(DISTINCT o_orderdate) AS duplicates FROM orders GROUP BY 1")
def _(t):
    return Q.dup_count(t.orders, Series(("o_orderstatus",), "o_orderdate", ("o_orderkey",)))


def _gap_sql(first: str) -> str:
    return f"""SELECT city, count(*) AS rows, count(*) FILTER (h <> 1 {first}) AS gaps, count(*) FILTER (h > 1) AS long_gaps,
        {sr6(f'sum(h) FILTER (h <> 1)', 'gap_hours')}, {sr6('max(h) FILTER (h <> 1)', 'max_gap_hours')},
        round(100.0 * count(*) FILTER (h <> 1 {first}) / count(*), 2) + 0.0 AS percentage,
        CASE WHEN 100.0 * count(*) FILTER (h <> 1 {first}) / count(*) > 20 THEN 'error' WHEN count(*) FILTER (h <> 1 {first}) > 0 THEN 'warning'
        ELSE 'ok' END AS severity FROM (SELECT city, epoch_us(ts - lag(ts) OVER (PARTITION BY city ORDER BY ts)) / 3600000000.0 AS h FROM {{hourly}}) GROUP BY city"""


@query("gap_report", _gap_sql(""))
def _(t):
    return rounded(Q.gap_report(t.hourly, READ), "gap_hours", "max_gap_hours")


@query("gap_report_cut", _gap_sql("OR h IS NULL"))
def _(t):
    return rounded(Q.gap_report(t.hourly, READ.cut_at(100), count_first=True), "gap_hours", "max_gap_hours")


@query("time_range", """SELECT event_type AS city, min(ts) AS start, max(ts) AS "end", CAST(floor(epoch_us(max(ts) - min(ts)) / 86400000000.0) AS BIGINT) AS duration_days
    FROM events GROUP BY 1""")
def _(t):
    return Q.time_range(t.readings, "ts", ["city"])


@query("sorted_check", """SELECT o_orderstatus, count(*) FILTER (b > o_orderdate) AS steps_back, count(*) FILTER (b > o_orderdate) = 0 AS is_sorted
    FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b FROM orders) GROUP BY 1""")
def _(t):
    return Q.sorted_check(t.orders, Series(("o_orderstatus",), "o_orderdate"), "o_orderkey")


@query("value_ranges", _stack(LINES, lambda c: f"SELECT '{c}' AS \"column\", min({c}) AS lowest, max({c}) AS highest FROM lineitem"))
def _(t):
    return Q.value_ranges(t.lineitem, [*LINES, "not there"])


@query("range_sanity", """SELECT city, 'aqi' AS "column", min(aqi) AS lowest, max(aqi) AS highest, min(aqi) < 0 OR max(aqi) > 300 AS warning FROM {readings} GROUP BY city
    UNION ALL SELECT city, 'temperature', min(temperature), max(temperature), min(temperature) < -50 OR max(temperature) > 60 FROM {readings} GROUP BY city""")
def _(t):
    return Q.range_sanity(t.readings, {"aqi": (0.0, 300.0), "temperature": (-50.0, 60.0)}, ["city"])


@query("freshness", f"""SELECT event_type AS city, max(ts) AS newest, {sr6(f"epoch_us(TIMESTAMP '{NOW}' - max(ts)) / 3600000000.0", 'age_hours')},
    epoch_us(TIMESTAMP '{NOW}' - max(ts)) / 3600000000.0 < 24 AS is_fresh FROM events GROUP BY 1""")
def _(t):
    return rounded(Q.freshness(t.readings, "ts", ntz(NOW), ["city"]), "age_hours")


@query("describe", _stack(["aqi", "pm25"], lambda c: f"""SELECT city, '{c}' AS "column", count({c}) AS count, {sr6(f'avg({c})', 'mean')}, {sr6(f'stddev_samp({c})', 'std')},
    min({c}) AS min, max({c}) AS max, {sr6(f'quantile_cont({c}, 0.25)', 'p25')}, {sr6(f'quantile_cont({c}, 0.5)', 'p50')}, {sr6(f'quantile_cont({c}, 0.75)', 'p75')}
    FROM {{readings}} GROUP BY city"""))
def _(t):
    return rounded(Q.describe(t.readings, ["aqi", "pm25"], ["city"]), "mean", "std", "p25", "p50", "p75")


def _outlier_warn(c):
    return f"""SELECT r.city, max(CAST(({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS INT)) AS warn FROM {{hourly}} r
        JOIN (SELECT city, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {{hourly}} GROUP BY city) q ON r.city = q.city GROUP BY r.city"""


@query("quality_score", f"""WITH g AS (SELECT city, count(*) AS rows, 100.0 * count(*) FILTER (h <> 1) / count(*) AS pct, count(*) FILTER (h <> 1) AS gaps
        FROM (SELECT city, epoch_us(ts - lag(ts) OVER (PARTITION BY city ORDER BY ts)) / 3600000000.0 AS h FROM {{hourly}}) GROUP BY city),
    o AS (SELECT city, sum(warn) AS warn FROM ({_stack(['pm25', 'pm10'], _outlier_warn)}) GROUP BY city)
    SELECT g.city, rows, CAST(CASE WHEN pct > 20 THEN 1 ELSE 0 END AS INT) AS errors,
        CAST(CASE WHEN pct > 20 THEN 0 ELSE CAST(gaps > 0 AS INT) + warn + 1 END AS INT) AS warnings, pct <= 20 AS is_valid,
        CAST(CASE WHEN pct > 20 THEN 100.0 ELSE 100.0 - 5 * CAST(gaps > 0 AS INT) - CASE WHEN warn > 0 THEN 10 ELSE 0 END END AS DOUBLE) AS quality_score
    FROM g JOIN o ON g.city = o.city""")
def _(t):
    return Q.quality_score(t.hourly, READ, ["pm25", "pm10"], min_rows=500)


def _outlier_finding(c):
    return f"""SELECT r.city, '{c}' AS "column", 100.0 * count(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) / count(*) AS pct FROM {{hourly}} r
        JOIN (SELECT city, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {{hourly}} GROUP BY city) q ON r.city = q.city WHERE q3 > q1 GROUP BY r.city"""


def _missing_finding(c):
    return f"""SELECT city, '{c}' AS "column", 100.0 * (count(*) - count({c})) / count(*) AS pct FROM {{hourly}} GROUP BY city"""


@query("failed_checks", f"""SELECT city, 'gaps' AS "check", NULL::VARCHAR AS "column", severity, percentage FROM ({_gap_sql("")}) WHERE severity <> 'ok' UNION ALL
    SELECT city, 'missing', "column", CASE WHEN pct > 10 THEN 'error' ELSE 'warning' END, round(pct, 2) + 0.0 FROM ({_stack(['pm25', 'pm10'], _missing_finding)}) WHERE pct > 0 UNION ALL
    SELECT city, 'outliers', "column", CASE WHEN pct > 5 THEN 'high' ELSE 'warning' END, round(pct, 2) + 0.0 FROM ({_stack(['pm25', 'pm10'], _outlier_finding)}) WHERE pct > 0""")
def _(t):
    return Q.failed_checks(t.hourly, READ, ["pm25", "pm10"])


# --- drift -------------------------------------------------------------------------------------

_SPLIT = f"""(SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts, event_id) > floor(count(*) OVER (PARTITION BY city) * 8 / 10.0) AS cur FROM {{readings}})"""
_LONG = "(SELECT city, cur, 'aqi' AS feature, aqi AS value FROM s WHERE aqi IS NOT NULL UNION ALL SELECT city, cur, 'temperature', temperature FROM s)"
_KS = f"""WITH s AS (SELECT * FROM {_SPLIT}), l AS (SELECT * FROM {_LONG}),
    d AS (SELECT city, feature, value, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM l GROUP BY ALL),
    f AS (SELECT *, abs(sum(r) OVER w / sum(r) OVER p - sum(c) OVER w / sum(c) OVER p) AS gap, sum(r) OVER p AS nr, sum(c) OVER p AS nc FROM d
        WINDOW w AS (PARTITION BY city, feature ORDER BY value), p AS (PARTITION BY city, feature)),
    k AS (SELECT city, feature, max(gap) AS ks, any_value(nr) AS nr, any_value(nc) AS nc, sum(value * r) / sum(r) AS mr, sum(value * c) / sum(c) AS mc FROM f GROUP BY ALL)"""


def _pair(t):
    s = D.split_tail(t.readings, READ, 0.2, False)
    return s.where(~F.col("in_tail")), s.where("in_tail")


_KS_OUT = _KS + f" SELECT city, feature, CAST(nr AS BIGINT) AS size_ref, CAST(nc AS BIGINT) AS size_cur, {sr6('ks', 'ks')} FROM k"


def _ks(t, rows):
    out = D.ks_stat(*_pair(t), ["aqi", "temperature"], ["city"], rows)
    return rounded(out.select("city", "feature", "size_ref", "size_cur", "ks"), "ks")


query("ks_stat", _KS_OUT)(lambda t: _ks(t, 1_000_000))
query("ks_stat_cut", _KS_OUT)(lambda t: _ks(t, CUT_ROWS))


_P = "least(1.0, greatest(0.0, 2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x) for j in range(1, 101)])))"


# Paths over the grid of both sizes that stay off the statistic, counted row by row.
_EXACT = """greatest(0.0, 1 - list_reduce(range(0, wi + 1), lambda before, i: list_reduce(range(0, hi + 1), lambda out, j: list_append(out,
    CASE WHEN abs(i * hi - j * wi) >= round(ks * wi * hi) THEN 0.0 WHEN i = 0 AND j = 0 THEN 1.0 ELSE coalesce(out[-1], 0) + coalesce(before[j + 1], 0) END),
    []::DOUBLE[]), []::DOUBLE[])[-1] / list_reduce(range(1, hi + 1), lambda c, k: c * (wi + k) / k, 1.0::DOUBLE))"""
_PVALUES = f"""SELECT city, feature, {sr6(f'CASE WHEN nr * nc <= {D.EXACT_PAIRS} THEN {_EXACT} WHEN x < 0.2 THEN 1.0 ELSE {_P} END', 'p_value')}
    FROM (SELECT *, CAST(greatest(nr, nc) AS BIGINT) AS wi, CAST(least(nr, nc) AS BIGINT) AS hi, sqrt(nr * nc / (nr + nc)) * ks AS x FROM k WHERE nr > 0 AND nc > 0)"""


@query("ks_pvalue", f"{_KS} {_PVALUES}")
def _(t):
    return D.drift_detail(*_pair(t), ["aqi", "temperature"], ["city"]).select("city", "feature", r6("p_value").alias("p_value"))


# Small samples, one pair for each user: the exact p-value.
@query("ks_pvalue_exact", f"{_KS} {_PVALUES}".replace("{readings}", "(SELECT * REPLACE (user_id AS city) FROM {readings})"))
def _(t):
    rows = t.readings.withColumn("city", F.col("user_id"))
    s = D.split_tail(rows, READ, 0.2, False)
    out = D.drift_detail(s.where(~F.col("in_tail")), s.where("in_tail"), ["aqi", "temperature"], ["city"])
    return out.select("city", "feature", r6("p_value").alias("p_value"))


@query("drift_detail", _KS + f""" SELECT city, feature, {sr6('ks', 'ks')}, ks > 0.05 AS is_drifted, round(mr, 4) + 0.0 AS ref_mean, round(mc, 4) + 0.0 AS cur_mean FROM k""")
def _(t):
    out = D.drift_detail(*_pair(t), ["aqi", "temperature"], ["city"], limit=0.05)
    return rounded(out.select("city", "feature", "ks", "is_drifted", "ref_mean", "cur_mean"), "ks")


@query("drift_log", """SELECT unnest([TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-02-02 00:00:00']) AS detected_at, cities FROM (
    SELECT count(DISTINCT event_type) AS cities FROM events)""")
def _(t):
    report = D.drift_report(D.drift_detail(*_pair(t), ["aqi", "temperature"], ["city"], limit=0.05), ["city"])
    path = scratch(t.spark, "drift_log")
    for day in ("2024-02-01", "2024-02-02"):
        D.drift_log_append(report, path, ntz(day))
    log = D.drift_log_tail(t.spark.read.schema(report.withColumn("detected_at", ntz("2024-02-01")).schema).parquet(path), "detected_at", ["city"], 1_000_000)
    return log.groupBy("detected_at").agg(F.count(F.lit(1)).alias("cities"))


@query("drift_report", _KS + """, g AS (SELECT city, count(*) AS total_features, CAST(sum(CAST(ks > 0.05 AS INT)) AS BIGINT) AS drifted_features,
        coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (ks > 0.05), '') AS drifted_names FROM k GROUP BY city)
    SELECT *, round(drifted_features / total_features, 4) + 0.0 AS drift_ratio, CASE WHEN drifted_features / total_features > 0.3 THEN 'high_drift'
        WHEN drifted_features > 0 THEN 'moderate_drift' ELSE 'no_drift' END AS status FROM g""")
def _(t):
    reference, current = _pair(t)
    return D.drift_report(D.drift_detail(reference, current, ["aqi", "temperature"], ["city"], limit=0.05), ["city"], current)


_LOG = """(SELECT date_trunc('day', ts) AS day, event_type AS city, count(*) AS n, CASE WHEN avg(value) > 55 THEN 'high_drift' ELSE 'no_drift' END AS status
    FROM events GROUP BY ALL)"""


def _log(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return t.events.groupBy(day.alias("day"), F.col("event_type").alias("city")).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.avg("value") > 55, "high_drift").otherwise("no_drift").alias("status"))


@query("drift_log_tail", f"SELECT * FROM {_LOG} ORDER BY day DESC, city DESC LIMIT 100")
def _(t):
    return D.drift_log_tail(_log(t), "day", ["city"])


@query("drift_status", f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY day DESC) AS k FROM {_LOG}) WHERE k = 1")
def _(t):
    return D.drift_status(_log(t), "day", ["city"])


@query("quantiles", _stack(LINES, lambda c: f"""SELECT l_returnflag, '{c}' AS feature, {sr6(f'quantile_cont({c}, 0.1)', 'p10')}, {sr6(f'quantile_cont({c}, 0.9)', 'p90')}
    FROM lineitem GROUP BY 1"""))
def _(t):
    out = quantiles(t.lineitem, ["l_returnflag"], LINES, [0.1, 0.9], CUT_ROWS)
    return out.select("l_returnflag", "feature", r6(F.get("q", F.lit(0))).alias("p10"), r6(F.get("q", F.lit(1))).alias("p90"))


# --- schema checks -----------------------------------------------------------------------------

_KIND = "CASE column_type WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END"


@query("type_check", f"""SELECT c AS "column", column_name IS NOT NULL AS present, CASE WHEN column_name IS NOT NULL THEN {_KIND} END AS type,
    coalesce(column_type = CASE WHEN c = 'ts' THEN 'TIMESTAMP' ELSE 'DOUBLE' END OR c <> 'ts' AND column_type IN ('BIGINT', 'INTEGER'), false) AS valid
    FROM (VALUES ('ts'), ('value'), ('event_type'), ('user_id'), ('absent')) r(c) LEFT JOIN (DESCRIBE events) ON column_name = c""")
def _(t):
    return Q.type_check(t.events, ["ts", "value", "event_type", "user_id", "absent"], "ts")


@query("missing_columns", """SELECT 'aqi' AS "column", false AS missing, count(aqi) AS given FROM {readings} UNION ALL
    SELECT 'pm25', false, count(pm25) FROM {readings} UNION ALL SELECT 'wind_speed', true, 0""")
def _(t):
    return column_report(t.readings, ["aqi", "pm25", "wind_speed"])


@query("dtype_census", f"SELECT {_KIND} AS type, count(*) AS columns FROM (DESCRIBE events) GROUP BY 1")
def _(t):
    return Q.dtype_census(t.events)


@query("gap_list", """SELECT city, start, ts AS "end", date_diff('microsecond', start, ts) / 3600000000.0 AS hours FROM (
    SELECT city, ts, lag(ts) OVER (PARTITION BY city ORDER BY ts, event_id) AS start FROM {hourly}) WHERE date_diff('microsecond', start, ts) <> 3600000000""")
def _(t):
    return Q.gap_list(t.hourly, READ)
