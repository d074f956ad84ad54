"""Cleaning, filling, capping, features, quality, joins against pandas and hand-made numbers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airloom.config import LongFeatureSettings, Rule
from airloom.operators import features, impute, joins, latest, ordered, outliers, quality, seasonal
from airloom.operators.ordered import Series
from airloom.operators.quantiles import quantiles
from airloom.plans.readings import clean, gold
from airloom.session import settled
from frames import READING, collected, hours, nulled, table

SERIES = Series(("city",), "ts", ("id",))
CUT = SERIES.cut_at(30)
BOTH = pytest.mark.parametrize("series", [SERIES, CUT], ids=["plain", "cut"])
SIZES = {"a": 150, "b": 60, "c": 3}


@pytest.fixture(scope="module")
def pair(spark):
    pdf, df = table(spark, SIZES)
    return pdf.sort_values(["city", "ts"]).reset_index(drop=True), df.cache()


def per_city(pdf, make):
    return pd.concat([make(g) for _, g in pdf.groupby("city", sort=False)]).sort_index()


def check(df, pdf, expected, column):
    got = df.orderBy("city", "ts").toPandas()[column].astype(float).to_numpy()
    np.testing.assert_allclose(got, expected.to_numpy(float), atol=1e-9, equal_nan=True)


@BOTH
def test_fills(pair, series):
    pdf, df = pair
    check(impute.ffill(df, series, ["aqi"]), pdf, per_city(pdf, lambda g: g.aqi.ffill()), "aqi")
    check(impute.bfill(df, series, ["aqi"]), pdf, per_city(pdf, lambda g: g.aqi.bfill()), "aqi")
    check(impute.ffill_limit(df, series, ["aqi"], 2), pdf, per_city(pdf, lambda g: g.aqi.ffill(limit=2)), "aqi")
    check(impute.bfill_limit(df, series, ["aqi"], 2), pdf, per_city(pdf, lambda g: g.aqi.bfill(limit=2)), "aqi")
    check(impute.interpolate(df, series, ["aqi", "pm25"]), pdf, per_city(pdf, lambda g: g.aqi.interpolate()), "aqi")
    check(impute.handle_missing(df, series, ["aqi"]), pdf, per_city(pdf, lambda g: g.aqi.ffill().interpolate().bfill()), "aqi")
    check(impute.mean_fill(df, ["city"], ["aqi"]), pdf, per_city(pdf, lambda g: g.aqi.fillna(g.aqi.mean())), "aqi")


@BOTH
def test_window_features(pair, series):
    pdf, df = pair
    out = features.short_features(df.withColumnRenamed("ts", "ts"), series).cache()
    for n in (6, 12, 24):
        check(out, pdf, per_city(pdf, lambda g: g.pm25.rolling(n, min_periods=1).mean()), f"pm25_roll_mean_{n}h")
        check(out, pdf, per_city(pdf, lambda g: g.aqi.rolling(n, min_periods=1).std()), f"aqi_roll_std_{n}h")
    check(out, pdf, per_city(pdf, lambda g: g.aqi.shift(12)), "aqi_lag_12h")
    check(out, pdf, per_city(pdf, lambda g: g.aqi.diff()), "aqi_change")
    padded = per_city(pdf, lambda g: g.aqi.ffill().pct_change(fill_method=None)).replace([np.inf, -np.inf], np.nan)
    check(out, pdf, padded, "aqi_pct_change")
    check(features.momentum(df, series, "aqi"), pdf, per_city(pdf, lambda g: g.aqi.diff().rolling(6, min_periods=1).mean()), "aqi_momentum")
    check(features.accumulation(df, series, "pm25"), pdf, per_city(pdf, lambda g: g.pm25.rolling(3, min_periods=1).mean()), "pm25_accumulation")
    check(
        seasonal.trend_centered(df, series, "aqi"), pdf,
        per_city(pdf, lambda g: g.aqi.rolling(48, center=True, min_periods=1).mean()), "aqi_trend_simple",
    )
    assert out.count() == len(pdf)


@BOTH
def test_time_features_follow_the_clock(pair, series):
    pdf, df = pair
    lagged = per_city(pdf, lambda g: g.set_index("ts").aqi.reindex(g.ts - pd.Timedelta(hours=6)).set_axis(g.index))
    check(features.lag_time(df, series, ["aqi"], [6]), pdf, lagged, "aqi_at_6h")
    mean = per_city(pdf, lambda g: g.set_index("ts").aqi.rolling("6h").mean().set_axis(g.index))
    check(features.rolling_time(df, series, ["aqi"], [6]), pdf, mean, "aqi_time_mean_6h")


@BOTH
def test_targets_drop_the_tail(pair, series):
    pdf, df = pair
    out = features.lead_target(df, series, "id", 24)
    want = per_city(pdf, lambda g: g.id.shift(-24)).dropna()
    got = out.orderBy("city", "ts").toPandas()["id_target_24h"].to_numpy(float)
    np.testing.assert_array_equal(got, want.to_numpy())


def _decomposed(x, period=24):
    n, half = len(x), period // 2
    weights = np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = weights @ x[i - half : i + half + 1]
    phases = np.array([np.nanmean((x - trend)[p::period]) for p in range(period)])
    return trend, (phases - phases.mean())[np.arange(n) % period]


@BOTH
def test_decomposition(spark, series):
    rng = np.random.default_rng(3)
    rows = []
    for city, n in (("long", 240), ("short", 47)):
        for i, t in enumerate(hours(n)):
            rows.append((city, t, float(i + 20 * np.sin(2 * np.pi * i / 24) + rng.normal()), 1.0, 1.0, len(rows)))
    df = spark.createDataFrame(rows, READING)
    got = seasonal.decompose(df, series, "aqi").orderBy("city", "ts").toPandas()
    x = np.array([r[2] for r in rows if r[0] == "long"])
    trend, season = _decomposed(x)
    part = got[got.city == "long"]
    np.testing.assert_allclose(part.aqi_trend.to_numpy(float), trend, atol=1e-9, equal_nan=True)
    np.testing.assert_allclose(part.aqi_seasonal.to_numpy(float), season, atol=1e-9)
    assert got[got.city == "short"][["aqi_trend", "aqi_seasonal", "aqi_trend_simple"]].isna().all(axis=None)


@pytest.mark.parametrize("buffer_rows", [200_000, 20])
def test_quantiles(pair, buffer_rows):
    pdf, df = pair
    got = {(r.city, r.feature): r.q for r in quantiles(df, ["city"], ["aqi", "pm25"], (0.1, 0.25, 0.5, 1.0), buffer_rows).collect()}
    for (city, col), q in got.items():
        np.testing.assert_allclose(q, pdf[pdf.city == city][col].quantile([0.1, 0.25, 0.5, 1.0]), atol=1e-9)
    assert len(got) == 6


@pytest.mark.parametrize("buffer_rows", [200_000, 20])
def test_caps(spark, pair, buffer_rows):
    pdf, df = pair
    rules = {"aqi": Rule("iqr"), "pm25": Rule("zscore", deviations=1.5), "pm10": Rule("unheard of", 10, 40)}
    out = outliers.cap(df, ["city"], rules, count_as="changed", buffer_rows=buffer_rows).cache()

    def iqr(g):
        a, b = g.aqi.quantile(0.25), g.aqi.quantile(0.75)
        return g.aqi.clip(a - 1.5 * (b - a), b + 1.5 * (b - a))

    check(out, pdf, per_city(pdf, iqr), "aqi")
    check(out, pdf, per_city(pdf, lambda g: g.pm25.clip(g.pm25.mean() - 1.5 * g.pm25.std(), g.pm25.mean() + 1.5 * g.pm25.std())), "pm25")
    check(out, pdf, pdf.pm10.clip(10, 40), "pm10")
    rows = [("x", hours(9)[i], v, 5.0, float(i), i) for i, v in enumerate([10.0, 11.0, 12.0, 10.0, 11.0, 12.0, 1000.0])]
    small = outliers.iqr_cap(spark.createDataFrame(rows, READING), ["city"], ["aqi", "pm25"]).orderBy("ts").toPandas()
    assert small.aqi.iloc[-1] < 50 and small.aqi.iloc[0] == 10 and (small.pm25 == 5).all()


def test_cleaning(spark):
    rows = [("x", "2026-05-23T06:00:00Z", "100", 50.0, 1), ("x", "2026-05-23T06:00:00Z", "150", None, 2),
            ("x", "2026-05-23T08:00:00Z", "600", 1200.0, 3), ("x", "nonsense", "1", 1.0, 4)]
    df = spark.createDataFrame(rows, "city string, time string, aqi string, pm2_5 double, id int")
    out = clean(df, ["city"], ["id"]).orderBy("timestamp").toPandas()
    assert out.aqi.tolist() == [150, 150] and out.pm25.isna().all() and len(out) == 2
    rows[1] = ("x", "2026-05-23T06:00:00Z", "150", 50.0, 2)
    df = spark.createDataFrame(rows, "city string, time string, aqi string, pm2_5 double, id int")
    assert clean(df, ["city"], ["id"], settle=True).toPandas().pm25.tolist() == [50, 50]


def test_cleaning_and_features_keep_series_apart(spark):
    _, df = table(spark, {"a": 80, "b": 40})
    df = df.withColumnRenamed("ts", "timestamp")
    whole = gold(clean(df, ["city"], ["id"], chunk_rows=25), ["city"])
    parts = gold(clean(df.where("city='a'"), ["city"], ["id"]), ["city"]).unionByName(
        gold(clean(df.where("city='b'"), ["city"], ["id"]), ["city"]))
    pd.testing.assert_frame_equal(collected(whole, "city", "timestamp"), collected(parts, "city", "timestamp"))
    assert not whole.toPandas().isna().any(axis=None)


def test_long_features(spark):
    _, df = table(spark, {"a": 120}, nulls=0)
    df = df.withColumns({"temperature": F.col("pm25") / 2, "humidity": F.col("pm10")})
    out = features.long_features(df, SERIES, LongFeatureSettings(backfill=True)).toPandas()
    assert len(out) == 120 and not out.drop(columns=[c for c in out if "168h" in c]).isna().any(axis=None)
    made = set(out.columns) - set(df.columns)
    assert {"aqi_lag_168h", "pm10_lag_48h", "aqi_rolling_max_24h", "aqi_momentum", "aqi_seasonal", "is_rush_hour"} <= made


def test_long_features_of_a_cut_series_are_written_twice(spark, monkeypatch):
    """Row numbers, then all frames in one pass; the result is that of the plain window."""
    _, df = table(spark, {"a": 900}, nulls=0)
    df = settled(df.withColumns({"temperature": F.col("pm25") / 2, "humidity": F.col("pm10")}))
    whole, written = features.long_features(df, SERIES), []
    rest = ordered.Layout.rest
    monkeypatch.setattr(ordered.Layout, "rest", lambda self, rows: (written.append(len(rows.columns)), rest(self, rows))[1])
    parts = features.long_features(df, SERIES.cut_at(340))
    assert len(written) == 2 and written[0] < 15
    pd.testing.assert_frame_equal(collected(parts, "id"), collected(whole, "id")[parts.columns])


def _knn(pdf, cols, k):
    hour = 2 * np.pi * pdf.ts.dt.hour / 24
    x = np.c_[pdf[cols].to_numpy(float), np.sin(hour), np.cos(hour)]
    std = np.nanstd(x, axis=0)
    z = (x - np.nanmean(x, axis=0)) / np.where(std == 0, 1, std)
    out = x.copy()
    for i, j in zip(*np.where(np.isnan(x[:, : len(cols)]))):
        donors = np.flatnonzero(~np.isnan(x[:, j]))
        gap = z[donors] - z[i]
        shared = (~np.isnan(gap)).sum(1)
        dist = np.sqrt(np.nansum(gap**2, axis=1) * z.shape[1] / shared)
        near = np.lexsort((pdf.id.to_numpy()[donors], dist))[:k]
        d, v = dist[near], x[donors[near], j]
        out[i, j] = v[d == 0].mean() if (d == 0).any() else (v / d).sum() / (1 / d).sum()
    return out[:, : len(cols)]


@pytest.mark.parametrize("block_rows", [4000, 25])
def test_nearest_rows_fill(spark, block_rows):
    pdf, df = table(spark, {"a": 110, "b": 40})
    got = impute.knn_impute(df, SERIES, ["aqi", "pm25", "pm10"], "id", block_rows=block_rows).toPandas().sort_values("id")
    for city, part in pdf.groupby("city"):
        want = pd.DataFrame(_knn(part.reset_index(drop=True), ["aqi", "pm25", "pm10"], 5), index=part.id).sort_index()
        np.testing.assert_allclose(got[got.city == city][["aqi", "pm25", "pm10"]].to_numpy(float), want.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("block_rows", [30, 15])
def test_nearest_rows_meet_few_cells(spark, block_rows):
    """The bounds leave out most pairs of a gap and a cell, and nothing is lost (ties, repeated rows, null key)."""
    pdf, df = table(spark, {"a": 1500, "b": 20}, nulls=0.05)
    df = df.unionByName(df.where("city = 'a' AND id % 7 = 0").withColumn("id", F.col("id") + 10_000)).withColumn("city", F.when(F.col("city") == "a", "a"))
    cols = ["aqi", "pm25", "pm10"]
    cells = impute._Cells(df, SERIES, cols, "id", 5, block_rows)
    blocks, gaps, met = cells.cells.where("large").agg(F.sum("subs")).first()[0], cells.rows.where("large AND gap").count(), cells.targets().count()
    assert blocks > 40 and met < 0.35 * blocks * gaps
    got, whole = (impute.knn_impute(df, SERIES, cols, "id", block_rows=n).toPandas().sort_values("id") for n in (block_rows, 100_000))
    np.testing.assert_allclose(got[cols].to_numpy(float), whole[cols].to_numpy(float), atol=1e-9)


def test_nearest_rows_are_sought_once_for_equal_gaps(spark):
    """Where only the hour is known, a series asks 24 times however many gaps it has; donors of equal distance go by id."""
    df = settled(spark.range(2400).selectExpr(
        "'a' AS city", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts", "CASE WHEN id % 7 = 0 THEN CAST(id AS DOUBLE) END AS aqi", "id"))
    cells = impute._Cells(df, SERIES, ["aqi"], "id", 5, 30)
    asked = cells.targets()
    assert asked.select("id").distinct().count() == 24 and cells.members.count() == df.where("aqi IS NULL").count()
    got, whole = (impute.knn_impute(df, SERIES, ["aqi"], "id", block_rows=n).toPandas().sort_values("id", ignore_index=True) for n in (30, 100_000))
    pd.testing.assert_frame_equal(got, whole[got.columns])
    first = df.where("aqi IS NOT NULL").groupBy((F.col("id") % 24).alias("h")).agg(F.sort_array(F.collect_list("aqi")).alias("v")).collect()
    means = {r.h: sum(r.v[:5]) / 5 for r in first}
    gaps = got[got.id % 7 != 0]
    assert np.allclose(gaps.aqi, gaps.id.mod(24).map(means))


def test_imputation_stages(spark):
    gaps = {1, 5, 6, 7, *range(20, 31)}
    rows = [("a", t, None if i in gaps else float(i), 1.0, 2.0, i) for i, t in enumerate(hours(60))]
    out = impute.impute(spark.createDataFrame(rows, READING), SERIES, ["aqi"], "id").cache()
    by = {r.id: r.aqi_filled_by for r in out.collect()}
    assert all(by[i] == "forward" for i in (1, 5, 6, 7, 20, 21, 22)) and all(by[i] == "backward" for i in (28, 29, 30))
    assert all(by[i] == "knn" for i in range(23, 28)) and by[0] is None
    stats = impute.impute_stats(out, ["aqi"]).first()
    assert (stats.missing_before, stats.missing_after, stats.filled_knn) == (15, 0, 5)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 20])
def test_point_in_time(spark, chunk_rows):
    rng = np.random.default_rng(5)
    feats = pd.DataFrame({"k": rng.choice(["a", "b"], 120, p=[0.8, 0.2]), "ft": pd.to_datetime("2026-01-01") + pd.to_timedelta(rng.choice(4000, 120, replace=False), "h"), "v": rng.random(120)})
    asks = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 150), "rt": pd.to_datetime("2026-01-01") + pd.to_timedelta(rng.integers(0, 4000, 150), "h"), "n": range(150)})
    asks.loc[:20, "rt"] = feats.ft.iloc[:21].to_numpy()
    asks.loc[21:40, "rt"] = feats.ft.iloc[:20].to_numpy() + np.timedelta64(72, "h")
    asks.loc[41:60, "rt"] = feats.ft.iloc[:20].to_numpy() + np.timedelta64(72, "h") + np.timedelta64(1, "us")
    out = joins.pit_join(spark.createDataFrame(asks), spark.createDataFrame(feats), ["k"], "rt", "ft", ["v"], chunk_rows=chunk_rows)
    got = out.orderBy("n").toPandas()
    for _, ask in got.iterrows():
        near = feats[(feats.k == ask.k) & (feats.ft <= ask.rt) & (feats.ft >= ask.rt - pd.Timedelta(hours=72))]
        if near.empty:
            assert pd.isna(ask.v)
        else:
            assert ask.v == near.sort_values("ft").v.iloc[-1]
    assert len(got) == 150


def test_merge_keeps_values_the_other_feed_lacks(spark):
    a = spark.createDataFrame([("x", 1, 42.0, None), ("x", 2, 50.0, 7.0)], "city string, h int, aqi double, temperature double")
    b = spark.createDataFrame([("x", 1, None, 20.0), ("x", 3, None, 21.0)], "city string, h int, aqi double, temperature double")
    out = joins.source_merge(a, b, ["city", "h"]).orderBy("h").toPandas()
    assert out.aqi.tolist()[:2] == [42, 50] and out.temperature.tolist() == [20, 7, 21] and pd.isna(out.aqi[2])


def test_fallback_and_online(spark):
    a = spark.createDataFrame([("x", 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", 9.0), ("y", 2.0), (None, 3.0)], "k string, v double")
    assert sorted(joins.fallback_source(a, b, ["k"]).collect(), key=str) == sorted(
        [("x", 1.0), ("y", 2.0), (None, 3.0)], key=str)
    pdf, df = table(spark, {"a": 10, "b": 5})
    asked = spark.createDataFrame([("a",), ("zz",)], "city string")
    out = joins.online_lookup(asked, df, SERIES, ["pm25", "absent"]).orderBy("city").toPandas()
    assert out.ts[0] == pdf[pdf.city == "a"].ts.max() and pd.isna(out.ts[1]) and out.absent.isna().all()


def test_combining_sources_prefers_the_first(spark):
    a = spark.createDataFrame([("x", 1, 1.0)], "city string, ts int, aqi double").withColumn("id", F.lit(1))
    b = spark.createDataFrame([("x", 1, 2.0, 5.0), ("x", 2, 3.0, 6.0)], "city string, ts int, aqi double, o3 double").withColumn("id", F.lit(2))
    out = latest.combine_sources({"a": a, "b": b}, SERIES).orderBy("ts").collect()
    assert [(r.aqi, r.source) for r in out] == [(1.0, "a"), (3.0, "b")]


def test_gaps(spark):
    rows = [("x", t, 1.0, 1.0, 1.0, i) for i, t in enumerate(hours(10)) if i not in (3, 6, 7)]
    df = spark.createDataFrame(rows, READING)
    r = quality.gap_report(df, SERIES).first()
    assert (r.rows, r.gaps, r.max_gap_hours, r.severity) == (7, 2, 3.0, "error")
    perfect = spark.createDataFrame([("x", t, 1.0, 1.0, 1.0, i) for i, t in enumerate(hours(10))], READING)
    assert quality.gap_report(perfect, SERIES).first().gaps == 0
    assert quality.gap_report(perfect, SERIES, count_first=True).first().gaps == 1


def test_quality_score(spark):
    def frame(n, change=lambda i, r: r):
        rows = [change(i, ["x", t, float(i % 7), 5.0 + i % 3, 9.0, i]) for i, t in enumerate(hours(n))]
        return spark.createDataFrame([tuple(r) for r in rows], READING)

    def score(df, **kw):
        return quality.quality_score(df, SERIES, ["aqi", "pm25", "pm10"], min_rows=50, **kw).first()

    assert (score(frame(100)).quality_score, score(frame(100)).is_valid) == (100, True)
    assert score(frame(25)).quality_score == 50 and not score(frame(25)).is_valid

    def holes(i, r):
        r[3] = None if i % 20 == 0 else r[3]
        r[2] = 1e6 if i == 50 else r[2]
        return r

    got = score(frame(100, holes))
    assert (got.quality_score, got.errors, got.warnings) == (85, 0, 2) and got.is_valid
    assert not score(frame(100, holes), strict=True).is_valid
    twice = frame(100).unionByName(frame(1))
    assert score(twice).errors == 1
    assert quality.quality_score(frame(60).drop("aqi"), SERIES, ["aqi"], min_rows=50).first().quality_score == 50
