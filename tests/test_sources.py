"""Readers, writers, payloads, catalogue, streams, models."""

import json
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airloom.config import FEATURE_GROUPS
from airloom.operators import drift as D
from airloom.operators import quality
from airloom.operators.drift import drift_detail, drift_log_append, drift_report, ks_stat
from airloom.operators.features import lag_time, lags, long_features, rolling, short_features
from airloom.operators.joins import pit_join
from airloom.operators.latest import dedup_last
from airloom.operators.ordered import Series, with_rows
from airloom.operators.predicates import min_rows_guard
from airloom.plans import catalogue as C
from airloom.plans import explain as E
from airloom.plans import ingest as I
from airloom.plans import training as M
from airloom.plans.readings import clean, gold
from airloom.plans.registry import Registry
from airloom.session import remove, scratch, shared_dir
from airloom.sources import payloads as J
from airloom.sources import tables as T
from airloom.streaming import jobs as S
from frames import READING, hours, table

SERIES = Series(("city",), "ts", ("id",))

def now():
    return F.lit("2026-07-01 12:30:00").cast("timestamp")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_csv_with_any_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Timestamp,AQI\n2026-01-01 00:00:00,5\nnope,6\n")
    got = T.read_csv(spark, str(tmp_path)).collect()
    assert [(r.timestamp, r.aqi) for r in got] == [(datetime(2026, 1, 1), "5")]


def test_append_widens_the_schema(spark, tmp_path):
    path = str(tmp_path / "raw")
    T.append_raw(spark.createDataFrame([("2026-01-01", 1.0)], "ts string, aqi double"), path, "ts")
    T.append_raw(spark.createDataFrame([("2026-01-02", 2.0)], "ts string, o3 double"), path, "ts")
    got = T.read_table(spark, path, merge=True).orderBy("ts").collect()
    assert [(r.aqi, r.o3) for r in got] == [(1.0, None), (None, 2.0)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 2))], "a int, ts timestamp")
    T.snapshot_write(df.where("a = 1"), path, "20260101T000000", "ts")
    meta = T.snapshot_write(df, path, "20260102T000000", "ts").first()
    assert (meta.rows, meta.columns, meta.max_ts) == (2, 2, datetime(2026, 1, 2))
    assert T.read_latest(spark, path).count() == 2
    assert meta.fingerprint == T.checksum(df.repartition(3)).first().fingerprint
    health = T.store_health(T.snapshot_meta(spark, path), F.lit("2026-01-03").cast("timestamp")).first()
    assert (health.versions, health.rows, health.status, health.age_hours) == (2, 3, "healthy", 24)


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "keyed")
    shape = "city string, ts int, v double"
    T.upsert_features(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], shape), path, ["city", "ts"], "city")
    before = {f.name for f in (tmp_path / "keyed" / "city=b").iterdir()}
    T.upsert_features(spark.createDataFrame([("a", 2, 20.0), ("a", 3, 30.0)], shape), path, ["city", "ts"], "city")
    got = sorted((r.city, r.ts, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 20.0), ("a", 3, 30.0), ("b", 1, 3.0)]
    assert {f.name for f in (tmp_path / "keyed" / "city=b").iterdir()} == before


def test_nested_payload(spark):
    body = {"status": "ok", "data": {"aqi": 137.9, "iaqi": {"pm25": {"v": 88.0}}, "dominentpol": "pm25",
            "city": {"name": ""}, "time": {"iso": "2026-07-01T10:00:00+05:00"}}}
    dash = {"status": "ok", "data": {"aqi": "-"}, "pm2_5": 7}
    rows = [(json.dumps(body),), (json.dumps(dash),), (json.dumps({"status": "error"}),), ("{broken",)]
    got = J.json_reading(spark.createDataFrame(rows, "p string"), "p", now=now()).collect()
    assert len(got) == 2
    assert (got[0].aqi, got[0].pm25, got[0].temperature, got[0].station_name) == (137, 88, None, "Islamabad")
    assert got[0].timestamp == datetime(2026, 7, 1, 5)
    assert (got[1].aqi, got[1].pm25, got[1].dominant_pollutant, got[1].timestamp) == (None, 7, "unknown", datetime(2026, 7, 1, 12, 30))


def test_hourly_payload(spark):
    def body(times):
        return json.dumps({"hourly": {"time": times, "temperature_2m": [float(i) for i in range(len(times))], "relativehumidity_2m": [50]}})

    rows = [("a", body(["2026-07-01T11:00", "2026-07-01T12:00", "2026-07-01T13:00"])), ("b", body(["2027-01-01T00:00", "2027-01-01T01:00"])), ("c", body([]))]
    df = spark.createDataFrame(rows, "k string, p string")
    got = {r.k: r.temperature for r in J.json_hourly_asof(df, "p", ["k"], now()).collect()}
    assert got == {"a": 1.0, "b": 1.0}
    long = J.json_hourly_explode(df, "p", ["k"]).orderBy("k", "place").collect()
    assert [(r.k, r.temperature, r.humidity) for r in long][:3] == [("a", 0, 50), ("a", 1, None), ("a", 2, None)]
    assert len(long) == 5


def test_catalogue(spark):
    known = C.catalogue(spark)
    names = {r.name for r in known.collect()}
    sensors = [row[0] for row in C.SENSORS]
    empty = spark.createDataFrame([], "city string, ts timestamp, " + ", ".join(f"{c} double" for c in sensors))
    made = long_features(empty, Series(("city",), "ts")).columns
    assert names == set(made) - {"city", "ts"} and len(names) == known.count()
    assert {"aqi_lag_168h", "aqi_rolling_mean_3h", "temp_normalized"} <= names
    assert {r.name for r in C.by_tag(known, "target").collect()} == {"aqi"}
    new = known.where("name = 'aqi'").withColumn("category", F.lit("changed"))
    after = C.catalogue_register(known, new)
    assert after.count() == len(names) and C.get_feature(after, "aqi").first().category == "changed"
    assert C.feature_groups(spark).where("`group` is not null").count() == sum(map(len, FEATURE_GROUPS.values()))


def test_view_has_the_fixed_columns(spark):
    _, df = table(spark, {"a": 30})
    out = C.as_view(gold(df.withColumnRenamed("ts", "timestamp"), ["city"]))
    assert len(C.VIEW_SCHEMA) == 52 and out.columns == ["city", "timestamp", *C.VIEW_SCHEMA]


def test_manifest(spark, tmp_path):
    doc = T.manifest_export({"a": spark.range(3).agg(F.count("*").alias("n")), "b": spark.sql("select 'x' v")}, str(tmp_path / "m"))
    assert json.loads(doc.first().value) == {"a": {"n": 3}, "b": {"v": "x"}}


def test_schema_reports(spark):
    df = spark.createDataFrame([], "ts timestamp, aqi string, pm25 double")
    got = {r.column: (r.present, r.valid) for r in quality.type_check(df, ["ts", "aqi", "pm25", "o3"], "ts").collect()}
    assert got == {"ts": (True, True), "aqi": (True, False), "pm25": (True, True), "o3": (False, False)}
    assert {r.type: r.columns for r in quality.dtype_census(df).collect()} == {"timestamp": 1, "string": 1, "double": 1}


@pytest.mark.parametrize("chunk_rows", [1_000_000, 15])
def test_drift(spark, chunk_rows):
    rng = np.random.default_rng(11)
    ref = pd.DataFrame({"a": rng.normal(100, 15, 100).round(0), "b": rng.normal(25, 5, 100), "c": np.zeros(100)})
    cur = pd.DataFrame({"a": rng.normal(120, 20, 50).round(0), "b": rng.normal(25, 5, 50), "c": np.zeros(50)})
    r, c = spark.createDataFrame(ref), spark.createDataFrame(cur)
    got = {x.feature: x.ks for x in ks_stat(r, c, ["a", "b", "c"], chunk_rows=chunk_rows).collect()}
    for f, ks in got.items():
        grid = np.union1d(ref[f], cur[f])
        far = np.searchsorted(np.sort(ref[f]), grid, "right") / 100 - np.searchsorted(np.sort(cur[f]), grid, "right") / 50
        assert ks == pytest.approx(np.abs(far).max(), abs=1e-12)
    detail = drift_detail(r, c, ["a", "b", "c"], limit=0.25, chunk_rows=chunk_rows)
    report = drift_report(detail, (), c).first()
    assert (report.total_features, report.drifted_names, report.status) == (3, "a", "high_drift")
    p = {x.feature: x.p_value for x in detail.collect()}
    assert p["a"] < 1e-4 and p["c"] == 1
    assert drift_report(detail, (), c.limit(10)).first().status == "insufficient_data"


# --- streams -----------------------------------------------------------------------------------


@pytest.fixture()
def landed(spark, tmp_path):
    """Readings of two cities as three files in time order."""
    pdf, df = table(spark, {"a": 60, "b": 45})
    for i in range(3):
        part = df.where((F.col("ts") >= f"2026-04-0{1 + i}") & (F.col("ts") < ("2026-05-01" if i == 2 else f"2026-04-0{2 + i}")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream, str(tmp_path)


def test_stream_features_equal_batch(spark, landed):
    df, stream, path = landed

    def features(d):
        return with_rows(d, SERIES, lambda w: lags(w, "aqi", [12]) | rolling(w, "pm25", [6], ["mean", "std"]), before=12)

    S.st_features(stream, SERIES, features, f"{path}/history", f"{path}/out", f"{path}/check", 12).awaitTermination()
    cols = ["id", "aqi_lag_12h", "pm25_roll_mean_6h", "pm25_roll_std_6h"]
    got = spark.read.parquet(f"{path}/out").select(*cols).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, features(df).select(*cols).orderBy("id").toPandas())
    tails = spark.read.parquet(f"{path}/history")
    assert {r["count"] for r in tails.groupBy("city").count().collect()} == {12}


def test_stream_online_and_dedup(spark, landed):
    df, stream, path = landed
    S.st_online(stream, SERIES, f"{path}/online", f"{path}/check1").awaitTermination()
    got = {r.city: r.id for r in spark.read.parquet(f"{path}/online").collect()}
    want = {r.city: r.id for r in df.groupBy("city").agg(F.max_by("id", "ts").alias("id")).collect()}
    assert got == want


@pytest.fixture()
def shuffled(spark, tmp_path):
    """Readings of two cities and of none, some times twice, as four files in no order."""
    _, df = table(spark, {"a": 60, "b": 45, "c": 30})
    df = df.withColumn("city", F.when(F.col("city") != "c", F.col("city")))
    df = df.unionByName(df.where("id % 3 = 0").withColumns({"id": F.col("id") + 1000, "aqi": F.lit(7.0)}))
    for i in range(4):
        df.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path)


def test_stream_dedup_keeps_the_last_as_batch_does(spark, shuffled):
    df, stream, path = shuffled
    S.heartbeat(spark, f"{path}/in", df.schema, "ts", "2100-01-01")
    query = S.start(S.st_dedup(stream, SERIES, "30 days"), f"{path}/once", f"{path}/check")
    query.awaitTermination()
    got, want = (sorted(map(str, d.select(*df.columns).collect())) for d in (spark.read.parquet(f"{path}/once"), dedup_last(df, SERIES)))
    assert got == want


def test_stream_windows_leave_the_state(spark, landed):
    df, stream, path = landed
    S.heartbeat(spark, f"{path}/in", df.schema, "ts", "2100-01-01")
    query = S.start(S.st_rolling(stream, SERIES, "aqi", 6, "2 hours"), f"{path}/windows", f"{path}/check")
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = {(r.city, r.start): (r.n, r["mean"]) for r in spark.read.parquet(f"{path}/windows").collect()}
    slid = df.withColumn("start", F.explode(F.sequence(F.date_trunc("hour", "ts") - F.expr("INTERVAL 5 HOURS"), F.date_trunc("hour", "ts"), F.expr("INTERVAL 1 HOUR"))))
    want = slid.groupBy("city", "start").agg(F.count("aqi").alias("n"), F.avg("aqi").alias("mean")).collect()
    assert set(got) == {(r.city, r.start) for r in want} and all(got[r.city, r.start] == (r.n, pytest.approx(r["mean"])) for r in want)
    assert sizes[-1] <= 6 < len(got)  # the heartbeat's own windows; all others have gone


def test_stream_features_of_late_rows(spark, shuffled):
    df, stream, path = shuffled

    def features(d):
        return with_rows(d, SERIES, lambda w: lags(w, "aqi", [12]) | rolling(w, "pm25", [6], ["mean"]), before=12)

    args = (SERIES, features, f"{path}/history", f"{path}/out", f"{path}/check", 12, timedelta(days=30))
    S.st_features(stream, *args).awaitTermination()
    cols = ["id", "aqi_lag_12h", "pm25_roll_mean_6h"]
    got = S.features_table(spark, f"{path}/out", SERIES).select(*cols).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, features(df).select(*cols).orderBy("id").toPandas())


def test_stream_features_drop_rows_behind_the_limit(spark, tmp_path):
    path = str(tmp_path)
    rows = [("a", t, float(i), None, None, i) for i, t in enumerate(hours(50))]
    for part in (rows[:5] + rows[10:40], rows[40:], rows[5:10]):  # the last file is over a day late
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    S.st_features(stream, SERIES, lambda d: d, f"{path}/history", f"{path}/out", f"{path}/check", 3, timedelta(days=1)).awaitTermination()
    assert sorted(r.id for r in S.features_table(spark, f"{path}/out", SERIES).collect()) == [*range(5), *range(10, 50)]
    assert spark.read.parquet(f"{path}/history").count() == 25 + 3


def test_stream_features_from_stages(spark, shuffled):
    df, stream, path = shuffled
    stages = [lambda w: lags(w, "aqi", [12]) | rolling(w, "pm25", [6], ["mean"])]
    S.st_features(stream, SERIES, stages, f"{path}/history", f"{path}/out", f"{path}/check", 12, timedelta(days=30)).awaitTermination()
    cols = ["id", "aqi_lag_12h", "pm25_roll_mean_6h"]
    got = S.features_table(spark, f"{path}/out", SERIES).select(*cols).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, with_rows(df, SERIES, *stages, before=12).select(*cols).orderBy("id").toPandas())
    assert spark.read.parquet(f"{path}/history").select(*df.columns).exceptAll(df).isEmpty()


def test_stream_features_keep_a_stored_row_that_comes_again_too_late(spark, tmp_path):
    path = str(tmp_path)
    rows = [("a", t, float(i), None, None, i) for i, t in enumerate(hours(50))]
    between = ("a", rows[25][1] + timedelta(minutes=30), 99.0, None, None, 50)
    for part in (rows, rows[10:11], [between]):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stages = [lambda w: lags(w, "aqi", [20])]
    S.st_features(stream, SERIES, lambda d: with_rows(d, SERIES, *stages, before=20), f"{path}/history", f"{path}/out", f"{path}/check", 26, timedelta(days=1)).awaitTermination()
    assert S.features_table(spark, f"{path}/out", SERIES).where("id = 50").first().aqi_lag_20h == 6.0


def test_stream_drift_reads_its_reference_once(spark, landed):
    df, stream, path = landed
    df.write.parquet(f"{path}/reference")
    query = S.st_drift(stream, spark.read.parquet(f"{path}/reference"), ["aqi", "pm25"], f"{path}/drift", f"{path}/check", ["city"])
    remove(spark, f"{path}/reference")
    query.awaitTermination()
    got = spark.read.parquet(f"{path}/drift")
    assert got.select("batch").distinct().count() == 3
    first = df.where("ts < '2026-04-02'")
    want = drift_report(drift_detail(df, first, ["aqi", "pm25"], group=["city"]), ["city"], first)
    assert sorted(map(str, got.where("batch = 0").drop("batch").collect())) == sorted(map(str, want.collect()))


def test_stream_restart_takes_only_new_files(spark, landed):
    df, stream, path = landed
    S.st_ingest(stream, f"{path}/raw", f"{path}/check3").awaitTermination()
    S.st_ingest(stream, f"{path}/raw", f"{path}/check3").awaitTermination()
    assert spark.read.parquet(f"{path}/raw").count() == df.count()


# --- models ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(42)
    rows = []
    for city, n in (("a", 260), ("b", 200), ("tiny", 20)):
        for i, t in enumerate(hours(n)):
            aqi = float(80 + 30 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 3))
            rows.append((city, t, aqi, aqi / 2 + rng.normal(), float(rng.normal(50, 9)), len(rows)))
    df = spark.createDataFrame(rows, READING)
    return with_rows(df, SERIES, lambda w: lags(w, "aqi", [1, 24]), before=24).cache()


FEATURES = ["pm25", "pm10", "aqi_lag_1h", "aqi_lag_24h"]


def test_ridge_equals_its_closed_form(spark, training):
    train = training.na.fill(0.0, FEATURES)
    model = M.fit(train, FEATURES, "aqi", M.ridge).stages[-1]
    pdf = train.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf["aqi"].to_numpy()
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(model.coefficients.toArray(), want, atol=1e-9)


def test_training_scoring_registry(spark, training, tmp_path):
    kinds = {"ridge": M.ridge, "forest": lambda d, y: M.forest(d, y, numTrees=5, maxDepth=4)}
    metrics, models = M.train_grid(training, SERIES, "aqi", (24,), kinds, FEATURES)
    got = metrics.toPandas()
    assert len(got) == 2 and (got.r2 > 0.5).all() and (got.rows == 48 + 36).all()
    store = Registry(spark, str(tmp_path / "reg"))
    for r in metrics.collect():
        store.save(models[r.model_name, 24], r.model_name, 24, {"rmse": r.rmse, "mae": r.mae, "r2": r.r2}, FEATURES, datetime(2026, 5, 1))
    assert store.list_models().count() == 2
    best, names = store.load_best(24)
    assert names == FEATURES and store.best().first().model_name == got.sort_values("rmse").model_name.iloc[0]
    with pytest.raises(LookupError):
        store.load_best(99)
    out = M.score(training.drop("pm10"), SERIES, {24: best}, names).toPandas()
    assert sorted(out.city) == ["a", "b", "tiny"] and out.prediction.between(0, 500).all()


def test_explanations(spark, training):
    train = training.where("city <> 'tiny'").na.fill(0.0, FEATURES)
    line = M.fit(train, FEATURES, "aqi", M.ridge)
    got = E.importance(line, train, SERIES, FEATURES).collect()
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)
    trees = M.fit(train, FEATURES, "aqi", lambda d, y: M.forest(d, y, numTrees=5, maxDepth=4))
    assert E.impurity_importance(trees, train, FEATURES).toPandas().importance.sum() == pytest.approx(1)
    shares = E.importance(trees, train, SERIES, FEATURES).toPandas()
    assert len(shares) == len(FEATURES) and shares.importance.is_monotonic_decreasing
    for bucket_rows in (50_000, 40):
        moved = E.permutation_importance(trees, train, FEATURES, "aqi", bucket_rows=bucket_rows).toPandas().set_index("feature").importance
        assert moved.idxmin() == "pm10" and moved.max() > 5


def test_whole_chain(spark):
    _, df = table(spark, {"a": 150, "b": 120}, nulls=0.1)
    ready = gold(clean(df.withColumnRenamed("ts", "timestamp"), ["city"], ["id"]), ["city"])
    series = Series(("city",), "timestamp")
    metrics, models = M.train_grid(ready.drop("id"), series, horizons=(24,), models={"ridge": M.ridge})
    names = [c for c in ready.drop("id").columns if c in M.select_features(ready.drop("id"))]
    out = M.score(ready, series, {24: models["ridge", 24]}, names)
    assert metrics.count() == 1 and out.count() == 2


def test_null_numbers_do_not_become_nan(spark):
    pdf, df = table(spark, {"a": 40})
    out = gold(df.withColumnRenamed("ts", "timestamp"), ["city"], fill=False)
    doubles = [c for c, kind in out.dtypes if kind == "double"]
    assert out.where(" or ".join(f"isnan(`{c}`)" for c in doubles)).count() == 0


def test_upsert_keeps_text_partitions_null_partitions_and_picks_by_ties(spark, tmp_path):
    path = str(tmp_path / "keyed")
    schema = "city string, id long, v long, at long"
    first = spark.createDataFrame([("001", 1, 10, 0), (None, 2, 20, 0), (None, 3, 30, 0)], schema)
    T.upsert_features(first, path, ["city", "id"], "city", ["at"])
    new = spark.createDataFrame([("001", 1, 11, 1), ("001", 1, 12, 2), (None, 2, 21, 1)], schema)
    T.upsert_features(new, path, ["city", "id"], "city", ["at"])
    got = T.read_keyed(spark, path, new.schema, "city")
    assert sorted(((r.city or "", r.id, r.v) for r in got.collect())) == [("", 2, 21), ("", 3, 30), ("001", 1, 12)]


def test_checksum_sees_repeated_rows(spark):
    def of(values):
        return T.checksum(spark.createDataFrame([(v,) for v in values], "v long")).first().fingerprint

    assert len({of([1, 1, 5]), of([2, 2, 5]), of([5])}) == 3 and of([5, 1]) == of([1, 5])


def test_rows_with_null_keys_and_repeated_times_stay(spark):
    rows = spark.createDataFrame(
        [("a", "2026-04-01 00:00", 1, 1.0), ("a", "2026-04-01 00:00", 2, 2.0), ("a", "2026-04-01 01:00", 3, 3.0), (None, "2026-04-01 00:00", 4, 4.0),
         (None, "2026-04-01 01:00", 5, 5.0), ("a", None, 6, 6.0), ("a", None, 7, 7.0)], "city string, ts string, id long, v double",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.v_at_1h for r in lag_time(rows, SERIES, ["v"], [1]).collect()}
    assert got == {1: None, 2: None, 3: 2.0, 4: None, 5: 4.0, 6: None, 7: None}
    assert min_rows_guard(rows, ["city"], 2).count() == 7 and min_rows_guard(rows, ["city"], 3).count() == 5
    asked = rows.select(F.col("id").alias("ask"), "city", "ts")
    found = {r.ask: r.v for r in pit_join(asked, rows, ["city"], "ts", "ts", ["v"], ties=["id"]).collect()}
    assert found[1] == found[2] == 2.0 and found[4] is None and found[5] is None


def test_landed_payloads_become_raw_readings(spark, tmp_path):
    path = str(tmp_path / "raw")
    air = json.dumps({"status": "ok", "data": {"aqi": 42, "iaqi": {"pm25": {"v": 11.0}}}})
    weather = json.dumps({"hourly": {"time": ["2026-07-01T11:00", "2026-07-01T12:00", "2026-07-01T13:00"], "temperature_2m": [30.0, 31.0, 32.0]}})
    I.land(spark.createDataFrame([("a", air)], "city string, body string"), spark.createDataFrame([("a", weather), ("b", weather)], "city string, body string"),
           "body", ["city"], now(), path)
    got = {r.city: r for r in I.raw_table(spark, path).collect()}
    assert (got["a"].aqi, got["a"].pm25, got["a"].temperature, got["a"].station_name) == (42.0, 11.0, 31.0, "a")
    assert got["b"].aqi is None and got["b"].temperature == 31.0 and got["b"].timestamp is not None


def test_refresh_equals_the_whole_recompute(spark, tmp_path):
    _, df = table(spark, {"a": 120, "b": 100})
    df = df.drop("id")
    series, path = Series(("city",), "ts"), str(tmp_path / "features")
    whole = short_features(df, series)
    T.upsert_features(whole.where("ts < '2026-04-04'").withColumn("aqi_change", F.lit(0.0)), path, ["city", "ts"], "city")
    I.refresh(df, F.lit("2026-04-03").cast("timestamp"), path, series, "city")
    got = T.read_keyed(spark, path, whole.schema, "city").where("ts >= '2026-04-03'").select(*whole.columns).orderBy("city", "ts").toPandas()
    pd.testing.assert_frame_equal(got, whole.where("ts >= '2026-04-03'").orderBy("city", "ts").toPandas(), check_dtype=False)


def test_refresh_counts_rows_over_a_hole(spark, tmp_path):
    """A hole of days, a series that begins late, one without new rows: frames still see the rows before."""
    _, df = table(spark, {"a": 200, "b": 150, "c": 40}, nulls=0.1)
    df = df.drop("id").where("ts < '2026-04-03 12:00' OR ts >= '2026-04-07' OR city = 'b'").where("city <> 'b' OR ts >= '2026-04-07 06:00'")
    series, path = Series(("city",), "ts"), str(tmp_path / "features")
    whole = short_features(df, series)
    T.upsert_features(whole.where("ts < '2026-04-07'"), path, ["city", "ts"], "city")
    made = I.refresh(df, F.lit("2026-04-07").cast("timestamp"), path, series, "city")
    want = whole.where("ts >= '2026-04-07'").orderBy("city", "ts").toPandas()
    assert len(want) > 50 and want[want.city == "a"].iloc[0].filter(like="lag_24").notna().any()
    pd.testing.assert_frame_equal(made.select(*whole.columns).orderBy("city", "ts").toPandas(), want, check_dtype=False)
    assert T.read_keyed(spark, path, whole.schema, "city").count() == whole.count()


def test_exact_p_values_equal_enumeration(spark):
    rows = [(n, m, k / (n * m)) for n in range(1, 9) for m in range(1, 9) for k in {1, n * m // 3, n * m // 2, n * m} - {0}]
    df = spark.createDataFrame(rows, "n long, m long, ks double")
    for r in df.select("*", D.ks_pvalue(F.col("ks"), F.col("n"), F.col("m")).alias("p")).collect():
        far = total = 0
        for first in combinations(range(r.n + r.m), r.n):
            steps = np.isin(np.arange(r.n + r.m), first)
            i, j = np.cumsum(steps), np.cumsum(~steps)
            far += (np.abs(i * r.m - j * r.n) >= round(r.ks * r.n * r.m)).any()
            total += 1
        assert r.p == pytest.approx(far / total), r
    large = spark.createDataFrame([(100, 100, 0.19), (101, 100, 0.19)], "n long, m long, ks double")
    exact, near = (r.p for r in large.select("n", D.ks_pvalue(F.col("ks"), F.col("n"), F.col("m")).alias("p")).orderBy("n").collect())
    assert exact == pytest.approx(near, abs=0.01) and exact != near


def test_gaps_findings_and_drift_log(spark, tmp_path):
    times = ["2026-04-01 00:00", "2026-04-01 01:00", "2026-04-01 05:00"]
    df = spark.createDataFrame([("a", t, i, float(i)) for i, t in enumerate(times)], "city string, ts string, id long, v double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.city, r.hours) for r in quality.gap_list(df, SERIES).collect()] == [("a", 4.0)]
    found = quality.failed_checks(df.withColumn("v", F.when(F.col("id") == 1, F.col("v"))), SERIES, ["v"]).collect()
    assert {(r.check, r.column) for r in found} >= {("gaps", None), ("missing", "v")}
    for day in (1, 2):
        report = drift_report(drift_detail(df, df, ["v"], ["city"]), ["city"])
        drift_log_append(report, str(tmp_path / "log"), F.lit(f"2026-05-0{day}").cast("timestamp"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and log.where("status = 'no_drift'").count() == 2
