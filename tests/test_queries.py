"""Registered queries run the operators whole."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from airloom import session
from airloom.config import HORIZONS
from airloom.operators.features import long_features
from airloom.plans.readings import gold
from airloom.plans.training import BOOST, FOREST, MODELS
from airloom.queries import QUERIES, SQL, models, streams
from airloom.queries.base import READ, Tables
from data import DATA


def test_imputation_runs_all_stages(spark):
    stats = QUERIES["impute_stats"](spark, DATA).collect()
    assert all(r.filled_knn > 0 and r.filled_mean == 0 and r.missing_after == 0 for r in stats) and stats
    assert QUERIES["impute_batch"](spark, DATA).where(F.col("aqi").isNull()).count() == 0


@pytest.mark.parametrize("name", ["clean_readings", "clean_readings_cut"])
def test_cleaning_keeps_readings_of_equal_time(spark, tmp_path, name):
    events = spark.read.parquet(f"{DATA}/events.parquet").where("event_id < 300")
    events.unionByName(events.withColumn("event_id", F.col("event_id") + 300)).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    cols = "event_id, city, timestamp, aqi"
    want = db.execute(f"SELECT {cols} FROM ({SQL[name]}) ORDER BY event_id").fetchall()
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*cols.split(", ")).orderBy("event_id").collect()] == want


@pytest.mark.parametrize("name", ["st_features_late", "st_features"])
def test_stream_parts_are_written_and_kept_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """Each of the four parts is one micro-batch of several files, and the stored rows are written once a batch."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for city, one in (("click", 1000), ("view", 2000)):  # series of other sizes, with equal times
        events = events.unionByName(events.where(F.col("event_type") == city).withColumn("event_id", F.col("event_id") + one * 100))
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    made = []

    def named(spark, kind):
        made.append((kind, str(tmp_path / f"{kind}-{len(made)}")))
        return made[-1][1]

    monkeypatch.setattr(streams, "scratch", named)
    monkeypatch.setattr(session, "scratch", named)
    got = {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("event_id", "aqi_lag_24h", "aqi_roll_mean_6h").collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(db.execute(SQL[name]).fetchall())
    kinds = {kind: path for kind, path in made}
    written = Counter(p.name.split("-", 2)[2] for p in Path(kinds["landed"]).glob("part-*.parquet"))
    assert len(written) == 4 and min(written.values()) > 1
    assert sorted(p.name for p in Path(kinds["features"]).glob("batch=*")) == [f"batch={i}" for i in range(4)]
    assert "state" not in kinds


class Seen(Exception):
    pass


def test_models_are_registered_with_production_settings(spark, monkeypatch):
    """What the queries ask for, without fitting it."""
    def fit(train, features, label, make):
        raise Seen(make(train, label))

    def train_grid(table, series, target, horizons, grid, features):
        raise Seen(list(horizons), dict(grid))

    monkeypatch.setattr(models.M, "fit", fit)
    monkeypatch.setattr(models.M, "train_grid", train_grid)

    def asked(name):
        with pytest.raises(Seen) as seen:
            QUERIES[name](spark, DATA)
        return seen.value.args

    for name, wanted in (("fit_forest", FOREST), ("importance_permuted", FOREST), ("fit_boost", BOOST)):
        (made,) = asked(name)
        assert {k: made.getOrDefault(k) for k in wanted} == wanted
    for name in ("train_grid", "train_grid_properties", "registry"):
        assert asked(name) == (HORIZONS, MODELS)


def test_feature_tables_return_all_columns(spark):
    t = Tables(spark, DATA)
    short = gold(t.hourly.drop("event_id").withColumnRenamed("ts", "timestamp"), ["city"])
    assert QUERIES["feature_table"](spark, DATA).columns == short.columns
    assert QUERIES["long_feature_table"](spark, DATA).columns == long_features(t.readings, READ).columns
