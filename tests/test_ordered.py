"""Cut series must give exactly what the plain window gives."""

from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airloom.operators import ordered
from airloom.operators.ordered import (
    Series, measure, with_nearest, with_ordinal, with_rows, with_span_means, with_totals,
)
from airloom.session import settled
from frames import collected, table

SERIES = Series(("city",), "ts", ("id",))
CUT = SERIES.cut_at(40)


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, {"hot": 600, "mid": 90, "cold": 30})[1].cache()


def equal(a, b):
    a, b = collected(a, "id"), collected(b, "id")
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False)


def test_only_large_series_are_cut(rows):
    assert measure(rows, SERIES).plain
    cuts = {r["_k0"]: r["_cuts"] for r in measure(rows, CUT).cuts.collect()}
    assert set(cuts) == {"hot", "mid"} and len(cuts["hot"]) > 5


def test_every_chunk_holds_enough_rows(rows):
    layout = measure(rows, CUT, need=24)
    got = layout.assign(rows).where("_cut").groupBy("city", "_chunk").count().collect()
    assert min(r["count"] for r in got) >= 24


def test_row_frames(rows):
    def stage(w):
        return {
            "lag": F.lag("aqi", 24).over(w),
            "mean": F.avg("aqi").over(w.rowsBetween(-11, 0)),
            "lead": F.lead("aqi", 5).over(w),
        }

    def second(w):
        return {"twice": F.avg(F.col("aqi") - F.col("lag")).over(w.rowsBetween(-2, 0))}

    a = with_rows(rows, SERIES, stage, second, before=26, after=5)
    b = with_rows(rows, CUT, stage, second, before=26, after=5)
    equal(a, b)


@pytest.mark.parametrize("series", [SERIES, SERIES.cut_at(40)])
def test_row_frames_without_replaced_rows(rows, series):
    """Rows that come again, some of them often, are left out before any frame, also beside a cut."""
    often = F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 50 < 10, 9).otherwise(1)))
    new = rows.where("id % 2 = 0 AND id % 7 < 5").withColumns({"aqi": F.lit(-1.0), "_new": F.lit(True)})
    old = rows.where("id % 3 > 0").withColumn("_new", F.lit(False))
    both = settled(new.unionByName(old.withColumn("_n", often).drop("_n")))
    layout = measure(both, series, 12, places=True)
    kept = new.unionByName(old.join(new.select("id"), "id", "left_anti").withColumn("_n", often).drop("_n"))

    def stage(w):  # equal rows have equal values, so their order does not matter
        return {"lag": F.lag("aqi", 12).over(w), "any": F.max("_new").over(w.rowsBetween(-12, 0))}

    got, want = (
        sorted(map(str, d.select("city", "ts", "id", "aqi", "_new", "lag", "any").collect()))
        for d in (with_rows(both, series, stage, before=12, layout=layout, replaced_by="_new"), with_rows(kept, SERIES, stage, before=12))
    )
    assert got == want
    if not layout.plain:
        found = layout.assign(both).where("_cut").groupBy("city", "_chunk").agg(F.countDistinct("id").alias("places")).collect()
        assert len(found) > 10 and min(r.places for r in found) >= 12


def test_frames_longer_than_the_chunk_raise_its_size(rows):
    def stage(w):
        return {"lag": F.lag("aqi", 100).over(w)}

    equal(with_rows(rows, SERIES, stage, before=100), with_rows(rows, CUT, stage, before=100))


def means(spans):
    return {f"m{h}": ("aqi", timedelta(hours=h)) for h in spans}


def test_time_frames(rows):
    """Spans shorter than, and several times as long as a chunk."""
    equal(with_span_means(rows, SERIES, means([6, 24, 200])), with_span_means(rows, CUT, means([6, 24, 200])))
    lumpy = rows.withColumn("ts", F.date_trunc("day", "ts"))  # a day exceeds the chunk
    equal(with_span_means(lumpy, SERIES, means([48])), with_span_means(lumpy, SERIES.cut_at(10), means([48])))


def test_time_frames_sum_each_row_once_a_span(spark):
    """A frame that holds all rows costs no more than a short one, and shares no row with other series, nulls included."""
    rows = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS city", "CASE WHEN id % 50 = 7 THEN NULL ELSE CAST(id % 1000 AS DOUBLE) END AS aqi",
        "CASE WHEN id % 101 = 0 THEN NULL ELSE timestamp_ntz'1969-12-31 23:30:00' + make_dt_interval(0, 0, 0, id div 2 * 2 + 0.000001 * (id % 4 div 2)) END AS ts")
    rows = settled(rows)
    back = "RANGE BETWEEN INTERVAL '1799.999999' SECOND PRECEDING AND CURRENT ROW"
    want = rows.withColumn("m", F.expr(f"avg(aqi) OVER (PARTITION BY city ORDER BY ts {back})"))
    for series in (SERIES, CUT):
        made = with_span_means(rows, series, {"m": ("aqi", timedelta(minutes=30))})
        equal(made, want)
        plan = made._jdf.queryExecution().toString()
        assert "RangeFrame, -" not in plan and "sequence(_own" not in plan


@pytest.mark.parametrize("later", [False, True])
def test_nearest_non_null(rows, later):
    sparse = rows.withColumn("aqi", F.when(F.col("id") % 37 == 0, F.col("aqi")))
    cols = {"near": "aqi", "pm25": "pm25"}
    equal(with_nearest(sparse, SERIES, cols, later), with_nearest(sparse, CUT, cols, later))


def test_totals_and_ordinals(rows):
    m = {"run": F.coalesce("aqi", F.lit(0.0)), "seen": F.col("aqi").isNotNull().cast("long")}
    equal(with_totals(rows, SERIES, m), with_totals(rows, CUT, m))
    plain = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("city").orderBy("ts", "id")))
    equal(plain, with_ordinal(rows, CUT))


def test_ordering_by_value_with_ties_and_nulls(rows):
    by_value = Series(("city",), "aqi", ("id",), 50)
    plain = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("city").orderBy("aqi", "id")))
    equal(plain, with_ordinal(rows, by_value))


def test_one_timestamp_holding_most_rows(rows):
    lumpy = rows.withColumn("ts", F.when(F.col("id") % 3 > 0, F.lit("2026-04-05").cast("timestamp")).otherwise(F.col("ts")))
    plain = lumpy.withColumn("l", F.lag("pm10", 3).over(SERIES.window()))
    equal(plain, with_rows(lumpy, CUT, lambda w: {"l": F.lag("pm10", 3).over(w)}, before=3))


def test_null_key_and_local_time_type(rows):
    ntz = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("city", F.when(F.col("city") != "hot", F.col("city")))
    equal(with_ordinal(ntz, SERIES), with_ordinal(ntz, CUT))
    equal(with_span_means(ntz, SERIES, means([9])), with_span_means(ntz, CUT, means([9])))


def test_one_time_is_cut_by_its_ties(rows):
    same = rows.withColumn("ts", F.lit("2026-04-05").cast("timestamp"))
    layout = measure(same, CUT, need=5)
    sizes = [r["count"] for r in layout.assign(same).where("city = 'hot'").groupBy("_chunk").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 120
    plain = same.withColumn("l", F.lag("pm10", 3).over(SERIES.window()))
    equal(plain, with_rows(same, CUT, lambda w: {"l": F.lag("pm10", 3).over(w)}, before=3))


def test_any_number_of_series_is_cut(spark):
    many = spark.range(0, 40_000, 1, 4).selectExpr("id", "id % 10500 AS city", "timestamp_seconds(id) AS ts")
    series = Series(("city",), "ts", ("id",), 2)
    layout = measure(many, series)
    assert layout.cuts.count() == 10_500
    got = with_ordinal(many, series).groupBy("ordinal").count().collect()
    assert {r["ordinal"]: r["count"] for r in got} == {1: 10_500, 2: 10_500, 3: 10_500, 4: 8_500}


def test_a_tree_of_several_levels(rows, monkeypatch):
    """Series with cuts on one, two and three levels, among them one that ends at a full node."""
    monkeypatch.setattr(ordered, "FAN", 4)
    small = SERIES.cut_at(12)
    layout = measure(rows, small, need=3)
    nodes = layout.cuts.collect()
    assert layout.depth == 3 and max(len(n["_cuts"]) for n in nodes) == 3
    got = layout.assign(rows)
    per = got.where("city = 'hot'").groupBy("_chunk").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    per = per.orderBy("_chunk").collect()
    assert [r["_chunk"] for r in per] == list(range(sum(len(n["_cuts"]) for n in nodes if n["_k0"] == "hot") + 1))
    assert all(x["b"] <= y["a"] for x, y in zip(per, per[1:])) and min(r["n"] for r in per) >= 3
    assert got.where("_cut").select("city").distinct().count() == 3
    equal(with_ordinal(rows, SERIES), with_ordinal(rows, small))
    equal(with_rows(rows, SERIES, lambda w: {"l": F.lag("aqi", 6).over(w)}, before=6), with_rows(rows, small, lambda w: {"l": F.lag("aqi", 6).over(w)}, before=6))
    equal(with_span_means(rows, SERIES, means([6, 90])), with_span_means(rows, small, means([6, 90])))
    cols = {"near": "pm25"}
    equal(with_nearest(rows, SERIES, cols), with_nearest(rows, small, cols))


def test_chunks_keep_their_least_rows_among_ties(spark):
    """Runs of equal rows longer than a piece and than a chunk; nothing but time orders them."""
    runs = [30, 1, 7, 200, 3, 90, 2, 2, 2, 140, 50, 11, 300, 1, 1, 64, 5]
    rows = [("a", i, ) for i, n in enumerate(runs) for _ in range(n)]
    df = spark.createDataFrame(rows, "city string, day int").withColumn("ts", F.timestamp_seconds("day"))
    for limit, need in [(40, 0), (60, 25), (8, 4), (3, 0)]:
        layout = measure(df, Series(("city",), "ts", (), limit), need)
        sizes = [r["count"] for r in layout.assign(df).groupBy("_chunk").count().collect()]
        assert len(sizes) > 3 and min(sizes) >= layout.least >= need


def test_a_layout_that_is_too_short_is_refused(rows):
    with pytest.raises(ValueError, match="measured for"):
        with_rows(rows, CUT, lambda w: {"l": F.lag("aqi", 100).over(w)}, before=100, layout=measure(rows, CUT, 1))


def test_an_intermediate_folder_goes_with_its_run(spark, rows, tmp_path):
    from pathlib import Path

    from airloom.session import run_folder

    with run_folder(spark) as folder:
        with_ordinal(rows, CUT).write.parquet(str(tmp_path / "out"))
        assert list(Path(folder.removeprefix("file:")).iterdir())
    assert not Path(folder.removeprefix("file:")).exists()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_one_shuffle_for_all_frames_of_a_plain_table(rows):
    out = with_rows(
        rows,
        SERIES,
        lambda w: {"a": F.lag("aqi").over(w), "b": F.avg("aqi").over(w.rowsBetween(-5, 0))},
        lambda w: {"c": F.avg("a").over(w.rowsBetween(-2, 0))},
        before=8,
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
