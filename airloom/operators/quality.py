"""Data quality reports.

Reports are aggregates with map-side combine; per-column figures come from one pass over all
columns. ``key`` may be empty: then the report is about the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.config import (
    FRESH_HOURS, GAP_LIMIT, MIN_VALID_ROWS, MISSING_LIMIT, OUTLIER_FACTOR, OUTLIER_LIMIT,
)
from airloom.functions.scalars import hours_between
from airloom.operators.ordered import Layout, Series, join_back, with_rows
from airloom.operators.quantiles import BUFFER_ROWS, quantiles
from airloom.session import settled


def _entries(key: Sequence[str], entries: Mapping[str, Sequence[Column]], source: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column out of a wide aggregate."""
    rows = [F.struct(F.lit(c).alias("column"), *[v.alias(n) for v, n in zip(vs, names)]) for c, vs in entries.items()]
    return source.select(*key, F.explode(F.array(*rows)).alias("_e")).select(*key, "_e.*")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, key: Sequence[str] = (), limit: float = MISSING_LIMIT):
    """Null count and percentage per column: error above the limit, warning above 0."""
    cols = [c for c in (cols or df.columns) if c not in key]
    wide = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c_{c}") for c in cols])
    counts = {c: [F.col("_n") - F.col(f"_c_{c}"), F.try_divide(100.0 * (F.col("_n") - F.col(f"_c_{c}")), F.col("_n"))] for c in cols}
    out = _entries(key, counts, wide, ["missing", "percentage"])
    severity = F.when(F.col("percentage") > limit, "error").when(F.col("missing") > 0, "warning").otherwise("ok")
    return out.withColumns({"percentage": F.round("percentage", 2), "severity": severity})


def outlier_report(
    df: DataFrame,
    cols: Sequence[str],
    key: Sequence[str] = (),
    factor: float = OUTLIER_FACTOR,
    buffer_rows: int = BUFFER_ROWS,
    groups: tuple[int, int] | None = None,
):
    """Count, share and bounds of values beyond ``factor`` interquartile ranges.

    Columns without values or with an interquartile range of 0 are left out. ``groups`` gives the
    number of keys and the rows of the largest, which are counted otherwise.
    """
    if groups is None:
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)), F.max("_n")).first()
        groups = sizes[0], sizes[1] or 0
    keys, largest = groups
    q = quantiles(df, key, cols, buffer_rows=buffer_rows, largest=largest)
    q = q.select(*key, "feature", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    wide = q.groupBy(*key).agg(*[
        F.max(F.when(F.col("feature") == c, F.col(b))).alias(f"_{b}_{c}") for c in cols for b in ("q1", "q3")
    ])
    rows = join_back(df.select(*key, *cols), wide, key, keys)

    def reach(c):
        return factor * (F.col(f"_q3_{c}") - F.col(f"_q1_{c}"))

    outside = {c: (F.col(c) < F.col(f"_q1_{c}") - reach(c)) | (F.col(c) > F.col(f"_q3_{c}") + reach(c)) for c in cols}
    counted = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.when(test, 1).otherwise(0)).alias(f"_o_{c}") for c, test in outside.items()],
        *[F.max(f"_{b}_{c}").alias(f"_{b}_{c}") for c in cols for b in ("q1", "q3")],
    )
    entries = {
        c: [
            F.col(f"_o_{c}"),
            100.0 * F.col(f"_o_{c}") / F.col("_n"),
            F.col(f"_q1_{c}") - reach(c),
            F.col(f"_q3_{c}") + reach(c),
        ]
        for c in cols
    }
    out = _entries(key, entries, counted, ["outliers", "percentage", "lower", "upper"]).where(F.col("upper") > F.col("lower"))
    severity = F.when(F.col("percentage") > OUTLIER_LIMIT, "high").when(F.col("outliers") > 0, "warning").otherwise("ok")
    rounded = {c: F.round(c, 2) for c in ("percentage", "lower", "upper")}
    return out.withColumn("severity", severity).withColumns(rounded)


def dup_count(df: DataFrame, series: Series) -> DataFrame:
    """Rows beyond the first per key and time."""
    times = df.groupBy(*series.key, series.ts).agg(F.count(F.lit(1)).alias("_n"))
    return times.groupBy(*series.key).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def gap_report(
    df: DataFrame, series: Series, step_hours: float = 1.0, count_first: bool = False, layout: Layout | None = None
) -> DataFrame:
    """Rows whose distance to the row before is not one step: how many, how long, which share.

    The first row of a series has no row before it and is no gap; ``count_first`` counts it anyway,
    as tools do that compare a missing difference with the step.
    """
    return _spacing(df, series, step_hours, count_first, layout).drop("duplicates")


def _spacing(
    df: DataFrame, series: Series, step_hours: float, count_first: bool, layout: Layout | None, more: Sequence[Column] = (), cols: Sequence[str] = ()
) -> DataFrame:
    """Rows and gaps per series, and ``more`` aggregates of ``cols`` in the same pass."""
    placed = with_rows(
        df.select(*dict.fromkeys([*series.key, *series.order, *cols])), series, lambda w: {"_before": F.lag(series.ts).over(w)}, before=1, layout=layout
    )
    hours = hours_between("_before", series.ts)
    gap = (hours != step_hours) if not count_first else (hours.isNull() | (hours != step_hours))
    out = placed.groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(gap, 1).otherwise(0)).alias("gaps"),
        F.sum(F.when(hours > step_hours, 1).otherwise(0)).alias("long_gaps"),
        F.sum(F.when(gap, hours)).alias("gap_hours"),
        F.max(F.when(gap, hours)).alias("max_gap_hours"),
        F.sum(F.when(hours == 0, 1).otherwise(0)).alias("duplicates"),
        *more,
    )
    share = 100.0 * F.col("gaps") / F.col("rows")
    severity = F.when(share > GAP_LIMIT, "error").when(F.col("gaps") > 0, "warning").otherwise("ok")
    return out.withColumns({"severity": severity, "percentage": F.round(share, 2)})


def gap_list(df: DataFrame, series: Series, step_hours: float = 1.0, layout: Layout | None = None) -> DataFrame:
    """One row per gap: series, the times on both sides and the hours between them."""
    placed = with_rows(
        df.select(*series.key, *series.order), series, lambda w: {"_before": F.lag(series.ts).over(w)}, before=1, layout=layout
    )
    hours = hours_between("_before", series.ts)
    return placed.where(hours != step_hours).select(*series.key, F.col("_before").alias("start"), F.col(series.ts).alias("end"), hours.alias("hours"))


def failed_checks(df: DataFrame, series: Series, cols: Sequence[str], buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """The findings behind a quality score, one row each: series, check, column (null for time checks),
    severity and how much of the series it concerns in percent."""
    gaps = gap_report(df, series).where(F.col("severity") != "ok")
    parts = [gaps.select(*series.key, F.lit("gaps").alias("check"), F.lit(None).cast("string").alias("column"), "severity", "percentage")]
    for name, report in (("missing", missing_report(df, cols, series.key)), ("outliers", outlier_report(df, cols, series.key, buffer_rows=buffer_rows))):
        found = report.where(F.col("severity") != "ok")
        parts.append(found.select(*series.key, F.lit(name).alias("check"), "column", "severity", "percentage"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def time_range(df: DataFrame, ts: str, key: Sequence[str] = ()) -> DataFrame:
    """First and last time and the whole days between them."""
    out = df.groupBy(*key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.withColumn("duration_days", F.floor(hours_between("start", "end") / 24).cast("long"))


def sorted_check(df: DataFrame, series: Series, arrival: str, layout: Layout | None = None) -> DataFrame:
    """Whether each series arrived in time order; ``arrival`` numbers the rows as they came."""
    as_arrived = Series(series.key, arrival, chunk_rows=series.chunk_rows)
    placed = with_rows(
        df.select(*series.key, arrival, series.ts),
        as_arrived,
        lambda w: {"_before": F.lag(series.ts).over(w)},
        before=1,
        layout=layout,
    )
    back = F.sum(F.when(F.col("_before") > F.col(series.ts), 1).otherwise(0))
    return placed.groupBy(*series.key).agg(back.alias("steps_back"), (back == 0).alias("is_sorted"))


def type_check(df: DataFrame, required: Sequence[str], ts: str) -> DataFrame:
    """One row per required column: present, and of the right kind. Reads the schema only."""
    kinds = {f.name: f.dataType for f in df.schema}
    rows = []
    for c in required:
        kind = kinds.get(c)
        wanted = (T.TimestampType, T.TimestampNTZType, T.DateType) if c == ts else T.NumericType
        rows.append((c, kind is not None, kind.simpleString() if kind else None, isinstance(kind, wanted)))
    return df.sparkSession.createDataFrame(rows, "column string, present boolean, type string, valid boolean")


def dtype_census(df: DataFrame) -> DataFrame:
    """Number of columns per type. Reads the schema only."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "type string, columns long")


def value_ranges(df: DataFrame, cols: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Lowest and highest value of the columns that are present."""
    cols = [c for c in cols if c in df.columns]
    wide = df.groupBy(*key).agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    return _entries(key, {c: [F.col(f"_lo_{c}"), F.col(f"_hi_{c}")] for c in cols}, wide, ["lowest", "highest"])


# Plausible ranges before a table is accepted.
SANE = {"aqi": (0.0, 1000.0), "temperature": (-50.0, 60.0)}


def range_sanity(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = SANE, key: Sequence[str] = ()) -> DataFrame:
    """Value ranges with a warning where they leave the plausible range."""
    found = value_ranges(df, list(ranges), key)
    warn = F.lit(False)
    for c, (low, high) in ranges.items():
        warn = warn | ((F.col("column") == c) & ((F.col("lowest") < low) | (F.col("highest") > high)))
    return found.withColumn("warning", F.coalesce(warn, F.lit(False)))


def freshness(df: DataFrame, ts: str, now: Column, key: Sequence[str] = (), hours: float = FRESH_HOURS) -> DataFrame:
    """Age of the newest row in hours, and whether it is below the limit."""
    out = df.groupBy(*key).agg(F.max(ts).alias("newest")).withColumn("age_hours", hours_between("newest", now))
    return out.withColumn("is_fresh", F.coalesce(F.col("age_hours") < hours, F.lit(False)))


def describe(df: DataFrame, cols: Sequence[str], key: Sequence[str] = (), buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Count, mean, deviation, quartiles and extremes per column."""
    how = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*key).agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in cols for n, f in how.items()])
    long = _entries(key, {c: [F.col(f"_{n}_{c}") for n in how] for c in cols}, wide, list(how))
    q = quantiles(df, key, cols, (0.25, 0.5, 0.75), buffer_rows).withColumnRenamed("feature", "column")
    out = join_back(long, q, [*key, "column"])
    picks = {n: F.get("q", F.lit(i)) for i, n in enumerate(("p25", "p50", "p75"))}
    return out.withColumns(picks).withColumn("count", F.col("count").cast("long")).drop("q")


def quality_score(
    df: DataFrame,
    series: Series,
    cols: Sequence[str],
    arrival: str | None = None,
    min_rows: int = MIN_VALID_ROWS,
    strict: bool = False,
    outlier_cols: Sequence[str] | None = None,
    count_first: bool = False,
    naive_time: bool | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """One row per series: counts of errors and warnings, score and verdict.

    From 100, 5 points go for each time and missing-value warning and 10 for any outlier warning.
    A series below ``min_rows`` scores its share of them. Missing or mistyped columns score 50 for
    every series, duplicate times and too many gaps end the checks early. In ``strict`` mode a
    warning is enough to fail.
    """
    kinds = dict(df.dtypes)
    needed = [series.ts, *cols]
    usable = all(c in kinds for c in needed) and all(isinstance(df.schema[c].dataType, T.NumericType) for c in cols)
    if naive_time is None:
        naive_time = kinds.get(series.ts) == "timestamp_ntz"
    small = F.col("rows") < min_rows
    if not usable:
        sizes = df.groupBy(*series.key).agg(F.count(F.lit(1)).alias("rows"))
        return sizes.select(
            *series.key, "rows", F.lit(1).alias("errors"), F.lit(0).alias("warnings"), F.lit(False).alias("is_valid"),
            F.when(small, F.round(100.0 * F.col("rows") / min_rows, 2)).otherwise(50.0).alias("quality_score"),
        )

    # One pass for rows, gaps and missing values; it is written, as the outliers ask for its sizes.
    spacing = _spacing(df, series, 1.0, count_first, None, [F.count(c).alias(f"_c{i}") for i, c in enumerate(cols)], cols)
    lost = [100.0 * (F.col("rows") - F.col(f"_c{i}")) / F.col("rows") for i in range(len(cols))]

    def columns(test) -> Column:
        return sum((F.when(test(x), 1).otherwise(0) for x in lost), F.lit(0))

    spacing = settled(spacing.select(
        *series.key, "rows", "duplicates", F.col("severity").alias("_gaps"), columns(lambda x: x > MISSING_LIMIT).alias("_mis_err"),
        columns(lambda x: (x > 0) & (x <= MISSING_LIMIT)).alias("_mis_warn"),
    ), "spacing")
    keys, largest = spacing.agg(F.count(F.lit(1)), F.max("rows")).first()
    outliers = outlier_report(df, outlier_cols or cols, series.key, buffer_rows=buffer_rows, groups=(keys, largest or 0))
    outliers = outliers.groupBy(*series.key).agg(F.sum(F.when(F.col("severity") != "ok", 1).otherwise(0)).alias("_out_warn"))
    out = join_back(spacing, outliers, series.key, keys)
    if arrival:
        order = sorted_check(df, series, arrival).select(*series.key, (~F.col("is_sorted")).cast("int").alias("_unsorted"))
        out = join_back(out, order, series.key, keys)
    else:
        out = out.withColumn("_unsorted", F.lit(0))

    repeated = F.col("duplicates") > 0
    holes = ~repeated & (F.col("_gaps") == "error")
    early = repeated | holes
    time_warn = F.col("_unsorted") + F.when(~repeated & (F.col("_gaps") == "warning"), 1).otherwise(0)
    out_warn = F.coalesce(F.col("_out_warn"), F.lit(0))
    errors = F.when(small, 1).when(early, 1).otherwise(F.col("_mis_err"))
    full = time_warn + F.col("_mis_warn") + out_warn + int(naive_time)
    warned = F.when(small, 0).when(early, time_warn).otherwise(full)
    score = 100.0 - 5 * time_warn - F.when(early, 0).otherwise(5 * F.col("_mis_warn") + F.when(out_warn > 0, 10).otherwise(0))
    score = F.when(small, 100.0 * F.col("rows") / min_rows).otherwise(F.greatest(F.lit(0.0), score))
    valid = (errors == 0) & (F.lit(not strict) | (warned == 0))
    return out.select(
        *series.key,
        "rows",
        errors.cast("int").alias("errors"),
        warned.cast("int").alias("warnings"),
        valid.alias("is_valid"),
        F.round(score, 2).alias("quality_score"),
    )
