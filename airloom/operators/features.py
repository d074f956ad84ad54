"""Lag, rolling, change, calendar and interaction features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from airloom.config import LAG_HOURS, ROLLING_HOURS, FeatureSettings, LongFeatureSettings
from airloom.functions import scalars as S
from airloom.operators.impute import bfill, ffill, mean_fill
from airloom.operators.ordered import Layout, Series, join_back, measure, with_nearest, with_ordinal, with_rows, with_span_means
from airloom.operators.seasonal import seasoned, smoothing

# --- window columns, for use inside one ``with_rows`` call -------------------------------------


def lags(w: WindowSpec, column: str, counts: Sequence[int], name: str = "{c}_lag_{n}h") -> dict[str, Column]:
    return {name.format(c=column, n=n): F.lag(column, n).over(w) for n in counts}


def rolling(
    w: WindowSpec, column: str, counts: Sequence[int], stats: Sequence[str], name: str = "{c}_roll_{s}_{n}h"
) -> dict[str, Column]:
    """``stats`` out of mean, std (sample), min, max over the last ``n`` rows."""
    how = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return {
        name.format(c=column, s=s, n=n): how[s](column).over(w.rowsBetween(1 - n, 0)) for n in counts for s in stats
    }


def change(w: WindowSpec, column: str, n: int = 1) -> Column:
    return F.col(column) - F.lag(column, n).over(w)


# --- operators ---------------------------------------------------------------------------------


def lag_features(df, series: Series, cols: Sequence[str], counts: Sequence[int] = tuple(LAG_HOURS), layout: Layout | None = None):
    """Values ``n`` rows earlier."""
    return with_rows(df, series, lambda w: _all(lags(w, c, counts) for c in cols), before=max(counts), layout=layout)


def lag_time(df: DataFrame, series: Series, cols: Sequence[str], hours: Sequence[int] = tuple(LAG_HOURS)) -> DataFrame:
    """Values exactly ``n`` hours earlier, null when that hour is missing.

    Every row stays, also rows that share a key and time; such rows are looked back at by their last
    one in tie order. Each (key, time) sends the looked-at columns, and only those, to the times that
    look back at it, so neither row order nor a large series matters. A row without time has no lags.
    """
    key = [*series.key, series.ts]
    order = F.struct(*[F.col(c) for c in (series.ties or cols)])
    held = df.where(F.col(series.ts).isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_held"))
    sent = held.select("*", F.explode(F.array(*[F.lit(h) for h in hours])).alias("_step"))
    sent = sent.withColumn(series.ts, F.col(series.ts) + F.make_dt_interval(F.lit(0), F.col("_step")))
    found = sent.groupBy(*key).agg(*[
        F.max(F.when(F.col("_step") == h, F.col(f"_held.{c}"))).alias(f"{c}_at_{h}h") for c in cols for h in hours
    ])
    return join_back(df, found, key)


def lead_target(df, series: Series, column: str, horizon: int, name: str | None = None, layout: Layout | None = None):
    """The value ``horizon`` rows ahead; rows without one are dropped."""
    name = name or f"{column}_target_{horizon}h"
    out = with_rows(df, series, lambda w: {name: F.lead(column, horizon).over(w)}, after=horizon, layout=layout)
    return out.where(F.col(name).isNotNull())


def rolling_features(
    df, series: Series, cols: Sequence[str], counts=tuple(ROLLING_HOURS), stats=("mean", "std"), layout: Layout | None = None
):
    return with_rows(
        df, series, lambda w: _all(rolling(w, c, counts, stats) for c in cols), before=max(counts) - 1, layout=layout
    )


def rolling_time(df, series: Series, cols: Sequence[str], hours: Sequence[int] = tuple(ROLLING_HOURS)):
    """Means over the last ``n`` hours by the clock, current time included, start excluded by one microsecond."""
    return with_span_means(df, series, {f"{c}_time_mean_{h}h": (c, timedelta(hours=h)) for c in cols for h in hours})


def diff(df, series: Series, column: str, counts: Mapping[int, str], layout: Layout | None = None):
    """Change over ``n`` rows under the given names."""
    return with_rows(
        df, series, lambda w: {name: change(w, column, n) for n, name in counts.items()}, before=max(counts), layout=layout
    )


def pct_change(df: DataFrame, series: Series, column: str, name: str | None = None, layout: Layout | None = None) -> DataFrame:
    """Relative change of the forward-filled values; null where the value before is 0."""
    name = name or f"{column}_pct_change"
    layout = layout or measure(df, series, 1)
    filled = layout.rest(with_nearest(df, series, {"_filled": column}, False, layout))

    def stage(w):
        return {name: F.try_divide(F.col("_filled"), F.lag("_filled").over(w)) - 1}

    return with_rows(filled, series, stage, before=1, layout=layout).drop("_filled")


def momentum(df, series: Series, column: str, name: str | None = None, layout: Layout | None = None):
    """Mean of the one-row changes over the last six rows."""
    name = name or f"{column}_momentum"
    return with_rows(
        df,
        series,
        lambda w: {"_change": change(w, column)},
        lambda w: {name: F.avg("_change").over(w.rowsBetween(-5, 0))},
        before=6,
        layout=layout,
    ).drop("_change")


def accumulation(df, series: Series, column: str, name: str | None = None, layout: Layout | None = None):
    """Mean over the last three rows."""
    name = name or f"{column}_accumulation"
    return with_rows(df, series, lambda w: {name: F.avg(column).over(w.rowsBetween(-2, 0))}, before=2, layout=layout)


def standardize(df: DataFrame, key: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """``{column: new}``: distance from the series mean in sample deviations."""
    stats = df.groupBy(*key).agg(*[a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = join_back(df, stats, key)
    out = out.withColumns({n: S.standard_score(c, F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c, n in cols.items()})
    return out.drop(*[f"_{x}_{c}" for c in cols for x in "ms"])


def time_parts(df: DataFrame, ts: str) -> DataFrame:
    """Calendar columns of the short feature set."""
    around = S.cyclical(ts)
    return df.withColumns({
        "hour": S.hour(ts),
        "day_of_week": S.day_of_week(ts),
        "day_of_month": S.day_of_month(ts),
        "month": S.month(ts),
        "is_weekend": S.is_weekend(ts),
        "season": S.season(ts),
        **{c: around[c] for c in ("hour_sin", "hour_cos", "month_sin", "month_cos")},
    })


def ratios(df: DataFrame) -> DataFrame:
    made = {}
    if {"pm25", "pm10"} <= set(df.columns):
        made["pm25_pm10_ratio"] = S.ratio("pm25", "pm10")
    if {"o3", "no2"} <= set(df.columns):
        made["o3_no2_ratio"] = S.ratio("o3", "no2")
    return df.withColumns(made) if made else df


def _all(parts) -> dict[str, Column]:
    return {k: v for part in parts for k, v in part.items()}


def short_features(
    df: DataFrame, series: Series, settings: FeatureSettings = FeatureSettings(), layout: Layout | None = None
) -> DataFrame:
    """The live feature set: calendar, rolling mean and deviation, lags, change, ratios.

    All frames are made in one pass over one sort of the series.
    """
    cols = [c for c in settings.targets if c in df.columns]
    with_aqi = "aqi" in df.columns
    far = max(*settings.rolling, *settings.lags) + 1
    layout = layout or measure(df, series, far)
    if with_aqi:
        df = layout.rest(with_nearest(df, series, {"_filled": "aqi"}, False, layout))

    def stage(w):
        made = _all(rolling(w, c, settings.rolling, ("mean", "std")) for c in cols)
        if with_aqi:
            made |= lags(w, "aqi", settings.lags)
            made["aqi_change"] = change(w, "aqi")
            made["aqi_pct_change"] = F.try_divide(F.col("_filled"), F.lag("_filled").over(w)) - 1
        return made

    out = with_rows(df, series, stage, before=far, layout=layout).drop("_filled")
    return ratios(time_parts(out, series.ts))


#: Columns of the long set with lags, and with which rolling statistics.
LAGGED = ("aqi", "pm25", "pm10")
ROLLED = {"aqi": ("mean", "std", "min", "max"), "pm25": ("mean", "std")}


def long_features(
    df: DataFrame, series: Series, settings: LongFeatureSettings = LongFeatureSettings(), layout: Layout | None = None
) -> DataFrame:
    """The long feature set: more lags and statistics, weather indicators, interactions, season.

    ``settings.backfill`` also fills the warm-up rows from later ones and what is left from the
    series mean, which leaks the future into training data; it is off unless asked for.
    """
    need = {"aqi", "pm25", "pm10", "temperature", "humidity"}
    if missing := need - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    first = list(df.columns)
    far = max(max(settings.lags), max(settings.rolling), 7)
    period = settings.season_rows if settings.seasonal else 0
    layout = layout or measure(df, series, max(far, period))
    name = "{c}_rolling_{s}_{n}h"

    def stage(w):
        made = _all(lags(w, c, settings.lags) for c in LAGGED)
        made |= _all(rolling(w, c, settings.rolling, stats, name) for c, stats in ROLLED.items())
        made |= {"aqi_change_1h": change(w, "aqi", 1), "aqi_change_6h": change(w, "aqi", 6)}
        made["pm25_accumulation"] = F.avg("pm25").over(w.rowsBetween(-2, 0))
        return made

    def second(w):
        return {"aqi_momentum": F.avg("aqi_change_1h").over(w.rowsBetween(-5, 0))}

    # One pass over the rows makes all frames, those of the season too; a cut series is written once after it.
    out = standardize(df, series.key, {"temperature": "temp_normalized", "humidity": "humidity_normalized"})
    stages = [stage, second]
    if period:
        out = layout.rest(with_ordinal(out, series, "_at", layout))
        stages.append(smoothing("aqi", period))
    out = with_rows(out, series, *stages, before=max(far, period), after=period, layout=layout)
    if period:
        out = seasoned(layout.rest(out), series, "aqi", period)
    out = out.withColumns({
        "hour": S.hour(series.ts),
        "day_of_week": S.day_of_week(series.ts),
        "month": S.month(series.ts),
        **S.cyclical(series.ts),
        "is_weekend": S.is_weekend(series.ts),
        "is_rush_hour": S.is_rush_hour(series.ts),
        "atmospheric_stability": S.stability("temperature", "humidity"),
        "pm_ratio": S.pm_ratio("pm25", "pm10"),
        "dispersion_factor": S.dispersion("temperature", "humidity"),
        "temp_humidity_interaction": S.temp_humidity("temperature", "humidity"),
    })
    if settings.backfill:
        fill = [c for c in out.columns if c not in (*series.key, *series.order)]
        out = ffill(layout.rest(bfill(layout.rest(out), series, fill, layout)), series, fill, layout)
        numeric = [c for c, kind in out.dtypes if c in fill and kind in ("double", "float")]
        out = mean_fill(out, series.key, numeric)
    return out.select(*first, *[c for c in out.columns if c not in first])
