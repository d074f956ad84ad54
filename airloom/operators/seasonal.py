"""Additive seasonal decomposition and centred trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.config import SEASON_ROWS
from airloom.operators.ordered import Layout, Series, Stage, join_back, measure, with_ordinal, with_rows


def trend_centered(
    df: DataFrame, series: Series, column: str, rows: int = 2 * SEASON_ROWS, name: str | None = None, layout: Layout | None = None
) -> DataFrame:
    """Mean of ``rows`` rows around each one; an even count reaches one row further back than ahead."""
    name = name or f"{column}_trend_simple"
    back, ahead = rows // 2, (rows - 1) // 2
    return with_rows(
        df, series, lambda w: {name: F.avg(column).over(w.rowsBetween(-back, ahead))}, before=back, after=ahead, layout=layout
    )


def decompose(
    df: DataFrame, series: Series, column: str, period: int = SEASON_ROWS, layout: Layout | None = None
) -> DataFrame:
    """Add ``{column}_trend``, ``{column}_seasonal`` and ``{column}_trend_simple``.

    Trend: centred moving average over one period (half weight at both ends of an even period),
    null where the frame is incomplete. Season: mean of the detrended values by place in the
    period, shifted to mean 0. Series shorter than two periods get null for all three, and a
    series with nulls in ``column`` gets only the simple trend.
    """
    layout = layout or measure(df, series, period)
    out = layout.rest(with_ordinal(df, series, "_at", layout))
    out = with_rows(out, series, smoothing(column, period), before=period, after=period, layout=layout)
    return seasoned(layout.rest(out), series, column, period)


def smoothing(column: str, period: int) -> Stage:
    """The frames of ``decompose``, ``period`` rows to either side, as a stage of ``with_rows``."""
    half = period // 2

    def smooth(w):
        full = w.rowsBetween(-half, half)
        inner = w.rowsBetween(-half + 1, half - 1) if period % 2 == 0 else full
        whole = F.count(column).over(full) == 2 * half + 1
        if period % 2:
            value = F.avg(column).over(full)
        else:
            value = (F.sum(column).over(full) + F.sum(column).over(inner)) / (2 * period)
        around = w.rowsBetween(-period, period - 1)
        return {"_trend": F.when(whole, value), "_simple": F.avg(column).over(around)}

    return smooth


def seasoned(df: DataFrame, series: Series, column: str, period: int) -> DataFrame:
    """What ``decompose`` makes of the frames of ``smoothing`` and the row number ``_at``."""
    trend, seasonal, simple = f"{column}_trend", f"{column}_seasonal", f"{column}_trend_simple"
    out = df.withColumn("_phase", (F.col("_at") - 1) % period)
    phases = out.groupBy(*series.key, "_phase").agg(
        F.avg(F.col(column) - F.col("_trend")).alias("_mean"),
        F.count(F.lit(1)).alias("_rows"),
        F.count(column).alias("_known"),
    )
    centre = phases.groupBy(*series.key).agg(
        F.avg("_mean").alias("_centre"), F.sum("_rows").alias("_rows"), F.sum("_known").alias("_known")
    )
    season = join_back(phases.drop("_rows", "_known"), centre, series.key)
    out = join_back(out, season, [*series.key, "_phase"])
    long = F.col("_rows") >= 2 * period
    whole = long & (F.col("_rows") == F.col("_known"))
    out = out.withColumns({
        trend: F.when(whole, F.col("_trend")),
        seasonal: F.when(whole, F.col("_mean") - F.col("_centre")),
        simple: F.when(long, F.col("_simple")),
    })
    return out.select(*[c for c in df.columns if c not in ("_at", "_trend", "_simple")], trend, seasonal, simple)
