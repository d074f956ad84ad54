"""Deduplication, newest rows, tails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.config import SAMPLE_ROWS, TAIL_ROWS
from airloom.operators.ordered import Series, first_rows
from airloom.operators.predicates import any_not_null


def dedup_last(df: DataFrame, series: Series) -> DataFrame:
    """One row per key and time: the last by the tie columns."""
    return first_rows(df, [*series.key, series.ts], [F.col(c).desc() for c in series.ties])


def dedup_first(df: DataFrame, series: Series) -> DataFrame:
    """One row per key and time: the first by the tie columns."""
    return first_rows(df, [*series.key, series.ts], [F.col(c).asc() for c in series.ties])


def latest_row(df: DataFrame, series: Series, needed: Sequence[str] = ()) -> DataFrame:
    """The newest row of each series with all ``needed`` values; rows without time rank oldest."""
    rows = df.na.drop("any", subset=list(needed)) if needed else df
    return first_rows(rows, series.key, series.descending())


def latest_any(df: DataFrame, series: Series, cols: Sequence[str]) -> DataFrame:
    """The values of the newest row that has any of ``cols``, one row per value."""
    newest = latest_row(any_not_null(df, cols), series)
    return newest.unpivot([*series.key, series.ts], list(cols), "pollutant", "value").where(F.col("value").isNotNull())


def history_tail(df: DataFrame, series: Series, n: int = TAIL_ROWS) -> DataFrame:
    """The newest ``n`` rows of each series."""
    return first_rows(df, series.key, series.descending(), n)


def sample_tail(df: DataFrame, series: Series, n: int = SAMPLE_ROWS) -> DataFrame:
    """The newest rows that explanations are computed on."""
    return history_tail(df, series, n)


def sort_ts(df: DataFrame, series: Series) -> DataFrame:
    """Key and time order over the whole table, by a range shuffle."""
    return df.orderBy(*series.key, *series.ascending())


def combine_sources(sources: Mapping[str, DataFrame], series: Series) -> DataFrame:
    """Union of all columns of all sources, one row per key and time, the source named first wins."""
    parts = [d.withColumns({"source": F.lit(n), "_rank": F.lit(i)}) for i, (n, d) in enumerate(sources.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    order = [F.col("_rank").asc(), *[F.col(c).desc() for c in series.ties]]
    return first_rows(out, [*series.key, series.ts], order).drop("_rank")
