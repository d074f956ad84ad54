"""Row filters and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.config import HORIZONS, RULES, Rule
from airloom.functions.scalars import number
from airloom.operators.ordered import same_key


def in_range(name: str, rule: Rule) -> Column:
    """The value, or null outside the rule's inclusive bounds."""
    value = F.col(name)
    inside = F.lit(True)
    if rule.low is not None:
        inside = inside & (value >= rule.low)
    if rule.high is not None:
        inside = inside & (value <= rule.high)
    return F.when(inside, value)


def range_null(df: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Values outside their bounds become null; columns without a rule are unbounded."""
    return df.withColumns({c: in_range(c, r) for c, r in rules.items() if c in df.columns})


def lookback(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """The last ``days`` days. A plain comparison on the column, so the scan gets it."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def any_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("all", subset=list(cols))


def chart_series(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Readable value and time only, in time order."""
    read = df.select(F.col(ts), number(value).alias(value))
    return read.na.drop(subset=[ts, value]).orderBy(ts)


def min_rows_guard(df: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """Keep the series with at least ``least`` rows; rows with a null key are a series too."""
    enough = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    names = {k: f"_k{i}" for i, k in enumerate(key)}
    enough = enough.withColumnsRenamed(names)
    return df.join(enough, same_key(df, enough, names), "left_semi")


def split_horizons(requests: DataFrame, column: str, horizons: Sequence[int] = HORIZONS) -> tuple[DataFrame, DataFrame]:
    """Requests with a configured horizon, and the rejected rest (null horizons too)."""
    known = F.coalesce(F.col(column).isin(list(horizons)), F.lit(False))
    return requests.where(known), requests.where(~known)
