"""Capping of outliers per series.

A strategy names the statistics it needs and the bounds it makes of them; all strategies of a
table share one statistics pass and one join back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.config import RULES, Rule
from airloom.functions.scalars import bounded
from airloom.operators.ordered import join_back
from airloom.operators.quantiles import BUFFER_ROWS, quantiles, widened


class Cap(Protocol):
    """How to bound a column. ``quartiles`` asks for ``{c}_q1`` and ``{c}_q3`` besides ``stats``."""

    quartiles: bool

    def stats(self, name: str) -> dict[str, Column]:
        """Aggregates per series, by column name."""

    def bounds(self, name: str, rule: Rule) -> tuple[Column, Column]:
        """Lowest and highest allowed value; null means unbounded."""


class IqrCap:
    """Quartiles widened by 1.5 interquartile ranges; no bounds where that range is 0."""

    quartiles = True

    def stats(self, name):
        return {}

    def bounds(self, name, rule):
        q1, q3 = F.col(f"{name}_q1"), F.col(f"{name}_q3")
        reach = F.when(q3 != q1, 1.5 * (q3 - q1))
        return q1 - reach, q3 + reach


class ZScoreCap:
    """Mean plus and minus so many sample deviations; no bounds where the deviation is 0."""

    quartiles = False

    def stats(self, name):
        return {f"{name}_mean": F.avg(name), f"{name}_std": F.stddev_samp(name)}

    def bounds(self, name, rule):
        mean, std = F.col(f"{name}_mean"), F.col(f"{name}_std")
        reach = F.when(std != 0, rule.deviations * std)
        return mean - reach, mean + reach


class ClipCap:
    """The configured bounds."""

    quartiles = False

    def stats(self, name):
        return {}

    def bounds(self, name, rule):
        return F.lit(rule.low).cast("double"), F.lit(rule.high).cast("double")


CAPS: dict[str, Cap] = {"iqr": IqrCap(), "zscore": ZScoreCap(), "clip": ClipCap()}


def cap(
    df: DataFrame,
    key: Sequence[str],
    rules: Mapping[str, Rule] = RULES,
    caps: Mapping[str, Cap] = CAPS,
    count_as: str | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """Cap every ruled column of every series. Unknown strategies fall back to clipping.

    ``count_as`` adds a column with the number of values changed in the row.
    """
    cols = [c for c in rules if c in df.columns]
    ways = {c: caps.get(rules[c].cap, caps["clip"]) for c in cols}
    tables, stats = [], {}
    by_rank = [c for c in cols if ways[c].quartiles]
    for c in cols:
        stats.update(ways[c].stats(c))
    if by_rank:
        found = quantiles(df, key, by_rank, buffer_rows=buffer_rows)
        tables.append(widened(found, key, by_rank, ["_q1", "_q3"]))
    if stats:
        tables.append(df.groupBy(*key).agg(*[a.alias(n) for n, a in stats.items()]))

    out = df
    for table in tables:
        out = join_back(out, table, key)
    capped = {c: bounded(c, *ways[c].bounds(c, rules[c])) for c in cols}
    if count_as:
        changed = [F.when(F.col(c) != v, 1).otherwise(0) for c, v in capped.items()]
        out = out.withColumn(count_as, sum(changed, F.lit(0)))
    return out.withColumns(capped).select(*df.columns, *([count_as] if count_as else []))


def iqr_cap(df: DataFrame, key: Sequence[str], cols: Sequence[str], **kw) -> DataFrame:
    return cap(df, key, {c: Rule("iqr") for c in cols}, **kw)


def zscore_cap(df: DataFrame, key: Sequence[str], cols: Sequence[str], deviations: float = 3.0, **kw) -> DataFrame:
    return cap(df, key, {c: Rule("zscore", deviations=deviations) for c in cols}, **kw)


def clip_cap(df: DataFrame, cols: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    return cap(df, [], {c: Rule("clip", low, high) for c, (low, high) in cols.items()})
