"""Exact quantiles per group, also for groups too large for one task.

``percentile`` keeps the distinct values of a group in one buffer. That is fine while groups are
below ``buffer_rows`` rows, which one count decides. For larger groups a sketch first brackets
each quantile between two values whose ranks are surely below and above it. A second pass counts
what lies below the bracket and keeps only the values inside it, a tiny share of the group, among
which the exact rank is picked. Both passes combine on the map side; the values are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.ordered import join_back
from airloom.session import settled

BUFFER_ROWS = 200_000


def long_form(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per group, feature and non-null value."""
    cast = df.select(*group, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(group), list(cols), "feature", "value").where(F.col("value").isNotNull())


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    cols: Sequence[str],
    shares: Sequence[float] = (0.25, 0.75),
    buffer_rows: int = BUFFER_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """(group, feature, q): ``q`` holds the linearly interpolated quantiles of ``feature``.

    Columns without any value are left out. ``largest`` is the number of rows of the largest group,
    if the caller has counted them.
    """
    shares = [float(s) for s in shares]
    if largest is None:
        largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= buffer_rows:
        wide = df.groupBy(*group).agg(*[F.percentile(F.col(c), shares).alias(c) for c in cols])
        return wide.unpivot(list(group), list(cols), "feature", "q").where(F.col("q").isNotNull())

    accuracy = int(min(1_000_000, max(10_000, 8 * largest // 1_000_000)))
    # A sketch may differ between two runs, and both passes below must see the same brackets.
    around = settled(_brackets(df, group, cols, shares, accuracy), "brackets")
    rows = join_back(df.select(*group, *[F.col(c).cast("double").alias(c) for c in cols]), around, group)
    spots = [_Spot(c, i, share) for c in cols for i, share in enumerate(shares)]
    below = rows.groupBy(*group).agg(
        *[F.count(c).alias(f"n_{c}") for c in cols], *[F.count(F.when(s.value < s.low, 1)).alias(s.name) for s in spots]
    )
    below = below.select(*group, F.explode(F.array(*[
        F.struct(s.feature, s.place, F.col(f"n_{s.column}").alias("total"), F.col(s.name).alias("below")) for s in spots
    ])).alias("_b")).select(*group, "_b.*")

    # Only rows inside some bracket go on: about 8 / accuracy of a large group.
    near = rows.where(reduce(lambda x, y: x | y, [s.inside for s in spots]))
    cells = [F.when(s.inside, F.struct(s.feature, s.place, s.value.alias("value"))) for s in spots]
    near = near.select(*group, F.explode(F.array(*cells)).alias("_c")).where(F.col("_c").isNotNull()).select(*group, "_c.*")
    keys = [*group, "feature", "place"]
    counted = near.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = join_back(counted.withColumn("upto", F.sum("n").over(w)), below, keys)
    share = F.get(F.array(*[F.lit(s) for s in shares]), F.col("place"))
    placed = placed.withColumns({"upto": F.col("upto") + F.col("below"), "rank": share * (F.col("total") - 1)})

    def held(rank: Column) -> Column:
        at = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(at, F.col("value")))

    found = placed.groupBy(*keys).agg(
        held(F.floor("rank")).alias("low"), held(F.ceil("rank")).alias("high"), F.first("rank").alias("rank")
    )
    part = F.col("rank") - F.floor("rank")
    point = F.col("low") * (1 - part) + F.col("high") * part
    point = F.coalesce(point, F.raise_error(F.lit("a quantile fell outside its bracket")).cast("double"))
    points = found.withColumn("point", point).groupBy(*group, "feature")
    return points.agg(F.array(*[F.max(F.when(F.col("place") == i, F.col("point"))) for i in range(len(shares))]).alias("q"))


class _Spot:
    """One quantile of one column: its bracket as expressions."""

    def __init__(self, column: str, place: int, share: float):
        self.column, self.name = column, f"_below_{column}_{place}"
        self.value = F.col(column)
        self.low, self.high = F.get(f"at_{column}", F.lit(2 * place)), F.get(f"at_{column}", F.lit(2 * place + 1))
        self.inside = F.coalesce((self.value >= self.low) & (self.value <= self.high), F.lit(False))
        self.feature, self.place = F.lit(column).alias("feature"), F.lit(place).alias("place")


def _brackets(df: DataFrame, group: Sequence[str], cols: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    """Per group ``at_{c}``: the lower and upper value around each share, one pair after the other.

    The sketch is off by at most one part in ``accuracy``; the brackets leave four. Groups with
    fewer rows than that resolves are bracketed by their extremes.
    """
    room = 4.0 / accuracy
    wanted = [min(1.0, max(0.0, s + move)) for s in shares for move in (-room, room)]
    made = []
    for c in cols:
        value = F.col(c).cast("double")
        ends = F.flatten(F.array_repeat(F.array(F.min(value), F.max(value)), len(shares)))
        near = F.percentile_approx(value, wanted, accuracy)
        made.append(F.when(F.count(c) <= accuracy, ends).otherwise(near).alias(f"at_{c}"))
    return df.groupBy(*group).agg(*made)


def widened(long: DataFrame, group: Sequence[str], cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group with ``{feature}{name}`` columns for the entries of ``q``."""
    picks = [
        F.max(F.when(F.col("feature") == c, F.get("q", F.lit(i)))).alias(f"{c}{name}")
        for c in cols
        for i, name in enumerate(names)
    ]
    return long.groupBy(*group).agg(*picks)
