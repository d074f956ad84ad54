"""Row order inside a series, also when one series is too large for one task.

Lags, rolling frames, fills, ordinals and running totals all need the rows of a series in order.
``Window.partitionBy(key)`` puts a whole series into one task, which fails once one station holds
a third of the table. So every operator here first measures the series. A table whose series all
fit in ``chunk_rows`` gets the plain window. Otherwise the large series are cut at positions of
the order columns, ties included, into chunks of about ``chunk_rows`` rows, windows run per (key,
chunk), and what a chunk needs from its neighbours reaches it in one of three exact ways:

* row frames: the last ``before`` rows of the chunk before it and the first ``after`` rows of the
  chunk after it are added and dropped again;
* time frames: rows are summed per time first, and a frame is the head of one block of time and the
  tail of the block before, each a running sum;
* unlimited state (fills, totals): one summary row per chunk, accumulated over the few chunks of
  the series and joined back.

The cuts of a series are a written tree of nodes with fewer than ``FAN`` cuts each. A row walks down
by one join a level, without a hint; nothing is collected and no row carries all cuts of its series,
so neither the number of series nor that of chunks has a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.session import settled

CHUNK_ROWS = 1_000_000

#: A table that is joined back by key is broadcast up to so many values, beyond that shuffled.
BROADCAST_VALUES = 1_000_000

#: Cuts are kept in nodes of fewer than so many; a level more for each further power of it.
FAN = 128

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

Stage = Callable[[WindowSpec], Mapping[str, Column]]


@dataclass(frozen=True)
class Series:
    """Which columns identify a series, order it in time and break ties."""

    key: tuple[str, ...]
    ts: str
    ties: tuple[str, ...] = ()
    chunk_rows: int = CHUNK_ROWS

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.ties)

    def ascending(self) -> list[Column]:
        return [F.col(c).asc() for c in self.order]

    def descending(self) -> list[Column]:
        return [F.col(c).desc() for c in self.order]

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.key, *extra).orderBy(*self.ascending())

    def backwards(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.key, *extra).orderBy(*self.descending())

    def cut_at(self, rows: int) -> Series:
        return replace(self, chunk_rows=rows)


def same_key(left: DataFrame, right: DataFrame, names: Mapping[str, str]) -> Column:
    """Null-safe equality of ``left[name] <=> right[other]`` for all pairs."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in names.items()])


def join_back(df: DataFrame, table: DataFrame, key: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add the columns of ``table``, one row per key, to every row; null keys meet each other.

    The table is written and counted first: up to ``BROADCAST_VALUES`` it is broadcast and ``df``
    stays where it is; beyond that both sides are shuffled, and adaptive execution splits hot keys.
    A caller that has counted the keys already gives their number as ``rows``, which saves the write.
    Without key the table is a single row. Streams are joined without a look at the table.
    """
    if not key:
        return df.join(F.broadcast(table), F.lit(True), "left")
    names = {k: f"_j{i}" for i, k in enumerate(key)}
    right = table.withColumnsRenamed(names)
    if rows is not None and rows * len(right.columns) <= BROADCAST_VALUES:
        right = F.broadcast(right)
    elif rows is None and not df.isStreaming and not table.isStreaming:
        right = settled(right, "by_key")
        if right.count() * len(right.columns) <= BROADCAST_VALUES:
            right = F.broadcast(right)
    return df.join(right, same_key(df, right, names), "left").drop(*names.values())


def _position(df: DataFrame, name: str) -> Column:
    return F.unix_micros(name) if isinstance(df.schema[name].dataType, T.TimestampType) else F.col(name)


def _micros(df: DataFrame, name: str) -> Column:
    """A time as a number; a local time without regard to the session's time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    minutes = (F.unix_date(F.to_date(name)).cast("long") * 24 + F.hour(name)) * 60 + F.minute(name)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), F.col(name)) * 1_000_000).cast("long")


def _place(df: DataFrame, series: Series) -> Column:
    """Where a row stands in its series: time and ties as one comparable value."""
    return F.struct(_position(df, series.ts).alias("p0"), *[F.col(t).alias(f"p{i}") for i, t in enumerate(series.ties, 1)])


def _slot(cuts: Column, place: Column) -> Column:
    """How many of the sorted ``cuts`` are at or below ``place`` (binary search)."""
    top = F.floor(F.log2(F.greatest(F.size(cuts), F.lit(1)) + F.lit(0.5))).cast("int")
    steps = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= place, at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


@dataclass(frozen=True)
class Layout:
    """The cuts of the series that are too large for one task; ``None`` when there are none.

    ``cuts`` has a row for each node of the tree (key, _level, _node, the node's ``_cuts``) and
    ``depth`` levels. No chunk has fewer than ``least`` rows of the measured table.
    """

    series: Series
    cuts: DataFrame | None
    least: int = 0
    depth: int = 1

    @property
    def plain(self) -> bool:
        return self.cuts is None

    def rest(self, df: DataFrame) -> DataFrame:
        """``df`` between two ordered steps. Steps on cut series read their input two or three
        times, so it is written once there instead of being made again by each reader."""
        return df if self.plain else settled(df, "step")

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``_chunk``, ``_cut`` (series is cut) and ``_halo`` (false; copies for a chunk beside get true)."""
        series = self.series
        out = df.withColumns({"_cut": F.lit(False), "_chunk": F.lit(0).cast("long")})
        for level in reversed(range(self.depth)):
            nodes = self.cuts.where(F.col("_level") == level).drop("_level")
            on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(series.key)]
            if level < self.depth - 1:  # the highest level is one node
                on.append(F.col("_chunk") == F.col("_node"))
            joined = out.join(nodes, reduce(lambda a, b: a & b, on), "left")
            out = joined.withColumns({
                "_chunk": F.col("_chunk") * FAN + _slot(F.col("_cuts"), _place(df, series)), "_cut": F.col("_cut") | F.col("_cuts").isNotNull()
            }).drop("_cuts", "_node", *[f"_k{i}" for i in range(len(series.key))])
        return out.withColumn("_halo", F.lit(False))


_MARKS = ("_chunk", "_cut", "_halo")


def measure(df: DataFrame, series: Series, need: int = 0, places: bool = False) -> Layout:
    """Find the series above ``chunk_rows`` and cut them into chunks of at least ``need`` rows.

    With ``places`` rows that are equal in all order columns count once.

    One count per key decides. The rows of large series, key and order columns only, are then sorted
    by range; every quarter of a chunk is a piece, and its first row is where a chunk may begin. The
    rows before each piece are counted by sums over blocks of pieces and inside each block, so that
    no task and no row holds all pieces of a series. Rows that are equal in all order columns stay
    together.
    """
    limit = max(series.chunk_rows, 2 * need)
    least = max(limit // 2, need)
    keys = {k: f"_k{i}" for i, k in enumerate(series.key)}
    # A first cut has `limit` rows before it and `least` behind it.
    sizes = df.groupBy(*series.key).count().where(F.col("count") >= limit + least)
    large = settled(sizes.withColumnsRenamed(keys).withColumnRenamed("count", "_size"), "large")
    total = large.agg(F.sum("_size")).first()[0]
    if not total:
        return Layout(series, None)

    rows = df.select(*series.key, _place(df, series).alias("_start"))
    rows = rows.join(large, same_key(rows, large, keys), "left_semi")
    dealt = rows.repartitionByRange(-(-total // CHUNK_ROWS), *series.key, "_start")
    if places:  # equal rows are in one task by now: no further shuffle
        dealt = dealt.dropDuplicates([*series.key, "_start"])
    dealt = dealt.sortWithinPartitions(*series.key, "_start")
    step = max(limit // 4, 1)  # the id counts the rows of each task
    dealt = dealt.withColumn("_piece", F.monotonically_increasing_id()).withColumn("_piece", F.expr(f"_piece div {step}"))
    pieces = dealt.groupBy(*series.key, "_piece").agg(F.min("_start").alias("_start"), F.count(F.lit(1)).alias("_n"))
    starts = pieces.groupBy(*series.key, "_start").agg(F.min("_piece").alias("_piece"), F.sum("_n").alias("_n"))
    starts = settled(starts.withColumn("_block", F.expr(f"_piece div {FAN}")), "pieces")
    placed = _rows_before(starts, series)
    if places:
        large = starts.groupBy(*series.key).agg(F.sum("_n").alias("_size")).withColumnsRenamed(keys)

    # The first start in each stretch of `limit` rows. Where many equal rows push it far into its
    # stretch, the next one may be near: it is left out, as is one too near the end of the series.
    firsts = placed.withColumn("_at", F.expr(f"_before div {limit}")).where(F.col("_at") > 0).groupBy(*series.key, "_at")
    firsts = firsts.agg(F.min("_before").alias("_before"), F.min_by("_start", "_before").alias("_start"))
    in_order = Window.partitionBy(*series.key).orderBy("_at")
    firsts = firsts.withColumn("_gap", F.col("_before") - F.lag("_before", 1, 0).over(in_order))
    firsts = firsts.join(large, same_key(firsts, large, keys)).drop(*keys.values())
    cuts = firsts.where((F.col("_gap") >= limit - step) & (F.col("_size") - F.col("_before") >= least))
    tree = settled(_tree(cuts.withColumn("_no", F.row_number().over(in_order).cast("long")), series), "cuts")
    depth = tree.agg(F.max("_level")).first()[0]
    return Layout(series, None) if depth is None else Layout(series, tree, least, depth + 1)


def _rows_before(starts: DataFrame, series: Series) -> DataFrame:
    """Add ``_before``: the rows of the series in all pieces before this one."""

    def earlier(*parts: str) -> Column:
        w = Window.partitionBy(*series.key, *parts[:-1]).orderBy(parts[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    blocks = starts.groupBy(*series.key, "_block").agg(F.sum("_n").alias("_n")).withColumn("_ahead", earlier("_block")).drop("_n")
    names = {k: f"_j{i}" for i, k in enumerate([*series.key, "_block"])}
    blocks = blocks.withColumnsRenamed(names)
    inside = starts.withColumn("_before", earlier("_block", "_piece"))
    joined = inside.join(blocks, same_key(inside, blocks, names)).drop(*names.values())
    return joined.withColumn("_before", F.col("_before") + F.col("_ahead")).drop("_ahead")


def _tree(cuts: DataFrame, series: Series) -> DataFrame:
    """The numbered cuts (``_no``, from 1) of each series as nodes of a tree.

    On level l, node j holds the cuts whose number is a multiple of FAN^l within the j-th stretch of
    FAN^(l + 1), without the stretch's own first: each cut stands in one node.
    """
    powers = [FAN**i for i in range(9) if FAN**i < 2**62]
    level = sum([F.when(F.col("_no") % p == 0, 1).otherwise(0) for p in powers[1:]], F.lit(0))
    cuts = cuts.withColumn("_level", level).withColumn("_width", F.get(F.array(*[F.lit(p).cast("long") for p in powers]), F.col("_level") + 1))
    cuts = cuts.withColumn("_node", F.coalesce(F.expr("_no div _width"), F.lit(0)).cast("long"))
    held = cuts.groupBy(*series.key, "_level", "_node").agg(F.sort_array(F.collect_list(F.struct("_no", "_start"))).alias("_held"))
    held = held.select(*series.key, "_level", "_node", F.transform("_held", lambda c: c["_start"]).alias("_cuts"))
    return held.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(series.key)})


def with_rows(
    df: DataFrame,
    series: Series,
    *stages: Stage,
    before: int = 0,
    after: int = 0,
    layout: Layout | None = None,
    replaced_by: str | None = None,
) -> DataFrame:
    """Add columns from row frames that look at most ``before`` rows back and ``after`` ahead.

    Each stage maps the ordered window to named columns and may use columns of earlier stages;
    ``before`` and ``after`` cover all stages together. All stages share one shuffle and one sort.
    A ``layout`` whose chunks may be shorter than that is refused.

    ``replaced_by`` names a boolean column without nulls. Of rows that are equal in key and order, those where
    it is false go before the first stage if it is true in one of them; they need no join and no sort of
    their own. A ``layout`` must then be measured with ``places``.
    """
    layout = layout or measure(df, series, max(before, after), places=replaced_by is not None)
    if layout.plain:
        return _staged(df, series.window(), stages, replaced_by)
    if layout.least < max(before, after):
        raise ValueError(f"measured for {layout.least} rows, but frames reach {max(before, after)}; pass need= to measure()")

    rows = layout.assign(df)
    parts = [rows]
    if before:
        parts.append(_edge(rows, series, series.descending(), before, +1, replaced_by is not None))
    if after:
        parts.append(_edge(rows, series, series.ascending(), after, -1, replaced_by is not None))
    out = _staged(reduce(DataFrame.unionByName, parts), series.window("_chunk"), stages, replaced_by)
    return out.where(~F.col("_halo")).drop(*_MARKS)


def _staged(df: DataFrame, w: WindowSpec, stages: Sequence[Stage], replaced_by: str | None) -> DataFrame:
    if replaced_by:
        equal = w.rangeBetween(Window.currentRow, Window.currentRow)
        df = df.withColumn("_replaced", F.max(replaced_by).over(equal) & ~F.col(replaced_by)).where(~F.col("_replaced")).drop("_replaced")
    for stage in stages:
        df = df.withColumns(dict(stage(w)))
    return df


def _edge(rows: DataFrame, series: Series, order: list[Column], n: int, move: int, places: bool = False) -> DataFrame:
    """The ``n`` outermost rows of every chunk of a cut series, handed to the chunk beside it.

    With ``places`` rows that are equal in all order columns go together and count once.
    """
    place = (F.dense_rank if places else F.row_number)().over(Window.partitionBy(*series.key, "_chunk").orderBy(*order))
    return (
        rows.where("_cut")
        .withColumn("_place", place)
        .where(F.col("_place") <= n)
        .drop("_place")
        .withColumn("_chunk", F.col("_chunk") + move)
        .withColumn("_halo", F.lit(True))
    )


def with_span_means(df: DataFrame, series: Series, means: Mapping[str, tuple[str, timedelta]]) -> DataFrame:
    """Add ``{new: (column, span)}``: means over the rows less than ``span`` back, all equal times included.

    A time frame sees equal times together, so rows are first summed per time. Time is dealt into blocks
    as long as the span: a frame is the head of its own block up to its time, and the tail of the block
    before. Both are running sums, forwards and backwards, so a row costs the same however many rows its
    frame holds; nothing is subtracted, so no digits are lost. The means are joined back by time.
    """
    key = [*series.key, series.ts]
    at = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in means.values()))}
    spans = {span: i for i, span in enumerate(dict.fromkeys(span for _, span in means.values()))}
    # Doubles are summed as their first 24 bits, which is exact for long, and the rest.
    measures = {}
    for c, i in at.items():
        value = F.col(c)
        if isinstance(df.schema[c].dataType, T.DoubleType):
            head = F.when(F.abs(value) < 1e38, value.cast("float").cast("double")).otherwise(value)
            measures |= {f"s{i}": head, f"r{i}": F.when(head == value, 0.0).otherwise(value - head)}
        else:
            measures[f"s{i}"] = value
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(f"_{n}") for n, m in measures.items()] + [F.count(c).alias(f"_c{i}") for c, i in at.items()]
    held = [f"_{n}" for n in (*measures, *[f"c{i}" for i in at.values()])]
    times = settled(df.groupBy(*key).agg(*sums), "times").withColumn("_now", _micros(df, series.ts))

    def entry(i: int, back: bool, start: Column, place: Column, data: bool, asks: bool) -> Column:
        marks = {"_span": F.lit(i), "_back": F.lit(back), "_stretch": start, "_when": place, "_data": F.lit(data), "_asks": F.lit(asks)}
        return F.struct(*[v.alias(n) for n, v in marks.items()], *[F.col(n) if data else F.lit(0).cast(times.schema[n].dataType).alias(n) for n in held])

    # Backwards, what asks stands before the times at its place: the frame begins just after them.
    entries = []
    for span, i in spans.items():
        reach, now = span // timedelta(microseconds=1), F.col("_now")
        own = now - F.pmod(now, F.lit(reach))
        entries += [
            entry(i, False, own, now, True, True),
            F.when(now.isNotNull(), entry(i, True, own, -now, True, False)),
            F.when(now.isNotNull(), entry(i, True, own - reach, reach - now, False, True)),
        ]
    parts = times.select(*key, F.explode(F.array(*entries)).alias("_e")).where(F.col("_e").isNotNull()).select(*key, "_e.*")
    blocks = Series((*series.key, "_span", "_back", "_stretch"), "_when", ("_data",), series.chunk_rows)
    totals = with_state(parts, blocks, {f"_t{n}": F.col(n) for n in held}).where("_asks")

    def total(n: str, span: timedelta) -> Column:
        return F.sum(F.when(F.col("_span") == spans[span], F.col(f"_t_{n}")))

    made = []
    for name, (c, span) in means.items():
        i = at[c]
        whole = total(f"s{i}", span) + total(f"r{i}", span) if f"r{i}" in measures else total(f"s{i}", span)
        made.append(F.try_divide(whole, total(f"c{i}", span)).alias(name))
    found = totals.groupBy(*key).agg(*made)
    names = {k: f"_j{i}" for i, k in enumerate(key)}
    found = found.withColumnsRenamed(names)
    return df.join(found, same_key(df, found, names), "left").drop(*names.values())


def with_state(
    df: DataFrame,
    series: Series,
    sums: Mapping[str, Column] | None = None,
    before: Mapping[str, str] | None = None,
    after: Mapping[str, str] | None = None,
    ordinal: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Add columns whose frames reach to the start or the end of the series, all in one pass.

    ``sums``: ``{new: measure}``, running sums, current row included. ``before`` and ``after``:
    ``{new: old}``, the last non-null ``old`` at or before each row, the first at or after it.
    ``ordinal`` names a column for the row number in the series, from 1, and adds ``{new}_at``,
    the row number each ``before`` and ``after`` value comes from. The order must be total.

    For cut series one summary row per chunk is accumulated over the chunks and joined back.
    """
    sums, before, after = dict(sums or {}), dict(before or {}), dict(after or {})
    layout = layout or measure(df, series)
    rows, chunk = (df, ()) if layout.plain else (layout.assign(df), ("_chunk",))
    ahead, back = series.window(*chunk), series.backwards(*chunk)
    # Looking ahead is looking back in reverse order: a frame that starts at the current row and
    # ends with the partition would be read again for every row.
    ahead_frame, back_frame = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (ahead, back))

    if ordinal:
        rows = rows.withColumn(ordinal, F.row_number().over(ahead).cast("long"))
    values = {}
    for n, old in [*before.items(), *after.items()]:
        parts = [F.col(old).alias("v"), *([F.col(ordinal).alias("at")] if ordinal else [])]
        values[n] = F.when(F.col(old).isNotNull(), F.struct(*parts))

    found = {n: F.sum(c).over(ahead_frame) for n, c in sums.items()}
    found |= {f"_s_{n}": F.last(values[n], True).over(ahead_frame) for n in before}
    found |= {f"_s_{n}": F.last(values[n], True).over(back_frame) for n in after}

    if not layout.plain:
        carry = _carry(rows, series, sums, values, before, after, ordinal)
        names = {k: f"_k{i}" for i, k in enumerate(series.key)} | {"_chunk": "_kc"}
        rows = rows.join(carry, same_key(rows, carry, names), "left").drop(*names.values())
    out = rows.withColumns(found)

    spare = [f"_s_{n}" for n in values]
    if not layout.plain:
        shift = F.coalesce(F.col("_from_rows"), F.lit(0)) if ordinal else F.lit(0)
        moved = {n: F.col(n) + F.coalesce(F.col(f"_from_{n}"), F.lit(0)) for n in sums}
        for n in values:
            here = F.col(f"_s_{n}")
            if ordinal:
                here = F.when(here.isNotNull(), F.struct(here["v"].alias("v"), (here["at"] + shift).alias("at")))
            moved[f"_s_{n}"] = F.coalesce(here, F.col(f"_from_{n}"))
        if ordinal:
            moved[ordinal] = F.col(ordinal) + shift
            spare.append("_from_rows")
        out = out.withColumns(moved)
        spare += [*_MARKS, *[f"_from_{n}" for n in (*sums, *values)]]
    picked = {n: F.col(f"_s_{n}.v") for n in values}
    if ordinal:
        picked |= {f"{n}_at": F.col(f"_s_{n}.at") for n in values}
    return out.withColumns(picked).drop(*spare)


def _carry(rows: DataFrame, series: Series, sums, values, before, after, ordinal) -> DataFrame:
    """Per chunk of a cut series, what all earlier (for ``after``: later) chunks hand over to it."""
    order = F.struct(*[F.col(c) for c in series.order])
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    for n, value in values.items():
        pick = F.max_by if n in before else F.min_by
        aggs.append(pick(value, F.when(value.isNotNull(), order)).alias(n))
    per = rows.where("_cut").groupBy(*series.key, "_chunk").agg(F.count(F.lit(1)).alias("_rows"), *aggs)

    def over(later: bool) -> WindowSpec:
        towards = F.col("_chunk").desc() if later else F.col("_chunk").asc()
        return Window.partitionBy(*series.key).orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)

    first = F.coalesce(F.sum("_rows").over(over(False)), F.lit(0))
    per = per.withColumn("_from_rows", first)
    if ordinal:
        per = per.withColumns({
            n: F.when(F.col(n).isNotNull(), F.struct(F.col(n)["v"].alias("v"), (F.col(n)["at"] + F.col("_from_rows")).alias("at")))
            for n in values
        })
    return per.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(series.key)],
        F.col("_chunk").alias("_kc"),
        *(["_from_rows"] if ordinal else []),
        *[F.sum(n).over(over(False)).alias(f"_from_{n}") for n in sums],
        *[F.last(n, True).over(over(n in after)).alias(f"_from_{n}") for n in values],
    )


def with_totals(df: DataFrame, series: Series, measures: Mapping[str, Column], layout: Layout | None = None) -> DataFrame:
    """Running sums per series, current row included."""
    return with_state(df, series, sums=measures, layout=layout)


def with_ordinal(df: DataFrame, series: Series, name: str = "ordinal", layout: Layout | None = None) -> DataFrame:
    """Row number within the series, from 1."""
    return with_state(df, series, ordinal=name, layout=layout)


def with_nearest(
    df: DataFrame, series: Series, columns: Mapping[str, str], later: bool = False, layout: Layout | None = None
) -> DataFrame:
    """Add ``{new: old}``: the last non-null ``old`` at or before each row, or the first at or after."""
    return with_state(df, series, layout=layout, **{"after" if later else "before": columns})


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark limits per task before the shuffle, so hot keys stay small.

    Spark does that up to a threshold, which is raised for the session where ``n`` is larger.
    """
    conf = df.sparkSession.conf
    if n > int(conf.get(GROUP_LIMIT)):
        conf.set(GROUP_LIMIT, n)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
