"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.config import HIGH_DRIFT, KS_LIMIT, LOG_ROWS, MIN_DRIFT_ROWS
from airloom.operators.ordered import CHUNK_ROWS, Series, first_rows, join_back, measure, with_ordinal, with_totals
from airloom.operators.quantiles import long_form
from airloom.session import settled


def split_tail(df: DataFrame, series: Series, share: float, round_up_tail: bool) -> DataFrame:
    """Add ``in_tail``: whether a row is in the last ``share`` of its series, in time order.

    The tail has ceil(share * n) rows, or n - floor((1 - share) * n) with ``round_up_tail`` off.
    Counts are exact integers scaled by 1e9, so 0.2 * 50 is 10 and not a hair more.
    """
    layout = measure(df, series)
    placed = with_ordinal(df, series, "_ordinal", layout)
    sizes = df.groupBy(*series.key).agg(F.count(F.lit(1)).alias("_size"))
    scale = 1_000_000_000
    part = round((share if round_up_tail else 1 - share) * scale)
    portion = F.col("_size") * part / scale
    head = F.col("_size") - F.ceil(portion) if round_up_tail else F.floor(portion)
    if layout.plain:
        joined = placed.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*series.key)))
    else:
        joined = join_back(placed, sizes, series.key)
    return joined.withColumn("in_tail", F.col("_ordinal") > head).drop("_ordinal", "_size")


def value_counts(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (), name: str = "n") -> DataFrame:
    """(group, feature, value, count): a sample collapsed to its distinct values, nulls left out."""
    return long_form(df, group, cols).groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias(name))


def ks_stat(
    reference: DataFrame,
    current: DataFrame,
    cols: Sequence[str],
    group: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per group and feature, nulls left out.

    Both samples collapse to counts per distinct value before anything is ordered; running totals
    over the values then give both distribution functions. A feature present in one sample only
    gets no row.
    """
    return ks_of_counts(value_counts(reference, cols, group, "n_ref"), value_counts(current, cols, group, "n_cur"), group, chunk_rows)


def ks_of_counts(reference: DataFrame, current: DataFrame, group: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``ks_stat`` of two samples that are counts per value already: columns n_ref and n_cur."""
    keys = [*group, "feature"]
    none = F.lit(0).cast("long")
    both = reference.withColumn("n_cur", none).unionByName(current.withColumn("n_ref", none))
    counted = both.groupBy(*keys, "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    counted = settled(counted, "counts")  # read three times below, so both samples are read once
    sizes = counted.groupBy(*keys).agg(
        F.sum("n_ref").alias("size_ref"),
        F.sum("n_cur").alias("size_cur"),
        (F.sum(F.col("value") * F.col("n_ref")) / F.nullif(F.sum("n_ref"), F.lit(0))).alias("mean_ref"),
        (F.sum(F.col("value") * F.col("n_cur")) / F.nullif(F.sum("n_cur"), F.lit(0))).alias("mean_cur"),
    )
    sizes = sizes.where((F.col("size_ref") > 0) & (F.col("size_cur") > 0))
    series = Series(tuple(keys), "value", chunk_rows=chunk_rows)
    totals = with_totals(counted, series, {"upto_ref": F.col("n_ref"), "upto_cur": F.col("n_cur")})
    apart = F.abs(F.col("upto_ref") / F.col("size_ref") - F.col("upto_cur") / F.col("size_cur"))
    rest = [c for c in sizes.columns if c not in keys]
    joined = join_back(totals, sizes, keys).where(F.col("size_ref").isNotNull())
    return joined.groupBy(*keys, *rest).agg(F.max(apart).alias("ks"))


#: Pairs of sizes up to this product get the exact p-value, larger ones the asymptotic one.
EXACT_PAIRS = 10_000


def ks_pvalue(ks: Column, size_ref: Column, size_cur: Column, terms: int = 100) -> Column:
    """Two-sided p-value: exact for samples whose sizes multiply to EXACT_PAIRS at most, else asymptotic.

    Informational, the decision uses the statistic.
    """
    small = size_ref * size_cur <= EXACT_PAIRS
    return F.when(small, _exact_pvalue(ks, size_ref, size_cur)).otherwise(_asymptotic_pvalue(ks, size_ref, size_cur, terms))


def _asymptotic_pvalue(ks: Column, size_ref: Column, size_cur: Column, terms: int) -> Column:
    effective = F.sqrt(size_ref * size_cur / (size_ref + size_cur))
    reach = effective * ks
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * reach * reach),
    )
    # The alternating series is exact from here on and does not settle for a reach near 0.
    return F.when(reach < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def _exact_pvalue(ks: Column, size_ref: Column, size_cur: Column) -> Column:
    """Of all orders in which two samples of these sizes can lie, the share that reaches the statistic.

    An order is a path over a grid of the sizes; paths that stay nearer to the diagonal are counted
    row by row. Ties between the samples are taken as if broken at random.
    """
    wide, high = F.greatest(size_ref, size_cur), F.least(size_ref, size_cur)
    reach = F.round(ks * wide * high)  # |i / wide - j / high| < ks in whole numbers
    none = F.array().cast("array<double>")

    def row(before: Column, i: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            ways = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0.0)) + F.coalesce(F.get(before, j.cast("int")), F.lit(0.0))
            ways = F.when((i == 0) & (j == 0), 1.0).otherwise(ways)
            return F.array_append(out, F.when(F.abs(i * high - j * wide) < reach, ways).otherwise(0.0))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), high), none, cell)

    inside = F.element_at(F.aggregate(F.sequence(F.lit(0).cast("long"), wide), none, row), -1)
    paths = F.aggregate(F.sequence(F.lit(1).cast("long"), high), F.lit(1.0), lambda acc, k: acc * (wide + k) / k)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - inside / paths))


def drift_detail(
    reference: DataFrame,
    current: DataFrame,
    cols: Sequence[str],
    group: Sequence[str] = (),
    limit: float = KS_LIMIT,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per group and feature with statistic, p-value, decision and both means."""
    return detail_of(ks_stat(reference, current, cols, group, chunk_rows), group, limit)


def detail_of(found: DataFrame, group: Sequence[str] = (), limit: float = KS_LIMIT) -> DataFrame:
    """The rows of ``drift_detail`` from statistics that are known."""
    return found.select(
        *group,
        "feature",
        "ks",
        ks_pvalue(F.col("ks"), F.col("size_ref"), F.col("size_cur")).alias("p_value"),
        F.lit(limit).alias("limit"),
        (F.col("ks") > limit).alias("is_drifted"),
        F.round("mean_ref", 4).alias("ref_mean"),
        F.round("mean_cur", 4).alias("cur_mean"),
    )


def drift_report(
    detail: DataFrame, group: Sequence[str] = (), current: DataFrame | None = None, least: int = MIN_DRIFT_ROWS
) -> DataFrame:
    """One row per group: counts, share, names of drifted features and the status.

    With the ``current`` sample given, groups below ``least`` rows read ``insufficient_data``.
    """
    drifted = F.col("is_drifted").cast("int")
    out = detail.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_features"),
        F.sum(drifted).alias("drifted_features"),
        # at most one entry per feature column
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature")))), ",").alias("drifted_names"),
    )
    share = F.col("drifted_features") / F.greatest(F.col("total_features"), F.lit(1))
    status = (
        F.when(share > HIGH_DRIFT, "high_drift")
        .when(F.col("drifted_features") > 0, "moderate_drift")
        .otherwise("no_drift")
    )
    out = out.withColumns({"drift_ratio": F.round(share, 4), "status": status})
    if current is None:
        return out
    sizes = current.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    few = F.col("_rows") < least
    joined = join_back(sizes, out, group)
    return joined.select(
        *group,
        *[F.when(~few, F.col(c)).alias(c) for c in out.columns if c not in (*group, "status")],
        F.when(few, "insufficient_data").otherwise(F.coalesce("status", F.lit("no_drift"))).alias("status"),
    )


def drift_log_append(report: DataFrame, path: str, at: Column, ts: str = "detected_at") -> None:
    """Add the reports of one run to the drift log; what is stored is neither read nor rewritten."""
    report.withColumn(ts, at).write.mode("append").parquet(path)


def drift_log_tail(log: DataFrame, ts: str, ties: Sequence[str] = (), n: int = LOG_ROWS) -> DataFrame:
    """The newest ``n`` events of the drift log."""
    return log.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def drift_status(log: DataFrame, ts: str, key: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """The newest event of the drift log, per key."""
    return first_rows(log, key, [F.col(c).desc() for c in (ts, *ties)]) if key else drift_log_tail(log, ts, ties, 1)
