"""The hourly batch as Structured Streaming jobs.

Every job takes a streaming DataFrame and, where it writes, a target and checkpoint folder. They
run with ``availableNow`` by default: take what has arrived, then stop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from airloom.config import AlertSettings
from airloom.functions.advice import alerts
from airloom.operators.drift import detail_of, drift_report, ks_of_counts, value_counts
from airloom.operators.ordered import Series, Stage, first_rows, join_back, same_key, with_rows
from airloom.session import settled


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, ts: str, pattern: str | None = None) -> DataFrame:
    """New Parquet files of a folder. Watermarks need TIMESTAMP, so local times are read as UTC."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def start(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Write a stream to Parquet, exactly once through its checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*partition_by).trigger(availableNow=True).start(target)


def start_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run ``work`` per micro-batch; it must give the same result when a batch is repeated."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(work).trigger(availableNow=True).start()


def st_ingest(stream: DataFrame, target: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Incremental append of raw readings."""
    return start(stream, target, checkpoint, partition_by=partition_by)


def heartbeat(spark: SparkSession, folder: str, schema: T.StructType, ts: str, at: str) -> None:
    """Append a row that holds nothing but the time ``at``, after which no reading of before comes.

    It moves the watermark of streams over ``folder``, so that whatever waits for it is closed.
    """
    row = spark.range(1).select(*[(F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.write.mode("append").parquet(folder)


def st_dedup(stream: DataFrame, series: Series, late: str = "2 hours") -> DataFrame:
    """One reading per key and time, the last by the tie columns, as ``dedup_last`` has it in batch.

    A reading waits until the watermark has passed its time, in any order of arrival; then it is
    emitted once and leaves the state. Later ones are dropped, rows without a time never come out.
    """
    rest = [c for c in stream.columns if c not in (*series.key, series.ts)]
    order = series.ties or rest
    last = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.count(F.lit(1))
    found = stream.withWatermark(series.ts, late).groupBy(*series.key, series.ts).agg(last.alias("_last"))
    return found.select(*[F.col(c) if c in (*series.key, series.ts) else F.col(f"_last.{c}").alias(c) for c in stream.columns])


def st_rolling(stream: DataFrame, series: Series, column: str, hours: int = 6, late: str = "2 hours") -> DataFrame:
    """Means over sliding windows of whole hours.

    In append mode a window is emitted once, when the watermark passes its end, and leaves the state
    then, so the state holds the windows of the last ``hours`` and ``late`` only. A ``heartbeat``
    closes the last ones.
    """
    window = F.window(series.ts, f"{hours} hours", "1 hour")
    return (
        stream.withWatermark(series.ts, late)
        .groupBy(*series.key, window.alias("w"))
        .agg(F.avg(column).alias("mean"), F.count(column).alias("n"))
        .select(*series.key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")
    )


def st_alert(stream: DataFrame, aqi: str, ts: str, settings: AlertSettings = AlertSettings(), place: str | None = None) -> DataFrame:
    """Alerts as readings arrive: no state, no shuffle."""
    return alerts(stream, aqi, ts, settings, place)


def st_features(
    stream: DataFrame,
    series: Series,
    features: Callable[[DataFrame], DataFrame] | Sequence[Stage],
    history: str,
    target: str,
    checkpoint: str,
    rows_back: int = 24,
    late: timedelta | None = None,
) -> StreamingQuery:
    """Row-exact lags and rolling frames on a stream.

    Per micro-batch the stored rows of its keys in ``history`` go before the new rows, ``features``
    runs on both, and what the batch changes is written under its batch number: the new rows and,
    with ``late``, those of the ``rows_back`` rows after each that were emitted before.
    ``features_table`` picks the newest version of each row. ``rows_back`` must cover the reach of
    ``features``: a function of all rows, or stages as ``with_rows`` takes them. Stages share the one
    shuffle and sort of a batch that also finds stored rows which come again and the rows that change.

    ``history`` holds, in hash buckets, the rows of each key that are less than ``late`` older than its
    newest, and ``rows_back`` rows before them; a batch reads and rewrites the buckets of its own keys
    only. Rows may come in any order within ``late``; older ones are dropped, as behind a watermark.
    Without ``late`` rows must come in time order per key. A repeated batch overwrites itself and does
    not see its own rows as history.
    """
    reach = F.lit(late) if late is not None else None
    stages = () if callable(features) else features
    places = [*series.key, *series.order]

    def newest(df: DataFrame, names: DataFrame) -> DataFrame:
        return join_back(df, names.groupBy(*series.key).agg(F.max(series.ts).alias("_newest")), series.key)

    def in_time(new: DataFrame, old: DataFrame) -> DataFrame:
        """``new`` without the rows that are too late for ``old``, where a repeated batch does not count.

        The stored rows of the batch itself are told apart only if some row is too late for all of them.
        """
        limit = F.col(series.ts) < F.col("_newest") - reach
        if newest(new, old).where(limit).isEmpty():
            return new
        names = {k: f"_a{i}" for i, k in enumerate(places)}
        mine = new.select(*[F.col(k).alias(n) for k, n in names.items()])
        others = old.join(mine, same_key(old, mine, names), "left_anti")
        return newest(new, others).where(F.col("_newest").isNull() | ~limit).drop("_newest")

    def changes(w):
        return {"_changed": F.max("_new").over(w.rowsBetween(-rows_back, 0)) if late is not None else F.col("_new")}

    def work(batch: DataFrame, number: int) -> None:
        new = settled(_bucketed(batch, series.key), "microbatch")
        old = _touched(new, history)
        columns = new.columns
        if old is not None and late is not None:
            new = in_time(new, old)
        both = new.withColumn("_new", F.lit(True))
        if old is not None:
            both = both.unionByName(old.withColumn("_new", F.lit(False)))
        replaced_by = "_new" if old is not None else None
        both = settled(with_rows(both, series, changes, *stages, before=rows_back, replaced_by=replaced_by), "microbatch")
        out = features(both.drop("_bucket")) if callable(features) else both.drop("_bucket")
        out.where("_changed").drop("_new", "_changed").write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows = both.select(*columns)
        if late is None:
            _store(first_rows(rows, series.key, series.descending(), rows_back), history)
            return
        rows = newest(rows, rows).withColumn("_recent", F.col(series.ts) >= F.col("_newest") - reach).drop("_newest")
        before = first_rows(rows.where(~F.col("_recent")), series.key, series.descending(), rows_back)
        _store(rows.where("_recent").unionByName(before).drop("_recent"), history)

    return start_batches(stream, work, checkpoint)


def features_table(spark: SparkSession, target: str, series: Series) -> DataFrame:
    """What ``st_features`` has written: of each row the version of the newest batch.

    A row has few versions, so nothing is gained by a sort before the shuffle, as ``first_rows`` has it.
    """
    out = spark.read.option("basePath", target).parquet(target)
    versions = Window.partitionBy(*series.key, *series.order).orderBy(F.col("batch").desc())
    return out.withColumn("_newer", F.lag("batch").over(versions)).where(F.col("_newer").isNull()).drop("_newer", "batch")


def st_online(stream: DataFrame, series: Series, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row per key, in hash buckets of which a batch rewrites those of its own keys."""

    def work(batch: DataFrame, number: int) -> None:
        new = settled(_bucketed(batch, series.key), "microbatch")
        old = _touched(new, target)
        both = new if old is None else new.unionByName(old)
        _store(settled(first_rows(both, series.key, series.descending()), "state"), target)

    return start_batches(stream, work, checkpoint)


#: Folders that the state of keyed streams is dealt into: a batch touches at most so many.
BUCKETS = 256


def _bucketed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))


def _touched(new: DataFrame, path: str) -> DataFrame | None:
    """The stored rows of the buckets in ``new``; None before the first batch."""
    try:
        stored = new.sparkSession.read.schema(new.schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    buckets = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most BUCKETS
    return stored.where(F.col("_bucket").isin(buckets))


def _store(rows: DataFrame, path: str) -> None:
    """Overwrite the buckets of ``rows``, which must not be read from them."""
    out = rows.hint("rebalance", "_bucket").write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def st_drift(
    stream: DataFrame, reference: DataFrame, cols: Sequence[str], target: str, checkpoint: str, group: Sequence[str] = ()
) -> StreamingQuery:
    """Drift of every micro-batch against a fixed reference, one report per group and batch.

    The reference is read once, when the stream starts, and kept as counts per distinct value; each
    batch is counted the same way and merged with them.
    """
    kept = settled(value_counts(reference, cols, group, "n_ref"), "reference")

    def work(batch: DataFrame, number: int) -> None:
        current = settled(batch, "current")
        found = ks_of_counts(kept, value_counts(current, cols, group, "n_cur"), group)
        drift_report(detail_of(found, group), group, current).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return start_batches(stream, work, checkpoint)
