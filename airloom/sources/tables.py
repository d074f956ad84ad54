"""Parquet and CSV tables, appends, snapshots, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.operators.ordered import first_rows
from airloom.session import settled


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, merge: bool = False) -> DataFrame:
    """A Parquet table. With ``merge`` columns that later appends brought are included."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema else reader).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_raw(new: DataFrame, path: str, ts: str, partition_by: Sequence[str] = ()) -> None:
    """Add a batch to the raw table; nothing that is stored is read or rewritten."""
    stamped = new.withColumn(ts, F.col(ts).try_cast("timestamp"))
    stamped.write.mode("append").partitionBy(*partition_by).parquet(path)


def appended(old: DataFrame, new: DataFrame, ts: str) -> DataFrame:
    """What a reader of the raw table sees after an append: columns unioned, times read alike."""
    kind = old.schema[ts].dataType
    kind = "timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp"
    return old.unionByName(new, allowMissingColumns=True).withColumn(ts, F.col(ts).try_cast(kind))


def read_csv(spark: SparkSession, path: str, ts: str = "timestamp", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV history: header in any case, times parsed, rows without a readable time dropped."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.withColumn(ts, F.col(ts).try_cast("timestamp")).where(F.col(ts).isNotNull())


# --- snapshots ---------------------------------------------------------------------------------


def fingerprint(columns: Sequence[str]) -> Column:
    """Of all rows, in any order: XOR and exact sum of the row hashes. The sum also sees rows that
    stand twice, which cancel out in the XOR."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)])
    total = F.sum(row.cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", F.hex(F.bit_xor(row)), total)


def checksum(df: DataFrame) -> DataFrame:
    """Row count and a fingerprint that does not depend on row order or file layout."""
    return df.agg(F.count(F.lit(1)).alias("rows"), fingerprint(df.columns).alias("fingerprint"))


def snapshot_write(df: DataFrame, path: str, version: str, ts: str) -> DataFrame:
    """Write one version and return its metadata row, which is also stored beside the data."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data/version={version}")
    stored = spark.read.parquet(f"{path}/data/version={version}")
    meta = stored.agg(
        F.lit(version).alias("version"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(stored.columns)).alias("columns"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        fingerprint(stored.columns).alias("fingerprint"),
        F.lit(f"{path}/data/version={version}").alias("path"),
    )
    meta.write.mode("overwrite").json(f"{path}/meta/version={version}")
    return meta


def snapshot_latest(versions: DataFrame, column: str = "version") -> DataFrame:
    """The rows of the lexically last version; on a partition column the scan prunes to it.

    The newest version is one broadcast row, and the join prunes partitions while it runs.
    """
    newest = versions.select(F.col(column).alias("_v")).agg(F.max("_v").alias("_v"))
    return versions.join(F.broadcast(newest), F.col(column) == F.col("_v")).drop("_v")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return snapshot_latest(spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data"))


def snapshot_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all versions."""
    return spark.read.option("basePath", f"{path}/meta").json(f"{path}/meta")


# --- keyed feature tables ----------------------------------------------------------------------


def _newest(columns: Sequence[str], ties: Sequence[str]) -> list[Column]:
    return [*[F.col(c).desc() for c in ties], F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)]).desc()]


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Old and new rows by key, the new one wins; of several new ones the last by ``ties``, then by hash.

    Spark keeps one row per key and task before the shuffle.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_rows(both, key, [F.col("_new").desc(), *_newest(new.columns, ties)]).drop("_new")


def read_keyed(spark: SparkSession, path: str, like: T.StructType, partition: str) -> DataFrame:
    """A keyed table with the partition column typed as in ``like``: a name like ``001`` stays text."""
    stored = spark.read.parquet(path).schema
    fields = [like[f.name] if f.name == partition else f for f in stored.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def upsert_features(new: DataFrame, path: str, key: Sequence[str], partition: str, ties: Sequence[str] = ()) -> None:
    """Write rows into a keyed table partitioned by ``partition``; only partitions of ``new`` are rewritten.

    A null partition value is a partition like any other. The merged rows go through a written table
    in the shared folder first, because a table cannot be overwritten while it is being read. Rows
    are dealt out by partition before the write, large ones to several tasks.
    """
    spark = new.sparkSession
    new = settled(first_rows(new, key, _newest(new.columns, ties)), "new")
    try:
        old = read_keyed(spark, path, new.schema, partition)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.hint("rebalance", partition).write.partitionBy(partition).parquet(path)
        return
    touched = new.select(F.col(partition).alias("_touched")).distinct()
    merged = upserted(old.join(touched, old[partition].eqNullSafe(touched["_touched"]), "left_semi"), new, key)
    (
        settled(merged, "upsert")
        .hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def read_features(table: DataFrame, names: Sequence[str], key: Sequence[str], entities: DataFrame | None = None) -> DataFrame:
    """Named columns of a feature table, for all entities or for those given."""
    out = table.select(*key, *[n for n in names if n not in key])
    if entities is None:
        return out
    shared = [k for k in key if k in entities.columns]
    return out.join(entities.select(*shared).distinct(), shared, "left_semi")


def retrieval_meta(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row and feature counts of a retrieval."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len([c for c in df.columns if c not in key])).alias("features"))


def store_health(meta: DataFrame, now: Column) -> DataFrame:
    """Whether the snapshot store has versions, and how old the newest data is."""
    out = meta.agg(
        F.count(F.lit(1)).alias("versions"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.max("version").alias("latest_version"),
        F.max(F.col("max_ts").cast("timestamp")).alias("newest"),
    )
    ok = (F.col("versions") > 0) & (F.col("rows") > 0)
    age = F.timestamp_diff("SECOND", F.col("newest"), now) / 3600
    return out.withColumns({"age_hours": age, "status": F.when(ok, "healthy").otherwise("degraded")})


def manifest_export(parts: dict[str, DataFrame], path: str | None = None) -> DataFrame:
    """One JSON document of the given one-row tables; stored when ``path`` is given."""
    rows = [d.select(F.lit(n).alias("part"), F.to_json(F.struct("*")).alias("body")) for n, d in parts.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    body = F.concat(F.lit('"'), F.col("part"), F.lit('":'), F.col("body"))
    doc = out.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(body)), ","), F.lit("}")).alias("value"))
    if path:
        doc.write.mode("overwrite").text(path)
    return doc


def version_now(at: datetime) -> str:
    """Version name whose text order is time order."""
    return at.strftime("%Y%m%dT%H%M%S")


# --- model metadata ----------------------------------------------------------------------------

METRICS = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("horizon_hours", T.IntegerType()),
    T.StructField("metrics", T.StructType([T.StructField(m, T.DoubleType()) for m in ("rmse", "mae", "r2")])),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("model_path", T.StringType()),
])


def metrics_scan(spark: SparkSession, path: str) -> DataFrame:
    """All model metadata files of a folder; markers of the best model (``best_*``) are left out."""
    df = spark.read.schema(METRICS).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return df.where(~F.col("_metadata.file_name").startswith("best_"))

