"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "airloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    UTC keeps wall-clock arithmetic free of daylight jumps; adaptive execution splits skewed
    join partitions and turns joins into broadcasts once it has measured the small side.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_RUN: ContextVar[str | None] = ContextVar("airloom_run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, as in tests, it becomes a folder in the session's warehouse: the
    other place that Spark itself expects every executor to reach. Never a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_airloom"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def run_folder(spark: SparkSession):
    """Intermediate tables made inside the block share one folder, removed when the block ends.

    Put the sink of a chain inside the block: frames that read intermediate tables are of no use
    afterwards. The folder also goes when the block fails.
    """
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex[:12]}"
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, below the run folder if one is open, else the shared folder."""
    return f"{_RUN.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
