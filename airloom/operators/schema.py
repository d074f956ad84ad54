"""Column mapping, coercion and projection. Column lists come from the schema, never from data."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.config import ALIASES, METADATA, RULES, TIMESTAMP_NAMES
from airloom.functions.scalars import number


def quoted(name: str) -> str:
    return f"`{name}`"


def map_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, keep: Sequence[str] = ()) -> DataFrame:
    """Rename the first alias present of each standard name. Names in ``keep`` (series keys) stay.

    A column that is the first alias of two names gets the later one, so ``time`` stays ``time``
    here and only ``parse_ts`` turns it into the time stamp.
    """
    renames, missing = {}, []
    for standard, names in aliases.items():
        found = next((n for n in names if n in df.columns and n not in keep), None)
        if found is None:
            missing.append(standard)
        else:
            renames[found] = standard
    if missing:
        warnings.warn(f"no column for {missing}", stacklevel=2)
    return df.select(*[F.col(quoted(c)).alias(renames.get(c, c)) for c in df.columns])


def detect_ts(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> str | None:
    """Name of the time column: configured alias, then a usual name, then the first time-typed one."""
    for name in aliases.get("timestamp", ()):
        if name in df.columns:
            return name
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    for name in TIMESTAMP_NAMES:
        if name in lower:
            return lower[name]
    for f in df.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f.name
    return None


def parse_ts(df: DataFrame, column: str | None = None, now: Column | None = None, name: str = "timestamp") -> DataFrame:
    """Read the time column as UTC and drop unreadable rows.

    With ``now`` given, a table without a time column, or with no readable time at all, gets
    ``now`` instead. The latter needs one look at the data: a single row that can be read.
    """
    column = column or detect_ts(df)
    if column is None:
        if now is None:
            raise ValueError("no time column; pass now= to stamp the rows")
        return df.withColumn(name, now)
    if column != name:
        df = df.drop(name).withColumnRenamed(column, name)
    read = df.withColumn(name, F.col(name).try_cast("timestamp"))
    good = read.where(F.col(name).isNotNull())
    if now is not None and good.isEmpty():
        return read.withColumn(name, now)
    return good


def infer_numeric(df: DataFrame, configured: Sequence[str] = tuple(RULES), metadata: Sequence[str] = METADATA) -> list[str]:
    """Numeric columns and configured ones that are present, metadata left out."""
    typed = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    named = [c for c in configured if c in df.columns]
    return [c for c in df.columns if c in {*typed, *named} and c not in metadata]


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text to DOUBLE, unreadable values and NaN to null."""
    cols = infer_numeric(df) if cols is None else [c for c in cols if c in df.columns]
    return df.withColumns({c: number(quoted(c)) for c in cols})


def typed_fill(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Null numbers to 0, null text to ''."""
    nums = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    return df.na.fill(0, nums).na.fill("", texts)


def add_entity(df: DataFrame, key: str, value: str, ts: str | None = None) -> DataFrame:
    """Add a constant series key and, if asked, make the event time a TIMESTAMP."""
    out = df.withColumn(key, F.lit(value))
    return out.withColumn(ts, F.col(ts).cast("timestamp")) if ts else out


def split_raw_cols(df: DataFrame, raw: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The raw columns that are present, and the whole frame."""
    return df.select(*[F.col(quoted(c)) for c in raw if c in df.columns]), df


def select_features(df: DataFrame, target: str = "aqi", excluded: Sequence[str] = ()) -> list[str]:
    """Names of model inputs: numeric, not the target, its changes or its future values."""
    out = {target, f"{target}_change", f"{target}_pct_change", *METADATA, *excluded}
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in out and not f.name.startswith(f"{target}_target_")
    ]


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def column_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: whether the table has it, and in how many of its rows it is given."""
    absent = set(missing_columns(df, required))
    counts = df.agg(*[(F.lit(0).cast("long") if c in absent else F.count(c)).alias(c) for c in required])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in absent).alias("missing"), F.col(c).alias("given")) for c in required]
    return counts.select(F.inline(F.array(*rows)))
