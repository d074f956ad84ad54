"""Helpers shared by the operators: safe column names, Arrow batches, ASCII rules for words and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space between words and around line keys, as a Java and SQL character class.
SPACE = r"[\x20\x09-\x0D]"

#: Rows turned into Python values at a time, so that memory follows the texts of few rows.
SLICE_ROWS = 256

#: Rows of one Arrow batch from Spark; the default of 10,000 whole texts is too much for small workers.
BATCH_ROWS = 2_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made from ``names`` that no column of ``df`` has, so extra columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(col: str) -> Column:
    """The text column as a string, null read as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def named(df: DataFrame, **renamed: str) -> DataFrame:
    """Only the given columns under new names: ``named(docs, doc_id="id")``."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in renamed.items()])


def same(left: Column, right: Column) -> Column:
    """Equality under which nulls are equal."""
    return left.eqNullSafe(right)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def strings(batch: pa.RecordBatch, at: int | str) -> list[str]:
    """A column's texts, null as empty."""
    return [x or "" for x in batch.column(at).to_pylist()]


def texts_of(batch: pa.RecordBatch, at: int | str) -> pa.Array:
    """A column's texts as they are in Arrow, null as empty."""
    return pc.fill_null(batch.column(at), "")


def utf8(batch: pa.RecordBatch, at: int | str) -> list[bytes]:
    """A column's texts as UTF-8 without decoding them, null as empty."""
    col = batch.column(at)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def with_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list[list | pa.Array]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` with columns computed from Arrow batches in Python tasks.

    ``make`` runs once in each task and returns the function from a batch to the values of
    ``fields``. A column of ``df`` that has the name of a new one is replaced; ``keep`` names the
    columns to carry along (all others are only input).
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    at = [df.columns.index(c) for c in kept]

    def run(batches):
        compute = make()
        for batch in slices(batches, rows):
            arrays = [batch.column(i) for i in at]
            for values, field in zip(compute(batch), fields, strict=True):
                arrays.append(values if isinstance(values, pa.Array) else pa.array(values, to_arrow_type(field.dataType)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[f.name for f in fields]])

    return small_batches(df).mapInArrow(run, schema)


def small_batches(df: DataFrame) -> DataFrame:
    """Keeps what a Python worker gets at once to ``BATCH_ROWS`` texts, a setting of the session."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df

