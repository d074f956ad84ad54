"""Token ids in Parquet files from which single documents or only their metadata can be read.

Documents lie in id order, one file after the other. Ids are a list column in dictionary or delta
encoding; row groups and pages have a set size, and Parquet's page index lets a reader that asks for
some ids skip the pages of all others. Metadata columns are read without touching the ids.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from airloom.llm.frames import slices, small_batches, text_of, texts_of
from airloom.llm.segments import Memo, coded

#: Of the tokens file, in bytes; a row group is what one task reads at least, a page what it skips at least.
ROW_GROUP = 32 << 20
PAGE = 256 << 10
END = 2
#: Segments that a Python worker remembers, and texts whose segments it looks up together.
MEMO = 150_000
ROWS = 2_000

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("first", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


#: A segment without white space but a space or line feed before it.
_PLAIN = re.compile(r"[ \n]?\S+")


class _Library:
    """The tokenizers library over segments; every different one is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        self.tokenizer = Tokenizer.from_file(path)
        (self.feed,) = self._ids(["\n"])[0].tolist()
        self.memo = Memo(self._code, MEMO)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _code(self, parts: list[str]) -> list[bytes]:
        """Ids of segments: plain ones in one go, with line feeds between them that are cut out again."""
        plain = [i for i, p in enumerate(parts) if _PLAIN.fullmatch(p)]
        out: list[bytes | None] = [None] * len(parts)
        ids = self._ids(["\n" + "\n".join([parts[i].lstrip("\n") for i in plain])])[0]
        at = (4 * np.append(np.flatnonzero(ids == self.feed), len(ids))).tolist()
        if len(at) == len(plain) + 1:  # else each by itself
            data = ids.tobytes()
            for i, begin, end in zip(plain, at, at[1:], strict=False):
                out[i] = data[begin if parts[i][0] == "\n" else begin + 4 : end]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._ids([parts[i] for i in rest]), strict=True):
            out[i] = ids.tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[pa.Array, list[int]]:
        return coded(texts, self.memo)


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def _encoded(path: str, end: int):
    def run(batches):
        part, first, coder = TaskContext.get().partitionId(), 0, _library(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in slices(batches, ROWS):
            ids, _ = coder.encode(texts_of(batch, 1))
            rows = [x + tail for x in ids.to_pylist()]
            sizes = [len(x) // 4 for x in rows]
            starts = list(accumulate(sizes, initial=first))
            first = starts[-1]
            values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(rows))])
            lists = pa.ListArray.from_arrays(pa.array(accumulate(sizes, initial=0), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(rows), pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), lists],
                names=SCHEMA.fieldNames(),
            )

    return run


def write_tokens(
    docs: DataFrame, target: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = END,
    encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE,
) -> None:
    """Encode every text with the tokenizers library, append ``end``, and write the ids in id order.

    ``encoding`` is "dictionary" or "delta" (Parquet's binary packed deltas). Null texts are read as
    empty and have the end id alone; null ids come first; rows with the same id are ordered by their
    text's hash and text. ``tokenizer`` must be readable on every executor. Spark's committer makes
    the files of a lost task appear once.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    options = {
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.row.count.limit": 1_000,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "compression": "zstd",
    }
    writer = small_batches(dealt).mapInArrow(_encoded(tokenizer, end), SCHEMA).write
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.parquet(target)


def _starts(spark: SparkSession, target: str) -> DataFrame:
    """Ids before each part: one row for each file."""
    parts = spark.read.schema(SCHEMA).parquet(target).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _located(spark: SparkSession, target: str, df: DataFrame) -> DataFrame:
    return df.join(_starts(spark, target), "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "first", "part")


def read_metadata(spark: SparkSession, target: str, where: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, start) of all documents, or those that ``where`` selects; no ids are read."""
    df = spark.read.schema(SCHEMA).parquet(target)
    return _located(spark, target, (df if where is None else df.where(where)).select("doc_id", "part", "first", "n_tokens"))


def read_tokens(spark: SparkSession, target: str, where: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, start); a condition on doc_id reads only the pages that may hold it."""
    df = spark.read.schema(SCHEMA).parquet(target)
    return _located(spark, target, df if where is None else df.where(where))


def _crc(batches):
    for batch in slices(batches, 4096):
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "first", "n_tokens")), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "first", "n_tokens", "ids_crc32"],
        )


def token_checks(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, start) from the files: a checksum of each document's ids."""
    stored = spark.read.schema(SCHEMA).parquet(target)
    sums = stored.mapInArrow(_crc, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return _located(spark, target, sums)
