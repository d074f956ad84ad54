"""Lines that repeat across documents, kept only in one of them.

Two Bloom filters, of line hashes seen once and seen twice, single out suspected repeats; only their
digests are shuffled. False suspects fall out in the exact count, and no repeat is ever missed: the
filters of two tasks merge by OR, and bits that both have in the first filter go into the second.

Texts stay where they are: the repeated lines, one digest and holder each, go to them while those are
few, which a count decides. Only beyond that are texts and their lost lines shuffled to each other.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.frames import fresh, slices, small_batches, utf8, with_columns
from airloom.session import settled

MIN_CHARS = 40
MIN_DOCS = 5
SPACES = b" \t\n\x0b\x0c\r"

#: Bits of one block of a filter; a hash sets two bits inside one block.
BLOCK_BITS = 1 << 16
#: One bit for so many bytes of text. The filter that every task gets is never larger than MAX_BITS
#: (128 MB); larger ones are made one range of hashes after the other, a pass over the texts each, up
#: to MAX_RANGES. Beyond that more lines are suspected; the result stays the same.
BYTES_PER_BIT = 8
MAX_BITS = 1 << 30
MAX_RANGES = 8

#: Up to so many repeated lines, 24 bytes each, are sent to all tasks.
FREQUENT_LINES = 2_000_000


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line of a UTF-8 text: outer ASCII white space cut off, A-Z in lower case."""
    return [line.strip(SPACES).lower() for line in text.split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return len(key.decode("utf-8", "replace")) >= least


def _digests(text: bytes, least: int) -> set[bytes]:
    """128-bit digests of the different long keys of a text."""
    return {xxhash.xxh3_128_digest(key) for key in set(line_keys(text)) if _long(key, least)}


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[:, 0].astype(np.uint64)


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


@dataclass(frozen=True)
class Range:
    """Blocks ``first`` to ``first + count`` of a filter of ``blocks``."""

    first: int
    count: int
    blocks: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        block = ((hashes >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64)
        return (block >= self.first) & (block < self.first + self.count)

    def spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, counted from the first, and the two bits in it of each hash of the range."""
        wide = np.uint64(BLOCK_BITS - 1)
        block = ((hashes >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64) - self.first
        return block, hashes & wide, (hashes >> np.uint64(16)) & wide


def filter_ranges(size: int) -> list[Range]:
    """The ranges of the filter for ``size`` bytes of text, each of at most ``MAX_BITS``."""
    most = max(MAX_BITS // BLOCK_BITS, 1)
    blocks = 1
    while blocks * BLOCK_BITS < size // BYTES_PER_BIT and blocks < most * MAX_RANGES:
        blocks *= 2
    return [Range(first, min(most, blocks - first), blocks) for first in range(0, blocks, most)]


def _task_filters(at: int, least: int, part: Range):
    """One row per touched block: its bits of lines seen once and twice by the task."""

    def run(batches):
        seen, counts, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), []

        def merged():
            every = np.concatenate([seen, *waiting])
            weight = np.concatenate([counts, np.ones(len(every) - len(seen), np.int64)])
            unique, place = np.unique(every, return_inverse=True)
            return unique, np.bincount(place, weight, len(unique)).astype(np.int64)

        size = 0
        for batch in slices(batches):
            new = _hashes([d for text in utf8(batch, at) for d in _digests(text, least)])
            new = new[part.holds(new)]
            if len(new):
                waiting.append(new)
                size += len(new)
            if size > 200_000:
                (seen, counts), waiting, size = merged(), [], 0
        seen, counts = merged()
        block, one, two = part.spots(seen)
        order = np.argsort(block, kind="stable")
        names, starts = np.unique(block[order], return_index=True)
        for name, mine in zip(names.tolist(), np.split(order, starts[1:]), strict=bool(len(names))):
            once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            for spot in (one, two):
                once[spot[mine]] = True
                twice[spot[mine[counts[mine] > 1]]] = True
            yield _row(name, once, twice)

    return run


def _row(block: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([_packed(once)], pa.binary()), pa.array([_packed(twice)], pa.binary())],
        names=["block", "once", "twice"],
    )


def _merge_filters(batches):
    """Merge the rows of each block as they come; the memory is that of the partition's blocks."""
    state: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            once, twice = _unpacked(once), _unpacked(twice)
            if block in state:
                a, b = state[block]
                state[block] = [a | once, b | twice | (a & once)]
            else:
                state[block] = [once, twice]
    for block, (once, twice) in state.items():
        yield _row(block, np.unpackbits(once), np.unpackbits(twice))


def repeat_filter(docs: DataFrame, text: str, least: int, part: Range) -> np.ndarray:
    """A range of the second Bloom filter: packed bits of hashes of long line keys of two rows or more."""
    lines = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    parts = small_batches(lines).mapInArrow(_task_filters(0, least, part), "block long, once binary, twice binary")
    merged = parts.repartition("block").mapInArrow(_merge_filters, "block long, once binary, twice binary")
    bits = np.zeros((part.count, BLOCK_BITS // 8), np.uint8)
    for row in merged.select("block", "twice").toLocalIterator():  # at most MAX_BITS in all
        bits[row.block] = _unpacked(bytes(row.twice))
    return bits


def _suspects(twice, at: tuple[int, int], least: int, part: Range):
    def run(batches):
        bits = twice.value
        for batch in slices(batches):
            ids, found = [], []
            for id, text in zip(batch.column(at[0]).to_pylist(), utf8(batch, at[1]), strict=True):
                mine = list(_digests(text, least))
                ids += [id] * len(mine)
                found += mine
            hashes = _hashes(found)
            places = np.flatnonzero(part.holds(hashes))
            if not len(places):
                continue
            block, one, two = part.spots(hashes[places])
            hit = np.ones(len(places), bool)
            for spot in (one, two):
                hit &= (bits[block, spot >> np.uint64(3)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 == 1
            keep = places[hit].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.binary())], names=["id", "line"]
            )

    return run


def suspected_lines(rows: DataFrame, least: int) -> DataFrame:
    """(id, line): digests of the long lines of each document that another row may hold as well."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = []
    for part in filter_ranges(size):
        twice = rows.sparkSession.sparkContext.broadcast(repeat_filter(rows, "text", least, part))
        found.append(settled(rows.mapInArrow(_suspects(twice, (0, 1), least, part), "id long, line binary").distinct(), "suspects"))
        twice.destroy()  # the suspects are written
    return reduce(DataFrame.unionByName, found)


class Holders:
    """Digests of repeated lines and the id that keeps each, as sorted arrays."""

    def __init__(self, frequent: pa.Table):
        low, high = _halves(frequent.column("line").to_pylist())
        order = np.lexsort((high, low))
        self.low, self.high = low[order], high[order]
        self.ids = frequent.column("holder").to_numpy()[order]

    def find(self, digests: list[bytes]) -> np.ndarray:
        """The place of each digest, -1 where it is not held."""
        found = np.full(len(digests), -1)
        if not len(self.low) or not digests:
            return found
        low, high = _halves(digests)
        at, end = np.searchsorted(self.low, low), len(self.low)
        while True:  # again only for digests that share their first half
            live = np.flatnonzero((at < end) & (self.low[np.minimum(at, end - 1)] == low))
            if not len(live):
                return found
            hit = live[self.high[at[live]] == high[live]]
            found[hit] = at[hit]
            at[live] += 1
            at[hit] = end


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _long_lines(lines: list[bytes], least: int) -> tuple[list[int], list[bytes]]:
    """Places and digests of the lines whose keys are long enough."""
    places, digests = [], []
    for i, line in enumerate(lines):
        key = line.strip(SPACES).lower()
        if _long(key, least):
            places.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return places, digests


def drop_repeated_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with every text cut down, and the columns n_lines (before) and n_dropped added.

    A line is dropped if its key (outer ASCII white space cut off, A-Z lower-cased) has ``min_chars``
    code points or more, is found in ``min_docs`` documents or more, and this is not the largest id
    that holds it. The other lines stay as they are, joined by a line feed. A null or empty text is
    one empty line. Rows with the same id are one document; null ids are one document, the smallest.
    Columns n_lines and n_dropped of the input are replaced. Keys are compared by 128-bit digests.
    Long texts are read whole, up to ``SLICE_ROWS`` at a time. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    suspects = suspected_lines(rows, min_chars)
    frequent = suspects.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
    # a line of one document has no other to lose it, so a holder is never null
    frequent = settled(frequent.where((F.col("n") >= min_docs) & (F.col("n") > 1)).select("line", "holder"), "frequent")
    key, other, listed = fresh(docs, "own_id", "lost_id", "lost_lines")
    wide = docs.withColumn(text, F.col(f"`{text}`").cast("string")).withColumn(key, F.col(f"`{id}`").cast("long"))
    if frequent.count() <= FREQUENT_LINES:
        holders = docs.sparkSession.sparkContext.broadcast(Holders(frequent.toArrow()))
        at, own = wide.columns.index(text), wide.columns.index(key)

        def lost(batch, bodies):
            held = holders.value
            found = [_long_lines(lines, min_chars) for lines in bodies]
            places = held.find([d for _, digests in found for d in digests])
            ids, start = batch.column(own).to_pylist(), 0
            for id, (lines, digests) in zip(ids, found, strict=True):
                mine = places[start : start + len(digests)]
                start += len(digests)
                yield {i for i, place in zip(lines, mine.tolist(), strict=True) if place >= 0 and held.ids[place] != id}

    else:
        gone = suspects.join(frequent, "line").where(~F.col("id").eqNullSafe(F.col("holder")))
        gone = gone.groupBy(F.col("id").alias(other)).agg(F.collect_list("line").alias(listed))  # lines of one document
        wide = wide.join(gone.hint("shuffle_hash"), wide[key].eqNullSafe(gone[other]), "left").drop(other)
        at, out = wide.columns.index(text), wide.columns.index(listed)

        def lost(batch, bodies):
            for lines, digests in zip(bodies, batch.column(out).to_pylist(), strict=True):
                dropped = set(digests or ())
                places, mine = _long_lines(lines, min_chars) if dropped else ([], [])
                yield {i for i, digest in zip(places, mine, strict=True) if digest in dropped}

    def make():
        def compute(batch):
            bodies = [body.split(b"\n") for body in utf8(batch, at)]
            dropped = list(lost(batch, bodies))
            texts = [b"\n".join([x for i, x in enumerate(lines) if i not in out]) for lines, out in zip(bodies, dropped, strict=True)]
            return [pa.array(texts, pa.binary()).cast(pa.string()), [len(lines) for lines in bodies], [len(out) for out in dropped]]

        return compute

    fields = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = with_columns(wide, make, fields, [c for c in wide.columns if c not in (key, listed)])
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_lines", "n_dropped")
