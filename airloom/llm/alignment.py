"""Two tokenizers' tokens of the same texts, cut into groups where both have a token's end.

A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model. Both see the text
after one space: A is given it, B puts it there itself. Positions are bytes. The ends of A's tokens
and of B's are looked up in two dictionaries from end to index; the ends that both hold, sorted, cut
both lists of ids into groups, and each cut links the two tokens that end there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from airloom.llm.frames import slices, small_batches, text_of
from airloom.llm.segments import _CUT, _IRREGULAR, Memo
from airloom.session import settled

SPACE_PIECE = "▁"
#: Segments that a Python worker remembers, and texts whose segments it looks up together.
MEMO = 100_000
ROWS = 256
#: The most frequent pairs of ids go to every task up to this many; links of rarer pairs are shuffled.
HEAD_PAIRS = 500_000

#: A segment without white space but the space or line feed it begins with.
_PLAIN = re.compile(r"[ \n]\S+")


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes of Latin-1 stand for
    themselves, the others, in order, for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """One tokenizer: the bytes of each id, and the ids of segments.

    A segment begins with a space or line feed. Plain ones are encoded in one text, each on a line of
    its own, and the ids cut at the line feeds' id; a segment's own line feed serves as its line's.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        if not self.sizes.all():
            raise ValueError("a token without bytes has no place of its own")
        self.feed = int(self.single("\n")[-1])

    def single(self, part: str) -> np.ndarray:
        raise NotImplementedError

    def lines(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a line feed, from there on."""
        return self.single(text)

    def encode(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments, the plain ones first, and how many each has."""
        flat, counts = np.empty(0, "<i4"), np.empty(0, np.int64)
        if plain:
            flat = self.lines("\n" + "\n".join([p.lstrip("\n") for p in plain]))
            at = np.flatnonzero(flat == self.feed)
            if len(at) == len(plain):
                foreign = np.array([p[0] == " " for p in plain])
                counts = np.diff(np.append(at, len(flat))) - foreign
                flat = np.delete(flat, at[foreign])
            else:  # each by itself
                flat, plain, others = np.empty(0, "<i4"), [], [*plain, *others]
        rest = [self.single(p) for p in others]
        return np.concatenate([flat, *rest]).astype(np.int64), np.concatenate([counts, [len(x) for x in rest]]).astype(np.int64)

    def written(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])


class _ByteLevel(_Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are plain text
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        pieces = [b"?"] * self.tokenizer.get_vocab_size()
        for entry, at in vocabulary.items():
            pieces[at] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        super().__init__(pieces)

    def single(self, part: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<i4")


class _Pieces(_Side):
    """``apart``: no piece has a space after another character, and none a line feed, so no merge joins
    what stands on either side of a cut before one."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.apart = all(re.fullmatch(f"{SPACE_PIECE}*[^{SPACE_PIECE}\n]*", x) for x in names)
        super().__init__([
            bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE_PIECE, " ").encode() for i, x in enumerate(names)
        ])

    def single(self, part: str) -> np.ndarray:
        """The model puts a space before each text: it stands for the segment's own, or is cut off."""
        if part[0] == " " and part != " ":
            return np.array(self.model.encode(part[1:], num_threads=1), "<i4")
        if part == " ":
            return np.array([self.model.piece_to_id(SPACE_PIECE)], "<i4")
        return np.array(self.model.encode(part, num_threads=1)[1:], "<i4")


@lru_cache(maxsize=2)
def _sides(first: str, second: str) -> tuple[_Side, _Side]:
    return _ByteLevel(first), _Pieces(second)


def aligned(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """Where the groups end, as (index in a, index in b), exclusive: after each end that both have."""
    at_a, at_b = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    return [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]


SCHEMA = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType(), False)), T.StructField("times", T.ArrayType(T.IntegerType(), False)),
])


def cut_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts after a space, cut before single spaces and line feeds between two other characters.

    There a match of A's pattern begins and no piece of B goes on, so both have a token's end, and
    groups never cross a cut. Returns all segments, and where each text's end.
    """
    odd = pc.match_substring_regex(texts, pattern=_IRREGULAR)
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
    marked = pc.binary_join_element_wise(" ", marked, "")
    if not pc.any(odd).as_py():
        cut = pc.split_pattern(marked, "\0")
        return cut.flatten(), np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])
    lists = pc.split_pattern(marked, "\0").to_pylist()
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        first, *rest = _CUT.split(texts[i].as_py())
        lists[i] = [" " + first, *rest]
    return pa.array(chain.from_iterable(lists), texts.type), np.array([0, *accumulate(map(len, lists))])


class _Aligner:
    """Aligns segments, each different one once, and puts the rows together from them."""

    def __init__(self, first: str, second: str, digest: bool):
        self.a, self.b = _sides(first, second)
        self.digest = digest
        self.memo = Memo(self.code, MEMO)
        signs = [f"{i}{x}" for i in range(len(self.a.pieces)) for x in ",|"] + [f"{i}{x}" for i in range(len(self.b.pieces)) for x in (",", ";", "")]
        self.signs = pa.array(signs, pa.large_string())

    def code(self, parts: list[str]) -> list[tuple]:
        """For each segment (n_a, n_b, n_groups, groups, linked pairs), or -1 for n_a if bytes differ."""
        plain = [i for i, p in enumerate(parts) if _PLAIN.fullmatch(p)]
        simple = set(plain)
        order = np.array([*plain, *[i for i in range(len(parts)) if i not in simple]])
        ordered = [parts[i] for i in order.tolist()]
        a, n_a = self.a.encode(ordered[: len(plain)], ordered[len(plain) :])
        b, n_b = self.b.encode(ordered[: len(plain)], ordered[len(plain) :])
        out: list[tuple] = [(-1, 0, 0, "", b"")] * len(parts)
        raw = [p.encode() for p in ordered]
        if not self.a.written(a) == b"".join(raw) == self.b.written(b):
            at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
            good = np.array([
                self.a.written(a[at_a[i] : at_a[i + 1]]) == text == self.b.written(b[at_b[i] : at_b[i + 1]]) for i, text in enumerate(raw)
            ])
            a, b, n_a, n_b, order = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a[good], n_b[good], order[good]
            if not len(order):
                return out

        # The segments one after the other, as one text: their ends are shared ones.
        a_ends, b_ends = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        cuts = np.array(aligned(a_ends.tolist(), b_ends.tolist()), np.int64)
        links = a[cuts[:, 0] - 1] * len(self.b.pieces) + b[cuts[:, 1] - 1]
        group_ends = np.searchsorted(cuts[:, 0], np.cumsum(n_a)) + 1  # groups up to and with each segment
        n_groups = np.diff(group_ends, prepend=0)

        # Each id is written with the sign that follows it; A's ids of a group come before B's.
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), np.int64)
        a_last[cuts[:, 0] - 1] = True
        b_last[cuts[:, 1] - 1] = 1
        b_last[np.cumsum(n_b) - 1] = 2
        a_before = np.concatenate([[0], cuts[:, 0]])[np.searchsorted(cuts[:, 1], np.arange(len(b)), side="right") + 1]
        b_before = np.concatenate([[0], cuts[:, 1]])[np.searchsorted(cuts[:, 0], np.arange(len(a)), side="right")]
        signed = np.empty(len(a) + len(b), np.int64)
        signed[np.arange(len(a)) + b_before] = a * 2 + a_last
        signed[np.arange(len(b)) + a_before] = 2 * len(self.a.pieces) + b * 3 + b_last
        words = self.signs.take(pa.array(signed))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        ends = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        groups = pa.Array.from_buffers(pa.large_string(), len(order), [None, pa.py_buffer(ends), words.buffers()[2]]).to_pylist()
        at = pa.py_buffer(8 * np.concatenate([[0], group_ends]).astype(np.int64))
        pairs = pa.Array.from_buffers(pa.large_binary(), len(order), [None, at, pa.py_buffer(links)]).to_pylist()
        for place, found in zip(order.tolist(), zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), groups, pairs, strict=True), strict=True):
            out[place] = found
        return out

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        """The values of ``SCHEMA`` for the texts of a batch."""
        full = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        some = texts.take(pa.array(full))
        if not len(some):
            return self._arrays(len(texts), full, [], np.empty(0, bool), [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        parts, ends = cut_texts(some) if self.b.apart else (pc.binary_join_element_wise(" ", some, ""), np.arange(len(some) + 1))
        parts = parts.dictionary_encode()
        found = self.memo(parts.dictionary.to_pylist())
        numbers, kinds = list(zip(*found, strict=True)), (pa.large_string(), pa.large_binary())
        counts = np.array(numbers[:3], np.int64).T[parts.indices.to_numpy()]
        fine = np.minimum.reduceat(counts[:, 0], ends[:-1]) >= 0
        totals = np.where(fine[:, None], np.add.reduceat(counts, ends[:-1]), 0)
        groups, links = (pa.array(x, kind).take(parts.indices) for x, kind in zip(numbers[3:], kinds, strict=True))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups), pa.scalar(";", pa.large_string())).to_pylist()
        if self.digest:
            joined = [hashlib.sha256(x.encode()).hexdigest() if ok else "" for x, ok in zip(joined, fine.tolist(), strict=True)]
        flat = np.frombuffer(links.buffers()[2] or b"", np.int64, int(counts[:, 2].sum()))
        texts_of = np.repeat(np.arange(len(some)), np.add.reduceat(counts[:, 2], ends[:-1]))
        keep = fine[texts_of]
        span = len(self.a.pieces) * len(self.b.pieces)
        keys, times = np.unique(texts_of[keep] * span + flat[keep], return_counts=True)
        return self._arrays(len(texts), full, totals, fine, joined, keys // span, keys % span, times)

    @staticmethod
    def _arrays(n: int, full, totals, fine, groups, owner, pairs, times) -> list[pa.Array]:
        numbers = np.zeros((n, 3), np.int64)
        texts = [""] * n
        if len(full):
            numbers[full] = totals
            for i, text, ok in zip(full.tolist(), groups, fine.tolist(), strict=True):
                texts[i] = text if ok else ""
        sizes = np.bincount(full[owner], minlength=n) if len(owner) else np.zeros(n, np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return [
            *(pa.array(numbers[:, i], pa.int64()) for i in (0, 1, 2, 2)), pa.array(texts, pa.string()),
            pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
        ]


@lru_cache(maxsize=2)
def _aligner(first: str, second: str, digest: bool) -> _Aligner:
    """Kept with its memory of segments for the next task of a worker."""
    return _Aligner(first, second, digest)


def align(docs: DataFrame, first: str, second: str, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times): one row per row of ``docs``.

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3`` (``digest``: the SHA-256 of that). ``pairs`` are
    the linked ids, a * (size of B's vocabulary) + b, each different one once, with its ``times``. No
    token is empty, so a group has one link, between its last tokens.

    Null and empty texts, and those whose tokens' bytes are not a space and the text (B writes a
    space for U+2581), have no tokens: zeros, '' and empty lists. Special tokens' strings are plain
    text. Ids may be null or repeat; an empty table gives no rows. Texts are taken whole; those of
    one batch of ``BATCH_ROWS`` must fit in a worker. Both files must be readable on every executor.
    """
    rows = docs.select(F.col(f"`{id}`"), text_of(text).alias("_text"))

    def run(batches):
        aligner = _aligner(first, second, digest)
        for batch in slices(batches, ROWS):
            arrays = aligner.columns(batch.column(1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id, *SCHEMA.fieldNames()])

    return small_batches(rows).mapInArrow(run, T.StructType([rows.schema[id], *SCHEMA.fields]))


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best) over all documents: how many links have the pair, and whether no other pair
    of the same B id has more."""
    counts = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("x.pairs").agg(F.sum("x.times").alias("count"))
    counts = settled(counts.withColumnRenamed("pairs", "pair"), "pair_counts")
    b = (F.col("pair") % b_size).alias("b")
    most = F.broadcast(counts.groupBy(b).agg(F.max("count").alias("most")))  # at most a row for each id of B
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(found: DataFrame, b_size: int, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``found``, from ``align``, with n_best and count_sum in place of pairs and times.

    ``count_sum`` adds the corpus-wide counts of a document's links, ``n_best`` counts the links whose
    count is the highest of their B id, ties included. Pairs with at least so many links that no more
    than ``head_pairs`` have are broadcast; only links of rarer pairs are shuffled to their counts,
    so no key of that join is frequent.
    """
    found = settled(found.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = settled(pair_counts(found, b_size), "pair_ranks")
    # Pairs by the power of two of their count: the highest powers that together stay within the bound.
    powers = counts.groupBy((F.length(F.bin("count")) - 1).alias("p")).count().orderBy(F.desc("p")).collect()  # at most 63 rows
    least = next((1 << (r["p"] + 1) for r, n in zip(powers, accumulate(r["count"] for r in powers), strict=True) if n > head_pairs), 0)
    links = found.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    if least == 0:
        scored = links.join(F.broadcast(counts), "pair").groupBy("_row").agg(*sums)
    else:
        head, tail = counts.where(F.col("count") >= least), counts.where(F.col("count") < least)
        met = links.join(F.broadcast(head), "pair").groupBy("_row").agg(*sums)
        rest = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(tail, "pair").groupBy("_row").agg(*sums)
        scored = met.unionByName(rest).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    out = found.drop("pairs", "times").join(scored, "_row", "left").drop("_row")
    return out.withColumns({"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)})


def b_size(second: str) -> int:
    return SentencePieceProcessor(model_file=second).vocab_size()
