"""The trie of conversation prefixes, without building it turn by turn.

Identical conversations collapse into one weighted sequence with the list of conversations that end
there. Sequences that are proper prefixes of others are found by an anti-join, the rest are leaves;
node figures are weighted sums over the prefixes of the collapsed sequences.

A prefix is named by its depth and two sums of 64-bit hashes, one hash for each turn and its place:
sums can be carried over the chunks of a conversation that is too large for one task
(``airloom.operators.ordered``), and texts are hashed once and never shuffled after numbering. Two
prefixes of equal depth share a name by chance in about 1 of 2^128 cases.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.frames import SPACE, text_of
from airloom.operators.ordered import CHUNK_ROWS, Series, with_ordinal, with_totals
from airloom.session import settled

WORD = SPACE.replace("[", "[^") + "+"

#: Depth and both hash sums.
_NODE = ["depth", "k1", "k2"]


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row for each distinct prefix, the textless root included. ``ends``: one row for
    each conversation, with the node (its smallest member and depth) at which it ends."""

    nodes: DataFrame
    ends: DataFrame


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv, n, role, text): turns numbered from 1 in each conversation by ``turn`` (null first),
    equal ones by role and text. Null role or text becomes empty; repeated rows are turns of their own."""
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    series = Series(("conv",), "turn", ("role", "text"), chunk_rows)
    return with_ordinal(rows, series, "n").select("conv", "n", "role", "text")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("n").cast("long"), "role", "text").cast("decimal(20,0)")


def _joined(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str) -> DataFrame:
    """A join on null-safe equality that keeps none of the right side's key columns."""
    names = {r: f"_r{i}" for i, r in enumerate(pairs.values())}
    right = right.withColumnsRenamed(names)
    on = [F.col(le).eqNullSafe(F.col(names[ri])) for le, ri in pairs.items()]
    return left.join(right, on, how).drop(*names.values())


def prefix_trie(rows: DataFrame, convs: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> Trie:
    """Of numbered turns (conv, n, role, text), as ``numbered`` makes them; ``convs`` (conv) adds
    conversations without any turn, which end at the root.

    Node columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens: summed over the subtree, the
    words of a node's last text times its members but one. The node of a prefix is (conv_id, depth).

    A null conversation id is a conversation of its own and the smallest. Texts may have any length.
    An empty table has no nodes, not even a root.
    """
    turns = rows.select("conv", F.col("n").cast("long").alias("depth"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), _hash(1).alias("h1"), _hash(2).alias("h2"))
    series = Series(("conv",), "depth", (), chunk_rows)
    prefixes = settled(with_totals(turns, series, {"k1": F.col("h1"), "k2": F.col("h2")}), "prefixes")

    last = prefixes.groupBy("conv").agg(F.max_by(F.struct(*_NODE), "depth").alias("at")).select("conv", "at.*")
    if convs is not None:
        ids = convs.select("conv").union(prefixes.select("conv")).distinct()
        none = F.lit(0).cast("decimal(30,0)")
        last = _joined(ids, last, {"conv": "conv"}, "left").select(
            "conv", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("k1", none).alias("k1"), F.coalesce("k2", none).alias("k2")
        )
    last = settled(last, "last_turns")

    # Whole-sequence collapse: one row for each distinct conversation, named by its smallest id.
    sequences = settled(last.groupBy(*_NODE).agg(F.min(F.struct("conv")).alias("seq"), F.count(F.lit(1)).alias("weight")).select("seq.conv", *_NODE, "weight"), "sequences")
    weights = sequences.select("conv", "weight", F.col("depth").alias("length"))
    paths = _joined(prefixes, weights, {"conv": "conv"}, "inner").select(
        "conv", *_NODE, "words", (F.col("k1") - F.col("h1")).alias("p1"), (F.col("k2") - F.col("h2")).alias("p2"), "weight", "length"
    )
    zero = F.lit(0).cast("decimal(31,0)")
    roots = weights.select("conv", F.lit(0).cast("long"), zero, zero, F.lit(0).cast("long"), zero, zero, "weight", "length")
    paths = settled(paths.union(roots), "paths")

    # Leaves: the sequences that no longer one has as a proper prefix.
    proper = paths.where(F.col("depth") < F.col("length")).select(*_NODE).distinct()
    leaves = _joined(sequences.select("conv", *_NODE), proper, {c: c for c in _NODE}, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))

    marked = _joined(paths, leaves, {"conv": "conv"}, "left")
    nodes = marked.groupBy(*_NODE).agg(
        F.min(F.struct("conv")).alias("least"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.coalesce(F.sum("leaf"), F.lit(0).cast("long")).alias("n_leaves"),
    )
    nodes = settled(nodes.select(F.col("least.conv").alias("conv_id"), *_NODE, "n_convs", "words", "p1", "p2", "n_leaves"), "nodes")

    # What a node saves is booked on the sequence of its smallest member; from there it is summed to
    # the end of each path. A subtree's sum takes that of each sequence that passes through its top.
    saved = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    owned = _joined(paths, saved, {"conv": "conv_id", "depth": "depth"}, "left")
    owned = owned.select("conv", *_NODE, (F.col("length") - F.col("depth")).alias("left"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved"))
    below = with_totals(owned, Series(("conv",), "left", (), chunk_rows), {"total": F.col("saved")})
    below = below.groupBy(*_NODE).agg(F.sum("total").alias("saved_tokens"))

    parent = {"above": "depth", "p1": "k1", "p2": "k2"}
    full = nodes.withColumn("above", F.col("depth") - 1)
    children = full.where(F.col("depth") > 0).groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    full = _joined(full, below, {c: c for c in _NODE}, "left")
    full = _joined(full, children, {"depth": "above", "k1": "p1", "k2": "p2"}, "left")
    full = _joined(full, nodes.select(F.col("conv_id").alias("parent_conv_id"), *_NODE), parent, "left")
    full = full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens")

    ends = _joined(last, nodes.select("conv_id", *_NODE), {c: c for c in _NODE}, "inner").select("conv_id", "depth", F.col("conv").alias("member"))
    return Trie(full, ends)


def _blocks(batches):
    """Runs of one node's members in a sorted part, as comma-joined text."""
    for batch in batches:
        convs, depths, members = (batch.column(c).to_pylist() for c in ("conv_id", "depth", "member"))
        out = []
        for key, run in groupby(zip(convs, depths, members, strict=True), lambda r: r[:2]):
            ids = [r[2] for r in run]
            out.append((*key, ids[0], ",".join("null" if x is None else str(x) for x in ids)))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "first", "ids"])


def _digests(batches):
    """SHA-256 over the blocks of each node, which come in order; no node is held as a whole."""
    at, state = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        done = []
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if at != (conv, depth):
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (conv, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield batch_of(done)
    if at:
        yield batch_of([(*at, state.hexdigest())])


def with_end_digests(trie: Trie) -> DataFrame:
    """The nodes with ends_sha256: SHA-256 hex of the ids that end there, ascending, comma-joined.

    Members are sorted by range, so a node of very many is dealt over tasks; each joins its run, and
    one pass over the runs of a node feeds the hash. Only blocks of one batch are in memory.
    """
    order = ["conv_id", "depth", "member"]
    ends = trie.ends.select(*[F.col(c).cast("long").alias(c) for c in order])
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, "conv_id long, depth long, first long, ids string")
    dealt = runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    digests = dealt.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")
    found = _joined(trie.nodes, digests, {"conv_id": "conv_id", "depth": "depth"}, "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
