"""Near-duplicate documents by SimHash, linked inside shards with BK-trees.

Every pair of fingerprints that differ in at most three of 64 bits agrees in three of six blocks of
bits, so each fingerprint goes to the 20 shards named by three of its blocks and pairs are sought
inside shards only. Shards are dealt out by key, not broadcast: all fingerprints of a large corpus
are no bounded side. Inside a shard a BK-tree finds the links, and only a spanning forest of them
leaves the task, so a group of g copies costs g rows and not g * g.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.frames import fresh, utf8, with_columns
from airloom.session import settled

BITS = 64
RADIUS = 3
BLOCKS = 6
SHARD_ROWS = 4_000
WORDS = 3
SEED = 42


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if more than half of the shingles' hashes have it."""
    tokens = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not tokens:
        return 0
    joined, starts, at = b" ".join(tokens), [], 0
    for token in tokens:
        starts.append(at)
        at += len(token) + 1
    starts.append(at)
    last = max(len(tokens) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[starts[i] : starts[min(i + words, len(tokens))] - 1], seed) for i in range(last)), np.uint64, last
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, 4096):
        part = hashes[at : at + 4096].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each text; a null text has fingerprint zero."""
    at = docs.columns.index(text)

    def make():
        def compute(batch):
            prints = np.array([fingerprint(t) for t in utf8(batch, at)], np.uint64)
            return [pa.array(prints.view(np.int64))]

        return compute

    return with_columns(docs, make, [T.StructField(out, T.LongType())], keep)


class BKTree:
    """Fingerprints of one shard: a child hangs at its Hamming distance from the parent."""

    def __init__(self, radius: int):
        self.radius, self.values, self.edges = radius, [], []

    def add(self, value: int) -> list[int]:
        """Insert a value and return the places of all earlier values within the radius."""
        near, radius, values, edges = [], self.radius, self.values, self.edges
        place = len(values)
        values.append(value)
        edges.append({})
        if not place:
            return near
        todo = [0]
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                near.append(node)
            todo += [child for edge, child in edges[node].items() if d - radius <= edge <= d + radius]
        node = 0
        while True:
            d = (values[node] ^ value).bit_count()
            if d not in edges[node]:
                edges[node][d] = place
                return near
            node = edges[node][d]


def _blocks(value: str, bits: int = BITS, blocks: int = BLOCKS) -> list[Column]:
    bounds = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [
        F.shiftrightunsigned(F.col(value), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for low, high in zip(bounds, bounds[1:], strict=False)
    ]


def _shard_links(radius: int):
    def link(batches):
        """Rows of a partition in shard order: (shard, node, print) to (node, root)."""
        shard, tree, nodes, roots = None, None, [], []

        def find(i):
            while roots[i] != i:
                roots[i] = roots[roots[i]]
                i = roots[i]
            return i

        for batch in batches:
            out = [], []
            for key, node, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != shard:
                    shard, tree, nodes, roots = key, BKTree(radius), [], []
                place = len(nodes)
                nodes.append(node)
                roots.append(place)
                for other in tree.add(value & 0xFFFFFFFFFFFFFFFF):
                    a, b = find(place), find(other)
                    if a != b:
                        roots[max(a, b)] = min(a, b)
                        out[0].append(nodes[max(a, b)])
                        out[1].append(nodes[min(a, b)])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return link


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest, shard by shard, of all links among distinct fingerprints.

    ``prints``: (node, fingerprint), a fingerprint once. Rows (a, b) name two nodes. About 32 equal
    bits leave few fingerprints in a shard unless they are near copies of each other; a shard of
    more than ``SHARD_ROWS`` is dealt out again by each fourth of its bits, one of which every pair
    within the radius has in common.
    """
    blocks = _blocks("fingerprint")
    shards = F.array(*[
        F.xxhash64(F.lit(n), *[blocks[i] for i in chosen])
        for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius))
    ])
    dealt = prints.select(F.explode(shards).alias("shard"), "node", "fingerprint")
    large = settled(dealt.groupBy("shard").count().where(F.col("count") > SHARD_ROWS).select("shard", F.lit(True).alias("large")), "large")
    comb = sum(1 << i for i in range(0, BITS, radius + 1))
    split = F.array(*[F.xxhash64("shard", F.col("fingerprint").bitwiseAND(F.lit(_signed(comb << k)))) for k in range(radius + 1)])
    dealt = dealt.join(large, "shard", "left").select(
        F.explode(F.when(F.col("large"), split).otherwise(F.array("shard"))).alias("shard"), "node", "fingerprint"
    )
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "fingerprint")
    return ordered.mapInArrow(_shard_links(radius), "a long, b long").distinct()


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps, each a minimum per node and a join on it, until the
    edges no longer change; a node's neighbours are never gathered. Every round is written to the
    shared folder, which cuts the lineage and survives lost executors.
    """

    def ordered(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(df, both: bool):
        pairs = df.select("a", "b")
        if both:
            pairs = pairs.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = settled(low, "low")  # with a plain table on either side, adaptive execution can split a hub's rows
        hooked = pairs.join(low, "a")
        if both:  # the larger neighbours of a node hang on the smallest node around it
            return ordered(hooked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        return ordered(hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))))

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = settled(ordered(edges), "links")
    seen = state(now)
    while True:
        now = settled(star(star(now, True), False), "links")
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the smallest id reachable.

    Equal fingerprints are one node, so exact copies never meet as pairs. Rows with the same id each
    get a row, linked by their fingerprints only. A null id is carried along; component_id is null
    if the whole group has none. Empty and null texts have fingerprint zero and link like any other.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = settled(fingerprints(rows, "text", keep=["id"]), "prints")
    nodes = settled(rows.groupBy("fingerprint").agg(F.min("id").alias("low")), "nodes")
    linked = components(links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), radius))
    found = nodes.join(linked, F.col("fingerprint") == F.col("node"), "left")
    found = settled(found.select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("component")), "found")
    lows = settled(found.groupBy("component").agg(F.min("low").alias("component_id")), "components")
    classes = settled(found.join(lows, "component").select("fingerprint", "component_id"), "classes")
    return rows.join(classes, "fingerprint").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows that repeat an id are one document and stay or go together, and so are all rows with a null
    id: they stay if any group has no other.
    """
    kept = near_duplicates(docs, id, text, radius).where(F.col(f"`{id}`").eqNullSafe(F.col("component_id")))
    (key,) = fresh(docs, "kept")
    kept = kept.select(F.col(f"`{id}`").alias(key)).distinct()
    return docs.join(kept, docs[id].cast("long").eqNullSafe(kept[key]), "left_semi")
