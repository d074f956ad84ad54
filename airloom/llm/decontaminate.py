"""Benchmark items inside documents, found within an edit distance.

An item of m characters may differ in k = m // CHARS_PER_ERROR places. Cut into k + 1 pieces, at
least one piece of it stands unchanged in any text within that distance. One Aho-Corasick automaton
finds all pieces of all items; around each hit Myers' bit-parallel distance verifies the item.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.frames import fresh, named, strings, with_columns

CHARS_PER_ERROR = 20
#: Items that one pass over the documents carries to every task: at most so many bytes of text.
ITEM_BYTES = 32 << 20

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType())])


def normalised(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def best_distance(masks: dict[str, int], length: int, text: str) -> int:
    """The least edit distance of a pattern to any substring of a text; ``masks`` has the pattern's
    places of each character as bits. Myers' recurrence over one integer of ``length`` bits."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best = score
    for ch in text:
        equal = masks.get(ch, 0)
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(zero | up)), up & zero
    return best


class Matcher:
    """Items as an automaton of pieces."""

    def __init__(self, items: list[tuple[int, str]], per_error: int):
        self.items, pieces = [], {}
        for item, text in items:
            text = normalised(text)
            if not text:
                continue
            errors = len(text) // per_error
            masks: dict[str, int] = {}
            for i, ch in enumerate(text):
                masks[ch] = masks.get(ch, 0) | 1 << i
            bounds = [round(i * len(text) / (errors + 1)) for i in range(errors + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item, text, errors, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[dict]:
        """Each item within its distance of some part of the text, with the least distance."""
        if not self.items:
            return []
        text = normalised(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                _, item, errors, _ = self.items[n]
                start = end + 1 - size - offset
                low, high = max(start - errors, 0), start + len(item) + errors
                mine = windows.setdefault(n, [])
                if mine and low <= mine[-1][1] and low >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], high)
                else:
                    mine.append([low, high])
        found = []
        for n, spans in windows.items():
            name, item, errors, masks = self.items[n]
            best = errors + 1
            for low, high in spans:
                near = text[low:high]
                best = min(best, 0 if item in near else best_distance(masks, len(item), near))
                if not best:
                    break
            if best <= errors:
                found.append({"item_id": name, "distance": best})
        return sorted(found, key=lambda h: (h["item_id"] is None, h["item_id"] or 0))


def with_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    per_error: int = CHARS_PER_ERROR, out: str = "hits",
) -> DataFrame:
    """``docs`` with the list of benchmark items (item_id, distance) that each text holds.

    Texts and items are compared in lower case with single spaces. Null and empty texts hold
    nothing; null and empty items are in no text; repeated items give a hit each. A column named
    ``out`` in the input is replaced. Items reach the tasks in slices of at most ``ITEM_BYTES``
    bytes of text, each slice in a pass of its own, so a benchmark of any size is matched whole.
    """
    items = named(items, item_id=item_id, text=item_text)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // ITEM_BYTES) or 1
    places = []
    at, spark = docs.columns.index(text), docs.sparkSession
    for n in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).collect()  # bounded: see above
        mine = spark.sparkContext.broadcast([(r.item_id, r.text or "") for r in mine])
        (place,) = fresh(docs, f"{out}_{n}")
        places.append(place)

        def make(mine=mine):
            matcher = Matcher(mine.value, per_error)
            return lambda batch: [[matcher.hits(t) for t in strings(batch, at)]]

        docs = with_columns(docs, make, [T.StructField(place, T.ArrayType(HIT))])
    merged = F.concat(*[F.col(f"`{p}`") for p in places])
    return docs.withColumn(out, merged).drop(*places)


def contaminations(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row (id, item_id, distance) for each document and item found in it."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = with_hits(rows, items, **options).select("id", F.explode("hits").alias("hit"))
    return found.select(F.col("id").alias(id), "hit.item_id", "hit.distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they were."""
    (hits,) = fresh(docs, "hits")
    return with_hits(docs, items, text, out=hits, **options).where(F.size(hits) == 0).drop(hits)
