"""Secrets in texts: a trigram inverted index picks the texts that a rule can match at all.

Each rule's regular expression is read for the literal text that every match must hold; from it comes
a Boolean query over trigrams. Postings (trigram, id) are made for the trigrams that the queries name,
queries intersect them, and only the texts of candidates are matched. Rules without mandatory
trigrams are matched against all texts. Everything is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.frames import text_of
from airloom.session import settled

#: Candidates that are broadcast, counted first; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Strings that a run of pattern elements may stand for before the run is closed, and trigrams of one
#: alternative that are asked for (bits of a long).
MOST_STRINGS = 64
MOST_GRAMS = 60
#: Matches whose places are summed one after the other.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``least``: (group, characters), which drops matches whose group is shorter. ``fold``: ASCII
    letters of the pattern stand for either case."""

    kind: str
    pattern: str
    fold: bool = False
    least: tuple[int, int] | None = None

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


#: The three base kinds. A run of hexadecimal digits or capitals is taken whole by a
#: greedy match, so the least length can stand in the pattern; an assignment that is too short still
#: uses up its text.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, (2, 12)),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Published formats of further credentials.
FORMATS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("login", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._-]{1,64}:[!-.0-9:-?A-~]{1,128}@"),
)

RULES = (*BASE, *FORMATS)


def _strings(node: tuple) -> set[str] | None:
    """All texts that a pattern element stands for, if they are few; else None."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value)}
    if op == "AT":
        return {""}
    if op == "IN":
        plain = all(str(o) in ("LITERAL", "RANGE") for o, _ in value)
        chars = {chr(c) for o, v in value for c in (range(v[0], v[1] + 1) if str(o) == "RANGE" else [v])} if plain else set()
        return chars if 0 < len(chars) <= 8 else None
    if op == "BRANCH":
        sides = [_all(side) for side in value[1]]
        return None if None in sides else set().union(*sides)
    if op == "SUBPATTERN":
        return _all(value[-1])
    if op == "MAX_REPEAT" and value[1] == 1:
        inner = _all(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _all(nodes: Iterable[tuple]) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(rule: Rule) -> list[list[tuple[str, ...]]]:
    """What every match of a rule holds: all of the clauses, of each clause one of its alternatives,
    of an alternative all trigrams (in lower case where the rule folds). Empty if nothing is certain."""
    runs, run = [], {""}
    for node in re._parser.parse(rule.pattern):  # the standard library's own reader of patterns
        more = _strings(node)
        if more is None or len(run) * len(more) > MOST_STRINGS:
            runs.append(run)
            run = more if more is not None else {""}
        else:
            run = {a + b for a in run for b in more}
    clauses = []
    for strings in (*runs, run):
        strings = {x.lower() if rule.fold else x for x in strings}
        if min(map(len, strings)) >= 3:
            grams = {frozenset(sorted({x[i : i + 3] for i in range(len(x) - 2)})[:MOST_GRAMS]) for x in strings}
            clauses.append(sorted(tuple(sorted(g)) for g in grams if not any(other < g for other in grams)))
    return clauses


@dataclass(frozen=True)
class Query:
    """The rules' trigram queries: ``grams`` numbers (folded, trigram); ``alternatives`` lists (clause,
    numbers); ``needs`` gives the clauses of each rule that has any."""

    grams: list[tuple[bool, str]]
    alternatives: list[tuple[int, list[int]]]
    needs: dict[int, list[int]]


def compiled(rules: Sequence[Rule]) -> Query:
    numbers: dict[tuple[bool, str], int] = {}
    alternatives, needs = [], {}
    clause = 0
    for i, rule in enumerate(rules):
        for options in trigram_query(rule):
            needs.setdefault(i, []).append(clause)
            for grams in options:
                alternatives.append((clause, [numbers.setdefault((rule.fold, g), len(numbers)) for g in grams]))
            clause += 1
    return Query(list(numbers), alternatives, needs)


def grams_in(text: Column, low: Column, query: Query) -> Column:
    """Numbers of the asked-for trigrams that a text holds; ``low`` is the text in lower case."""
    return F.array_compact(F.array(*[F.when(F.contains(low if fold else text, F.lit(g)), F.lit(i)) for i, (fold, g) in enumerate(query.grams)]))


def candidates(index: DataFrame, query: Query, spark: SparkSession) -> DataFrame:
    """(id, rules): the ids whose postings meet the query of some rule, and which rules."""
    asked = [
        F.struct(F.lit(g).alias("gram"), F.lit(a).alias("alternative"), F.lit(clause).alias("clause"),
                 F.lit(1 << bit).cast("long").alias("bit"), F.lit((1 << len(grams)) - 1).cast("long").alias("whole"))
        for a, (clause, grams) in enumerate(query.alternatives) for bit, g in enumerate(grams)
    ]
    if not asked:
        return index.select("id", F.array().cast("array<int>").alias("rules")).limit(0)
    asked = F.broadcast(spark.range(1).select(F.inline(F.array(*asked))))  # as many rows as the rules ask for
    hits = index.join(asked, "gram").groupBy("id", "alternative", "clause", "whole").agg(F.bit_or("bit").alias("held"))
    met = hits.where(F.col("held") == F.col("whole")).groupBy("id").agg(F.collect_set("clause").alias("clauses"))
    rules = F.array_compact(F.array(*[
        F.when(F.size(F.array_intersect("clauses", F.array(*map(F.lit, need)))) == len(need), F.lit(i)) for i, need in query.needs.items()
    ]))
    return met.select("id", rules.alias("rules")).where(F.size("rules") > 0)


_SPANS = "array<struct<start:long,kind:int,end:long>>"


def spans_of(text: Column, rules: Sequence[Rule], number: int) -> Column:
    """Matches of one rule from left to right as (start, kind, end) in code points, end exclusive.

    The text between matches and the matches themselves alternate, so places are running sums of
    their lengths, taken block by block.
    """
    rule = rules[number]
    whole, between = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), F.split(text, rule.java, -1)
    group, least = rule.least or (0, 0)
    judged = F.regexp_extract_all(text, F.lit(rule.java), F.lit(group)) if group else whole
    parts = F.zip_with(F.arrays_zip(whole.alias("w"), judged.alias("j")), F.slice(between, 1, F.size(whole)), lambda m, b: F.struct(
        F.length(b).cast("long").alias("skip"), F.length(m["w"]).cast("long").alias("size"), (F.length(m["j"]) >= least).alias("good")
    ))

    def placed(parts: Column) -> Column:
        count = F.floor((F.size(parts) + (BLOCK - 1)) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + p["skip"] + p["size"]))
        begins = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

        def add(acc: Column, p: Column) -> Column:
            end = acc["at"] + p["skip"] + p["size"]
            span = F.struct((acc["at"] + p["skip"]).alias("start"), F.lit(number).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(p["good"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        def block_spans(entry: Column) -> Column:
            start = F.struct(entry["begin"].alias("at"), F.array().cast(_SPANS).alias("out"))
            return F.aggregate(entry["block"], start, add, lambda acc: acc["out"])

        zipped = F.zip_with(blocks, F.slice(begins, 1, count), lambda block, begin: F.struct(block.alias("block"), begin.alias("begin")))
        return F.flatten(F.transform(zipped, block_spans))

    found = F.transform(F.array(parts), placed)[0]
    return F.when(text.rlike(rule.java), found).otherwise(F.array().cast(_SPANS))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, spans): for each row its secrets as (start, kind, end), sorted; kind is the rule's place in
    ``rules``, places count code points, end is exclusive. Matches of one kind do not overlap, those of
    different kinds may.

    A null text is empty. Null ids and ids of several rows are allowed: each row gets its own spans.
    An empty table gives no rows; other columns are not read. Texts are matched whole whatever their
    length; a text, its matches and the text between them must fit into a task's memory.
    """
    query = compiled(rules)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_of(text).alias("text")).withColumn("body", F.md5(F.col("text").cast("binary")))
    everywhere = [i for i in range(len(rules)) if i not in query.needs]
    scanned = F.concat(*[spans_of(F.col("text"), rules, i) for i in everywhere], F.array().cast(_SPANS))
    held = grams_in(F.col("text"), F.col("low"), query) if query.grams else F.array().cast("array<int>")
    first = settled(rows.withColumn("low", F.lower("text")).select("id", "body", scanned.alias("spans"), held.alias("grams")), "scanned")

    index = first.select("id", F.explode("grams").alias("gram"))
    chosen = settled(candidates(index, query, spark), "candidates")
    few = chosen.withColumnRenamed("id", "at")
    if chosen.count() <= BROADCAST_IDS:
        few = F.broadcast(few)
    verified = rows.join(few, rows["id"].eqNullSafe(few["at"]))
    more = F.concat(*[
        F.when(F.array_contains("rules", i), spans_of(F.col("text"), rules, i)).otherwise(F.array().cast(_SPANS)) for i in query.needs
    ], F.array().cast(_SPANS))
    verified = verified.select(F.col("id").alias("at"), F.col("body").alias("of"), more.alias("more")).where(F.size("more") > 0)
    verified = verified.dropDuplicates(["at", "of"])
    out = first.join(verified, first["id"].eqNullSafe(verified["at"]) & (first["body"] == verified["of"]), "left")
    return out.select(F.col("id").alias(id), F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def span_text(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
