"""Quality rules of documents, and lines that fill many documents of one host.

Everything is DataFrame expressions. A text is read once; what later steps need of it (counts, a hash
and a length for each line) is written as a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.frames import SPACE, fresh, text_of
from airloom.session import settled

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: A line is boilerplate of a host if more documents of the host hold it than this many. A document
#: is depleted if no more than this share of its line characters is left without such lines.
HOST_DOCS = 20
LEFT_SHARE = 0.3

#: Rows of a table that are broadcast, counted first; longer tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as a variable of a one-element array."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hash of each window in order."""

    def covered(ranked: Column) -> Column:
        def twice(entry, i):
            def like(at):
                return F.coalesce(F.get(ranked, at)["h"] == entry["h"], F.lit(False))

            return like(i - 1) | like(i + 1)

        places = F.array_sort(F.transform(F.filter(ranked, twice), lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

        def add(acc, at):
            end = at.cast("long") + WINDOW
            return F.struct((acc["n"] + end - F.greatest(acc["end"], at.cast("long"))).alias("n"), end.alias("end"))

        return F.aggregate(places, start, add, lambda acc: acc["n"])

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_with(ranked, covered))


def line_hash(line: Column) -> Column:
    """Of a line in lower case, with single spaces and none at the ends."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " "))))


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of each text, and (hash, characters) of each line with a word; one row per row of ``docs``."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{host}`").cast("string").alias("host"), text_of(text).alias("text"))
    rows = rows.select(
        "id", "host", "text",
        F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(SPACE.replace("[", "[^"))).alias("lines"),
    )
    window = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.select(
        "id", "host", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, window).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    return rows.select(
        "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeat_words(F.col("windows")).alias("n_repeat_words"),
        F.transform("lines", lambda s: F.struct(line_hash(s).alias("h"), F.length(s).alias("c"))).alias("lines"),
    )


def frequent_lines(measured: DataFrame, host_docs: int = HOST_DOCS) -> DataFrame:
    """(of, line, holder): each boilerplate line of each host, by hash, and the smallest id that has it."""
    lines = measured.select("host", "id", F.explode(F.array_distinct(F.transform("lines", lambda s: s["h"]))).alias("h"))
    found = lines.distinct().groupBy("host", "h").agg(F.count("*").alias("n"), F.min("id").alias("holder"))
    return found.where(F.col("n") > host_docs).select(F.col("host").alias("of"), F.col("h").alias("line"), "holder")


def _small(df: DataFrame) -> DataFrame:
    """A written table with the hint to broadcast it, if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _measured(docs: DataFrame, id: str, text: str, host: str) -> DataFrame:
    """``measures``, written once, with a number for each row, as ids may repeat."""
    return settled(measures(docs, id, text, host).withColumn("row", F.monotonically_increasing_id()), "measures")


def _gone(measured: DataFrame, host_docs: int) -> DataFrame:
    """(row, id, h, chars, times): the boilerplate lines that each row loses, one row for each different line.

    Lines meet the frequent ones by host and hash. A line that very many documents of a host share
    is one frequent key: the table of these is broadcast, or adaptive execution splits the key.
    """
    frequent = _small(settled(frequent_lines(measured, host_docs), "boilerplate"))
    lines = measured.select("row", "id", "host", F.explode("lines").alias("s"))
    met = lines.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("s.h") == F.col("line")) & ~F.col("id").eqNullSafe(F.col("holder")))
    return met.groupBy("row", "id", F.col("s.h").alias("h")).agg(F.sum("s.c").alias("chars"), F.count(F.lit(1)).alias("times"))


def _judged(measured: DataFrame, gone: DataFrame) -> DataFrame:
    lost = gone.groupBy(F.col("row").alias("at")).agg(F.sum("times").alias("n_gone"), F.sum("chars").alias("gone_chars"))
    judged = measured.join(lost, F.col("row") == F.col("at"), "left")
    none = F.lit(0).cast("long")
    judged = judged.withColumns({"n_gone": F.coalesce("n_gone", none), "gone_chars": F.coalesce("gone_chars", none)})
    all_chars = F.aggregate("lines", none, lambda n, s: n + s["c"])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    depleted = (F.col("n_gone") > 0) & (all_chars - F.col("gone_chars") <= all_chars * LEFT_SHARE)
    return judged.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.col("n_gone").alias("n_boilerplate"),
    )


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", host_docs: int = HOST_DOCS) -> DataFrame:
    """Counts and verdict of each document: (id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_boilerplate).

    ``base_failed``: under 10 words, or over a fifth of the words in repeated 5-word windows. Kept is
    what passes and is not depleted: without the boilerplate lines of its host, more than LEFT_SHARE
    of its line characters are left. A line is boilerplate if more than ``host_docs`` documents of the
    host hold it, whatever the host's size. Of these the one with the smallest id keeps
    it, so text that has copies is never lost whole. A null text is empty, a null host is a host of
    its own, null ids are one document, rows that repeat an id count once for their lines and each get
    a row. Texts are taken whole; a text and its words must fit into a task's memory.
    """
    measured = _measured(docs, id, text, host)
    return _judged(measured, _gone(measured, host_docs)).withColumnRenamed("id", id)


def _without(docs: DataFrame, id: str, text: str, lost: DataFrame) -> DataFrame:
    """``docs`` with the lines cut out whose hashes ``lost`` (of, hashes) lists for their id."""
    key, hashes = fresh(docs, "of", "hashes")
    lost = lost.toDF(key, hashes)
    joined = docs.join(lost, F.col(f"`{id}`").eqNullSafe(F.col(key)), "left")
    stays = F.filter(F.split(text_of(text), "\n"), lambda line: ~F.array_contains(hashes, line_hash(line)))
    cut = F.when(F.col(hashes).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(stays, "\n"))
    return joined.withColumn(text, cut).drop(key, hashes)


def _lost(gone: DataFrame) -> DataFrame:
    """(of, hashes): the lines that a document loses. Rows of one id lose the same lines; a document's
    list is as long as it has different boilerplate lines."""
    return gone.groupBy(F.col("id").alias("of")).agg(F.collect_set("h").alias("hashes"))


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", host_docs: int = HOST_DOCS) -> DataFrame:
    """The documents that ``judge`` keeps, without the boilerplate lines that it counts.

    Of rows that repeat an id all must be kept. Other columns stay as they are. Only ids that are
    rejected or lose lines are joined to the texts; where they are few, no text is shuffled.
    """
    measured = _measured(docs, id, text, host)
    gone = settled(_gone(measured, host_docs), "gone")
    (key,) = fresh(docs, "rejected")
    rejected = _judged(measured, gone).where(~F.col("kept")).select(F.col("id").alias(key)).distinct()
    rejected = settled(rejected, "rejected")
    few = _small(rejected)
    lost = _small(settled(_lost(gone.join(few, F.col("id").eqNullSafe(F.col(key)), "left_anti")), "lost"))
    good = docs.join(few, F.col(f"`{id}`").eqNullSafe(F.col(key)), "left_anti")
    return _without(good, id, text, lost)


def without_boilerplate(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", host_docs: int = HOST_DOCS) -> DataFrame:
    """``docs`` with the boilerplate lines of each host cut out of the texts; other texts stay as they are."""
    gone = _gone(_measured(docs, id, text, host), host_docs)
    return _without(docs, id, text, _lost(gone))
