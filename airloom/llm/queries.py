"""The operators over whole tables, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import (
    alignment, bpe, chat, decontaminate, licenses, line_dedup, prefix_trie, quality, secret_scan, simhash, token_counts, token_files, url_filter,
)
from airloom.session import scratch, settled

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sha(col: str):
    return F.sha2(F.col(col).cast("binary"), 256)


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, BPE_RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    coded = coded.select("doc_id", "n_tokens", "ids", _sha("ids").alias("ids_sha256"))
    plain = bpe.decode(coded, BPE_RANKS, keep=["doc_id", "n_tokens", "ids_sha256"])
    return plain.select("doc_id", "n_tokens", "ids_sha256", _sha("decoded").alias("decoded_sha256"))


def line_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch(spark, "tokens")
    token_files.write_tokens(_table(spark, folder, "documents"), target, BPE_JSON)
    return token_files.token_checks(spark, target).select("doc_id", "start", "n_tokens", "ids_crc32")


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_notices(_table(spark, folder, "documents"))


def unigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, UNIGRAM, keep=["doc_id"])


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, folder, "pages").select("page_id", "url"), keep=["page_id"])


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = F.array(*[F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), said.alias("text")) for n, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(extra).alias("t")).select("conv_id", "t.*")
    out = settled(chat.format_chats(turns.unionByName(extra)), "chats")  # read back from what was written
    lines = F.array_join(F.transform(chat.parsed(F.col("segments")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id",
        (F.size("segments") / 3).cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length(chat.formatted(F.col("segments"))).cast("long").alias("formatted_chars"),
        "valid",
    )


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"))


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def secrets_found(spark: SparkSession, folder: str) -> DataFrame:
    out = secret_scan.find_secrets(_table(spark, folder, "documents"))

    def base(i: int):
        return F.filter("spans", lambda s: s["kind"] == i)

    counted = [F.size(base(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    only_base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    return out.select(
        "doc_id", *counted, F.sha2(secret_scan.span_text(only_base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def tokenizer_links(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = alignment.align(docs, BPE_JSON, PIECES, digest=True).withColumnRenamed("groups", "groups_sha256")
    return alignment.with_counts(found, alignment.b_size(PIECES)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the one with the next lower id that 20 divides: its first h turns
    (crc32 of the decimal id, modulo 4), then their own after the first h. A null id has h = 0.

    Returns the numbered turns and all ids.
    """
    rows = settled(prefix_trie.numbered(turns), "numbered")
    h = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % 4, F.lit(0))
    first = rows.where((F.col("conv") % 20 == 0) & (F.col("n") <= 3))
    starts = first.groupBy(F.col("conv").alias("base")).agg(F.max("n").alias("turns"))
    ids = rows.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    ids = ids.join(starts, "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("turns", F.lit(0))).cast("long").alias("led"))
    ids = settled(ids, "rebuilt_ids")
    taken = first.select(F.col("conv").alias("base"), "n", "role", "text").join(ids, "base").where(F.col("n") <= F.col("led"))
    known = ids.select(F.col("conv").alias("id"), "h", "led")
    own = rows.join(known, rows["conv"].eqNullSafe(known["id"])).where(F.col("n") > F.col("h"))
    own = own.select("conv", (F.col("n") - F.col("h") + F.col("led")).alias("n"), "role", "text")
    return own.unionByName(taken.select("conv", "n", "role", "text")), ids.select("conv")


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, ids = rebuilt(_table(spark, folder, "conversations"))
    return prefix_trie.with_end_digests(prefix_trie.prefix_trie(turns, ids))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe,
    "op2_line_dedup": line_repeats,
    "op3_token_files": token_output,
    "op4_benchmark_leaks": benchmark_leaks,
    "op5_license_scan": license_scan,
    "op6_token_counts": unigram_counts,
    "op7_url_rules": url_rules,
    "op8_chat_format": chat_format,
    "op9_quality_rules": quality_rules,
    "op10_simhash": simhash_groups,
    "op11_secret_scan": secrets_found,
    "op12_tokenizer_alignment": tokenizer_links,
    "op13_prefix_trie": conversation_trie,
}

_WS = r"[\x20\x09-\x0D]"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OUTER = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d"
_DOCS = "d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"


def _rule(name: str) -> str:
    host, _, path = name.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def _cases(value: Callable[[url_filter.Rule], str]) -> str:
    ranked = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    return " ".join(f"WHEN {_rule(r.name)} THEN '{value(r)}'" for r in ranked)


def _escape(col: str) -> str:
    return f"replace(replace({col}, '\\', '\\\\'), '<|', '<\\|')"


def _either_case(pattern: str) -> str:
    """ASCII letters of a pattern without classes of letters, each in both cases (RE2 would fold more)."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


def _secrets(number: int, rule: secret_scan.Rule) -> str:
    """The matches of a rule, and the places that follow from the lengths of what lies between them."""
    words, bracket, rest = rule.pattern.partition(")")
    pattern = ((_either_case(words) + bracket + rest) if rule.fold else rule.pattern).replace("'", "''")
    group, least = rule.least or (0, 0)
    return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, start + skip AS start, start + skip + size AS stop FROM (
        SELECT *, sum(skip + size) OVER (PARTITION BY doc_id ORDER BY i) - skip - size AS start FROM (
            SELECT doc_id, i, length(b[i]) AS skip, length(w[i]) AS size, length(j[i]) >= {least} AS good FROM (
                SELECT doc_id, unnest(generate_series(1, len(w))) AS i, w, j, b FROM (
                    SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS w, regexp_extract_all(text, '{pattern}', {group}) AS j,
                        string_split_regex(text, '{pattern}') AS b FROM d)))) WHERE good"""


def _span_list(condition: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER ({condition}), '')"


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

SQL: dict[str, str] = {
    "op2_line_dedup": f"""WITH {_DOCS}, l AS ({_LINES}),
        k AS (SELECT *, translate(trim(line, {_OUTER}), {_AZ}) AS key FROM l),
        f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key
            HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
        m AS (SELECT k.*, coalesce(f.holder <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op7_url_rules": f"""SELECT page_id, host, path, CASE {_cases(lambda r: r.name)} END AS rule,
        CASE {_cases(lambda r: r.verdict)} ELSE '{url_filter.ALLOW}' END AS verdict FROM (SELECT page_id,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_AZ}) AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
    "op8_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
            SELECT conv_id, turn, role, text FROM conversations UNION ALL
            SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|im_start|><|im_end|>') + 2 + length(replace({_escape('role')}, chr(10), '\\' || chr(10))) + length({_escape('text')})) AS BIGINT) AS formatted_chars,
            regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?(user assistant )*user assistant') AS valid
        FROM t GROUP BY conv_id""",
    "op9_quality_rules": f"""WITH {_DOCS}, w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_WS[1:]}+') AS words FROM d),
        p AS (SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
        v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS c FROM p),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM v, (SELECT unnest(range(5)) AS j) WHERE c > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, source, lower(trim(regexp_replace(line, '{_WS}+', ' ', 'g'))) AS h, length(line) AS c
            FROM ({_LINES}) WHERE regexp_matches(line, '[^{_WS[1:]}')),
        f AS (SELECT source, h, min(doc_id) AS holder FROM l GROUP BY source, h HAVING count(DISTINCT doc_id) > {quality.HOST_DOCS}),
        g AS (SELECT doc_id, count(*) FILTER (holder <> doc_id) AS gone, sum(c) AS chars, coalesce(sum(c) FILTER (holder <> doc_id), 0) AS cut
            FROM l LEFT JOIN f ON f.source = l.source AND f.h = l.h GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS[1:]}')) AS ls, coalesce(r.n, 0) AS n_repeat_words,
            coalesce(gone, 0) AS n_boilerplate, coalesce(gone > 0 AND chars - cut <= chars * {quality.LEFT_SHARE}, false) AS depleted
            FROM w LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, n_boilerplate,
            n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
            NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words OR depleted) AS kept FROM m""",
    "op11_secret_scan": f"""WITH {_DOCS}, s AS ({" UNION ALL ".join(_secrets(i, r) for i, r in enumerate(secret_scan.RULES))})
        SELECT d.doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(secret_scan.BASE))},
            sha256({_span_list(f"k < {len(secret_scan.BASE)}")}) AS base_sha256, {_span_list("k IS NOT NULL")} AS spans
        FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
    "op13_prefix_trie": f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
            [role, text] AS said FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
        o AS (SELECT c, list(said ORDER BY n) AS turns FROM t GROUP BY c),
        r AS (SELECT a.c, CAST({_CRC.replace("CAST(c ", "CAST(a.c ")} AS BIGINT) % 4 AS h, a.turns AS own, coalesce(b.turns, []) AS base
            FROM o AS a LEFT JOIN o AS b ON b.c = a.c - a.c % 20),
        q AS (SELECT c, list_concat(base[1:h], own[h + 1:]) AS turns FROM r),
        p AS (SELECT c, unnest(generate_series(0, len(turns))) AS depth, turns FROM q),
        n AS (SELECT depth, turns[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, list(c) FILTER (len(turns) = depth) AS ends FROM p GROUP BY ALL),
        v AS (SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth][2], '[^{_WS[1:]}+')) END AS saved,
            NOT EXISTS (SELECT 1 FROM n AS m WHERE m.depth = n.depth + 1 AND m.path[1:n.depth] = n.path) AS leaf FROM n),
        u AS (SELECT depth AS below, unnest(generate_series(0, depth)) AS depth, path, saved, leaf FROM v),
        x AS (SELECT depth, path[1:depth] AS path, count(*) FILTER (below = depth + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
        SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
            sha256(coalesce(array_to_string(list_sort(n.ends), ','), '')) AS ends_sha256
        FROM n JOIN x ON x.depth = n.depth AND x.path = n.path LEFT JOIN n AS m ON m.depth = n.depth - 1 AND m.path = n.path[1:n.depth - 1]""",
}
