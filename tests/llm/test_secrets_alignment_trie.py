"""Secret scan, tokenizer alignment and prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from airloom.llm import alignment, prefix_trie, queries, secret_scan
from llm_rows import LONG, ODD, SMALL

# --- secrets ---------------------------------------------------------------------------------------

KEY = "AKIA" + "Q7" * 8
SECRETS = [
    (20, f'password="abc123abc123" then {KEY} and {KEY}'),
    (21, "secret=token:abcdefghijklmnop"),  # the short value uses up the second keyword
    (22, "PassWD : '" + "z" * 12 + "' api_key==" + "y" * 11 + " APIKEY=" + "y" * 11),
    (23, "é🎉 " + "0123456789abcdef" * 2 + " 日本 token = 0123456789abcdef0"),
    (24, f"ghp_{'a' * 36} xoxb-1234567890 AIza{'_' * 35} sk_live_{'x' * 16} eyJabcdefgh.eyJabcdefgh.abcdefgh"),
    (25, "-----BEGIN RSA PRIVATE KEY----- https://me:pass@host/ ftp://x:y@z -----BEGIN PRIVATE KEY-----"),
    (26, "AKIAAKIAAKIA AKIA" + "A" * 13 + " AKIA" + "A" * 14), (27, "a" * 15 + " " + "b" * 16 + "g" + "c" * 17),
    (20, "the same id without any"), (None, KEY), (None, f"{KEY}x"), (28, ("0123456789abcdef " * 700) + KEY),
    (29, "passwdpassword=" + "=" * 12), (30, "Key toKen=abcdefghijkl ſecret=abcdefghijkl"),
]


def brute_spans(text):
    out = []
    for i, rule in enumerate(secret_scan.RULES):
        group, least = rule.least or (0, 0)
        for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.fold else 0)):
            if len(m[group]) >= least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [secret_scan.BROADCAST_IDS, -1])
def test_secrets_equal_a_plain_search(spark, make_docs, monkeypatch, broadcast):
    monkeypatch.setattr(secret_scan, "BROADCAST_IDS", broadcast)
    rng = random.Random(3)
    bits = ["token", "=", "secret", "passwd", "\"", "'", " ", ":", "abcdefabcdef", "0123456789abcdef", KEY, "é", "api_key", "AKIA", "://", "http", "a:b@"]
    docs = ODD + SECRETS + [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 60)))) for i in range(150)]
    frame = make_docs(docs).withColumns({"id": F.lit(1), "body": F.lit(2), "grams": F.lit(3), "at": F.lit(4)})
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.find_secrets(frame).collect()]
    assert Counter((i, tuple(s)) for i, s in got) == Counter((i, tuple(brute_spans(t))) for i, t in docs)


def test_places_of_many_matches_are_summed_in_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    texts = [f"{KEY} " * n for n in range(12)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_trigram_queries():
    query = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert query["hex"] == []  # nothing is certain: scanned whole
    assert query["access"] == [[("AKI", "KIA")]]
    assert ("ken", "oke", "tok") in query["assign"][0] and len(query["pem"]) == 2
    assert secret_scan.trigram_query(secret_scan.Rule("x", "ab|cde")) == []
    assert secret_scan.trigram_query(secret_scan.Rule("x", "(?:abc|xyz)[0-9]+(def)?ghi")) == [[("abc",), ("xyz",)], [("ghi",)]]


def test_only_candidates_are_matched(spark, make_docs):
    """Every text in which a rule matches is a candidate of that rule, and texts without its trigrams are not."""
    query = secret_scan.compiled(secret_scan.RULES)
    docs = make_docs(SECRETS).where("doc_id IS NOT NULL AND doc_id <> 20").withColumnRenamed("doc_id", "id").withColumn("low", F.lower("text"))
    index = docs.select("id", F.explode(secret_scan.grams_in(F.col("text"), F.col("low"), query)).alias("gram"))
    found = {r.id: set(r.rules) for r in secret_scan.candidates(index, query, spark).collect()}
    for id, text in SECRETS:
        if id not in (None, 20):
            assert {k for _, k, _ in brute_spans(text)} - {2} <= found.get(id, set())
    assert 27 not in found


def test_secrets_of_an_empty_table(make_docs):
    assert secret_scan.find_secrets(make_docs([])).count() == 0


# --- alignment -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(queries.BPE_JSON)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=queries.PIECES)


def brute_alignment(tokenizers, docs):
    """Rows of op12 from whole-text encodings."""
    a, b = tokenizers
    alphabet = alignment.byte_alphabet()
    rows, counts = [], Counter()
    for id, text in docs:
        full = " " + (text or "")
        ai, bi = a.encode(full, add_special_tokens=False).ids, b.encode(text or "")
        ab = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
        if not text or b"".join(ab) != full.encode() or b"".join(bb) != full.encode():
            rows.append((id, 0, 0, "", []))
            continue
        ends_a, ends_b = (list(accumulate(map(len, x))) for x in (ab, bb))
        shared = sorted(set(ends_a) & set(ends_b))
        groups = defaultdict(lambda: ([], []))
        for side, (ids, ends) in enumerate(((ai, ends_a), (bi, ends_b))):
            at = 0
            for i, e in zip(ids, ends):
                while shared[at] < e:
                    at += 1
                groups[at][side].append(str(i))
        text_groups = ";".join(",".join(groups[g][0]) + "|" + ",".join(groups[g][1]) for g in range(len(shared)))
        at_a, at_b = dict(zip(ends_a, ai)), dict(zip(ends_b, bi))
        links = [(at_a[e], at_b[e]) for e in shared]
        counts.update(links)
        rows.append((id, len(ai), len(bi), hashlib.sha256(text_groups.encode()).hexdigest(), links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter(
        (id, x, y, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
        for id, x, y, sha, links in rows
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
STRANGE = [(60, "▁x"), (61, "a ▁ b"), (62, "<s> </s><unk><0x0A><|endoftext|>"), (63, " "), (64, "a "), (65, "  a   b  "), (66, "\x00\x01 ﻿​"), (67, "ﬁ ２ \xa0 　"), (68, "x" * 5_000)]


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 20, 0])
def test_alignment_equals_whole_encodings(tokenizers, make_docs, small_docs, head):
    rng = random.Random(5)
    letters = " \n\tabe.,'12éß日🎉▁<|>"
    docs = ODD + STRANGE + small_docs[:60] + [(300 + i, "".join(rng.choices(letters, k=rng.randint(1, 40)))) for i in range(200)]
    found = alignment.align(make_docs(docs), queries.BPE_JSON, queries.PIECES, digest=True)
    out = alignment.with_counts(found, alignment.b_size(queries.PIECES), head).select(*COLUMNS)
    assert Counter(map(tuple, out.collect())) == brute_alignment(tokenizers, docs)


def test_alignment_query(spark, tokenizers, small_docs):
    got = Counter(tuple(r["groups_sha256" if c == "groups" else c] for c in COLUMNS) for r in queries.QUERIES["op12_tokenizer_alignment"](spark, SMALL).collect())
    assert got == brute_alignment(tokenizers, small_docs)


def test_groups_are_written_out(make_docs):
    (row,) = alignment.align(make_docs([(1, "unhappily so")]), queries.BPE_JSON, queries.PIECES).collect()
    groups = [g.split("|") for g in row.groups.split(";")]
    assert sum(len(a.split(",")) for a, _ in groups) == row.n_a and sum(len(b.split(",")) for _, b in groups) == row.n_b
    assert len(groups) == row.n_groups == sum(row.times)


def test_alignment_of_an_empty_table(make_docs):
    found = alignment.align(make_docs([]), queries.BPE_JSON, queries.PIECES)
    assert alignment.with_counts(found, 32_000).count() == 0


# --- prefix trie -----------------------------------------------------------------------------------

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("depth", T.StringType()),
])


def low(x):
    return (x is not None, x)


def brute_trie(sequences):
    """Rows of op13 from {conversation: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves = sum(totals[k][0] for k in kids[path]) if kids[path] else 1
        totals[path] = (leaves, (len(members[path]) - 1) * words + sum(totals[k][1] for k in kids[path]))
    out = Counter()
    for path, convs in members.items():
        ends = sorted((c for c in convs if len(sequences[c]) == len(path)), key=low)
        sha = hashlib.sha256(",".join("null" if c is None else str(c) for c in ends).encode()).hexdigest()
        out[min(convs, key=low), len(path), min(members[path[:-1]], key=low) if path else None, len(convs), len(kids[path]), *totals[path], sha] += 1
    return out


def ordered_turns(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((low(turn), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns)] for c, turns in convs.items()}


def brute_rebuilt(rows):
    convs, out = ordered_turns(rows), {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else convs.get(c - c % 20, [])
        out[c] = base[:h] + own[h:]
    return out


def odd_turns():
    rng = random.Random(11)
    rows = []
    for c in [None, *range(90)]:
        if c == 40:
            continue  # conversations 41 to 59 have no base
        for n in range(rng.choice([1, 1, 2, 3, 4, 5])):
            rows.append((c, rng.choice([None, n, n, n, 0]), rng.choice(["user", "assistant", None]), rng.choice(["one two", "one", "", None, " x\ty\n", "日本 語"])))
    rows += rows[:10] + [(91, 0, "user", LONG), (92, 0, "user", LONG), (93, 0, "user", LONG + "end")]
    return rows


@pytest.mark.parametrize("chunk", [prefix_trie.CHUNK_ROWS, 7])
def test_trie_equals_a_plain_one(spark, chunk):
    rows = odd_turns() + [(94, i, "user", f"w {i % 3}") for i in range(60)] + [(95, i, "user", f"w {i % 3}") for i in range(50)]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], TURNS)
    turns = prefix_trie.numbered(frame, chunk_rows=chunk)
    trie = prefix_trie.prefix_trie(turns, chunk_rows=chunk)
    got = Counter(map(tuple, prefix_trie.with_end_digests(trie).collect()))
    assert got == brute_trie(ordered_turns(rows))


def test_rebuilt_conversations(spark):
    rows = odd_turns()
    turns, ids = queries.rebuilt(spark.createDataFrame([(*r, 5, "x") for r in rows], TURNS))
    want = brute_rebuilt(rows)
    assert any(not t for t in want.values())  # a turnless one ends at the root
    assert {r.conv for r in ids.collect()} == set(want)
    got = Counter(map(tuple, prefix_trie.with_end_digests(prefix_trie.prefix_trie(turns, ids)).collect()))
    assert got == brute_trie(want)


def test_trie_of_an_empty_table(spark):
    turns, ids = queries.rebuilt(spark.createDataFrame([], TURNS))
    trie = prefix_trie.prefix_trie(turns, ids)
    assert prefix_trie.with_end_digests(trie).count() == 0 and trie.ends.count() == 0
