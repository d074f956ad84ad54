import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from airloom.llm import chat, decontaminate, licenses, line_dedup, quality, queries, simhash, url_filter
from llm_rows import ODD, SMALL

LINE = "This very line is found in a number of documents"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def repeats():
    """A line in 4, 5 and 9 documents, other case and spaces, below the limit, twice in a document."""
    docs = [(i, f"head {i}\n  {LINE.upper()}\t\nmiddle\n{LINE} five\n{LINE} five\nend") for i in range(5)]
    docs += [(10 + i, f"{LINE} four\nshort\n\n") for i in range(4)] + [(20 + i, LINE) for i in range(4)]
    docs += [(20, "again 20"), (None, f"{LINE} five"), (None, f"{LINE} four")]
    docs += [(30 + i, "é" * 39 + "\n" + "é" * 40 + "\n" + "x" * 39) for i in range(6)]
    return docs + ODD


@pytest.mark.parametrize("rows", [repeats(), [], [(1, None)]])
def test_line_dedup(spark, make_docs, rows):
    docs = make_docs(rows).withColumns({"n_lines": F.lit("x"), "lost_id": F.lit("y"), "lost_lines": F.lit("z")})
    got = rows_of(line_dedup.drop_repeated_lines(docs), "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(brute.line_dedup(rows), key=repr)


def test_line_dedup_full_filter_gives_the_same(spark, make_docs, monkeypatch):
    """A filter of one block suspects every line: the exact count still decides."""
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1)
    rows = repeats()
    got = rows_of(line_dedup.drop_repeated_lines(make_docs(rows)), "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(brute.line_dedup(rows), key=repr)


@pytest.mark.parametrize("frequent", [0, line_dedup.FREQUENT_LINES])
def test_line_dedup_ranges_and_both_ways_to_the_texts(make_docs, monkeypatch, frequent):
    """A filter in several ranges of hashes; repeated lines sent to all tasks, or lost lines joined."""
    monkeypatch.setattr(line_dedup, "MAX_BITS", line_dedup.BLOCK_BITS)
    monkeypatch.setattr(line_dedup, "FREQUENT_LINES", frequent)
    rand = random.Random(3)
    shared = [f"shared line number {n} " + "x" * 40 for n in range(300)]
    rows = [(i, "\n".join([*rand.choices(shared, k=20), f"only in document {i} " + "y" * 1_500])) for i in range(800)]
    rows += [*ODD, *repeats()]
    assert len(line_dedup.filter_ranges(sum(len((t or "").encode()) for _, t in rows))) == 8
    got = rows_of(line_dedup.drop_repeated_lines(make_docs(rows)), "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(brute.line_dedup(rows), key=repr)


def test_line_dedup_shuffles_no_texts(make_docs):
    plan = line_dedup.drop_repeated_lines(make_docs(repeats()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_line_dedup_holders_tell_halves_apart():
    digests = [bytes([1] * 8 + [n] * 8) for n in (3, 1, 2)] + [bytes([9] * 16)]
    held = line_dedup.Holders(pa.table({"line": digests, "holder": [30, 10, 20, 90]}))
    found = held.find([digests[2], bytes([1] * 8 + [7] * 8), digests[0], digests[3], bytes(16)])
    assert [int(held.ids[p]) if p >= 0 else None for p in found] == [20, None, 30, 90, None]


def test_line_dedup_registered(spark, small_docs):
    got = rows_of(queries.line_repeats(spark, SMALL), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(((i, n, d, brute.sha(k)) for i, n, d, k in brute.line_dedup(small_docs)), key=repr)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, make_docs, small_docs):
    rand = random.Random(7)
    rows = ODD + [(100 + i, " ".join(rand.choices("ab", k=rand.randint(0, 30))) + "\n#a|\n#a|\n \n ") for i in range(60)]
    got = rows_of(quality.judge(make_docs(rows)), "doc_id", *COUNTS)
    assert got == sorted(((i, *brute.quality(t)) for i, t in rows), key=repr)
    got = rows_of(queries.quality_rules(spark, SMALL), "doc_id", *COUNTS)
    assert got == sorted(((i, *brute.quality(t)) for i, t in small_docs), key=repr)
    assert quality.judge(make_docs([])).count() == 0


def prose(seed, n):
    rand = random.Random(seed)
    return " ".join("".join(rand.choices("aeioubcdfg", k=5)) for _ in range(n))


def test_quality_boilerplate(spark, make_docs):
    menu = "\n".join(f"menu entry {i} {prose(1_000 + i, 5)}" for i in range(8))
    rows = [(i, f"{menu}\n{prose(i, 12)}", "hot") for i in range(40)]  # depleted: nearly all menu
    rows += [(100 + i, f" MENU  entry 1 {prose(1_001, 5)}\n{prose(100 + i, 90)}", "hot") for i in range(40)]
    rows += [(200 + i, f"{menu}\n{prose(i, 12)}", f"rare{i}") for i in range(5)] + [(300, f"{menu}\n{prose(5, 12)}", None)]
    judged = {r.doc_id: r for r in quality.judge(make_docs(rows)).collect()}
    assert [i for i in range(40) if judged[i].kept] == [0]  # the smallest id keeps the lines
    assert all(judged[i].kept for i, *_ in rows if i >= 100)
    assert judged[100].n_boilerplate == 1 and judged[200].n_boilerplate == 0
    kept = {r.doc_id: r.text for r in quality.keep_good(make_docs(rows).withColumns({"rejected": F.lit(1), "hashes": F.lit(2)})).collect()}
    assert set(kept) == {i for i, r in judged.items() if r.kept}
    assert kept[0] == rows[0][1] and kept[100] == prose(100, 90) and kept[300] == rows[-1][1]
    cleaned = {r.doc_id: r.text for r in quality.without_boilerplate(make_docs(rows)).collect()}
    assert cleaned[3] == prose(3, 12) and cleaned[0] == rows[0][1] and cleaned[300] == rows[-1][1]


@pytest.mark.parametrize("broadcast", [quality.BROADCAST_ROWS, -1])
def test_quality_lines_count_by_documents_whatever_the_size_of_the_host(make_docs, monkeypatch, broadcast):
    """21 documents make a line boilerplate, 20 do not, also where they are one in a hundred of a host."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    rows = [(i, f"{prose(i, 12)}", "hot") for i in range(2_000)]
    rows += [(3_000 + i, f"Seen in twenty one\n{prose(3_000 + i, 40)}\nSeen in twenty one", "hot") for i in range(21)]
    rows += [(4_000 + i, f"Seen in twenty\n{prose(4_000 + i, 40)}", "hot") for i in range(20)]
    rows += [(4_000, f"Seen in twenty\n{prose(1, 40)}", "hot"), (5_000, None, "hot"), (5_001, f"seen  in TWENTY one\n{prose(2, 40)}", "cold")]
    judged = [(r.doc_id, r.n_boilerplate) for r in quality.judge(make_docs(rows)).collect() if r.n_boilerplate]
    assert sorted(judged) == [(3_000 + i, 2) for i in range(1, 21)]
    texts = {(r.doc_id, r.text) for r in quality.keep_good(make_docs(rows)).collect()}
    assert texts == {(i, prose(i, 40) if 3_000 < i < 3_100 else t) for i, t, _ in rows if i != 5_000}


def expected_components(rows):
    prints = [(n, brute.simhash(t)) for n, (_, t) in enumerate(rows)]
    found, low = brute.components(prints), {}
    for n, (id, _) in enumerate(rows):
        ids = [x for x in (low.get(found[n]), id) if x is not None]
        low[found[n]] = min(ids, default=None)
    return sorted(((id, f"{prints[n][1]:016x}", low[found[n]]) for n, (id, _) in enumerate(rows)), key=repr)


def test_simhash_on_odd_rows_and_near_copies(spark, make_docs):
    base = prose(1, 400).split()
    rows = list(ODD)
    for i in range(40):
        words = list(base)
        words[i * 9 % 400] = "changed"
        words[i * 31 % 400] = "again"
        rows.append((50 + i, " ".join(words)))
    rows += [(200 + i, prose(i, 30)) for i in range(30)]
    got = rows_of(simhash.near_duplicates(make_docs(rows)), "doc_id", "fingerprint", "component_id")
    assert got == expected_components(rows)
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_simhash_chains_and_full_shards(spark, monkeypatch):
    """Chains of links with random and with nearly equal fingerprints, also when shards are dealt again."""
    rand, prints = random.Random(11), []
    for _ in range(12):
        value = rand.getrandbits(64)
        for _ in range(rand.randint(1, 12)):
            prints.append(value)
            for bit in rand.sample(range(64), rand.randint(1, 4)):
                value ^= 1 << bit
    core = rand.getrandbits(64)
    prints += [core ^ sum(1 << b for b in rand.sample(range(32), rand.randint(0, 6))) for _ in range(120)]
    nodes = list(dict(enumerate(dict.fromkeys(prints))).items())
    signed = [(i, v - 2**64 if v >> 63 else v) for i, v in nodes]
    df = spark.createDataFrame(signed, "node long, fingerprint long")
    want = brute.components(nodes)
    for most in (4_000, 5):
        monkeypatch.setattr(simhash, "SHARD_ROWS", most)
        got = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
        assert {i: got.get(i, i) for i, _ in nodes} == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b").unionAll(spark.range(300, 310).selectExpr("300L AS a", "id AS b"))
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {i: 300 for i in range(301, 310)}


def test_simhash_registered_and_one_of_each_stays(spark, small_docs, make_docs):
    got = rows_of(queries.simhash_groups(spark, SMALL), "doc_id", "fingerprint", "component_id")
    assert got == expected_components(small_docs)
    kept = simhash.keep_one(make_docs([*small_docs, (None, "only null"), small_docs[0]]).withColumn("kept", F.lit(1)))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(set(ids) - {None}) == sorted({c for _, _, c in got}) and None in ids


ITEM = "the quick brown foxes jump over many lazy dogs near the old river bank while it rains"


def test_decontamination(spark, make_docs):
    rand = random.Random(2)
    items = [(1, ITEM), (2, "Eight  short\nchars"), (3, None), (4, ""), (None, "an item without an id, not a short one"), (1, "second text of id one, long enough to find")]
    rows = list(ODD)
    for n in range(80):
        text = list(ITEM if n % 4 else items[5][1])
        for _ in range(n % 8):
            at = rand.randrange(len(text))
            text[at : at + rand.randint(0, 1)] = rand.choice(["x", "", "yz"])
        rows.append((100 + n, f"{prose(n, 20)} {''.join(text).upper()}\n\n{prose(n + 1, 20)}"))
    rows += [(300, "eight short   CHARS"), (301, "an item without an id, not a short one"), (302, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for id, text in rows:
        clean = decontaminate.normalised(text or "")
        if len(clean) > 1_000:
            continue
        for item, body in items:
            body = decontaminate.normalised(body or "")
            if body and clean:
                d = brute.edit_distance(body, clean)
                if d <= len(body) // decontaminate.CHARS_PER_ERROR:
                    want.append((id, item, d))
    docs = make_docs(rows).withColumns({"hits": F.lit(1), "hits_0": F.lit(2)})
    got = decontaminate.contaminations(docs, table)
    assert rows_of(got, "doc_id", "item_id", "distance") == sorted(want, key=repr)
    kept = decontaminate.drop_contaminated(docs, table)
    hit = {i for i, _, _ in want}
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in rows if i not in hit)


def test_decontamination_in_several_passes_and_empty(spark, make_docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = rows_of(decontaminate.contaminations(docs, items), "doc_id", "item_id", "distance")
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3_000)
    assert rows_of(decontaminate.contaminations(docs, items), "doc_id", "item_id", "distance") == whole and whole
    assert decontaminate.contaminations(make_docs([]), items).count() == 0
    assert decontaminate.contaminations(docs, items.limit(0)).count() == 0


def test_decontamination_registered(spark, small_docs):
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    exact = {(i, n) for i, t in small_docs for n, body in items if body in decontaminate.normalised(t)}
    got = {(i, n): d for i, n, d in rows_of(queries.benchmark_leaks(spark, SMALL), "doc_id", "item_id", "distance")}
    assert exact == {k for k, d in got.items() if d == 0} and exact


def shingled(text, size):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def licenses_by_hand(rows, texts):
    """All places of all templates' shingles, from the words themselves."""
    out = set()
    for n, (name, text) in enumerate(texts):
        size = min(5, len(shingled(text, 1)))
        parts = set(shingled(text, size))
        for id, body in rows:
            found = shingled(body, size)
            for at, part in enumerate(found):
                if part in parts:
                    around = found[max(at - len(parts) + 1, 0) : at + len(parts) + 1]
                    if len(parts & set(around)) / len(parts) >= licenses.CONTAINED:
                        out.add((id, name, n))
    return sorted(out, key=repr)


def test_licenses(spark, make_docs):
    rows = list(ODD)
    for n, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.upper().split()
        rows += [(100 + n, f"{prose(n, 30)}\n{text}\n{prose(n + 1, 30)}"), (200 + n, text), (300 + n, " ".join(words[: len(words) // 2]))]
        words[len(words) // 2] = "other"
        rows += [(400 + n, " ".join(words)), (None, f"{text} {text}")]
    docs = make_docs(rows).withColumns({"hashes": F.lit(1), "template": F.lit(2)})
    got = rows_of(licenses.license_notices(docs), "doc_id", "license", "template")
    assert got == licenses_by_hand(rows, licenses.TEMPLATES)
    assert {(200 + n, name, n) for n, (name, _) in enumerate(licenses.TEMPLATES)} <= set(got)
    assert licenses.license_notices(make_docs([])).count() == 0
    assert all(licenses.found_at_least(n) > 0.999 for n in (1, 2, 5, 50))
    with pytest.raises(ValueError):
        licenses.templates(spark, [])


def test_licenses_in_slices(make_docs, monkeypatch):
    """A long list is scanned for in parts, by number and by words, with the same result."""
    rows = [(n, f"{prose(n, 20)} {text}") for n, (_, text) in enumerate(licenses.TEMPLATES)]
    monkeypatch.setattr(licenses, "SLICE_TEMPLATES", 17)
    monkeypatch.setattr(licenses, "SLICE_WORDS", 300)
    assert len(list(licenses._slices(licenses.TEMPLATES))) > 2
    got = rows_of(licenses.license_notices(make_docs(rows)), "doc_id", "license", "template")
    assert got == licenses_by_hand(rows, licenses.TEMPLATES)


def test_licenses_registered(spark, small_docs):
    got = rows_of(queries.license_scan(spark, SMALL), "doc_id", "license", "template")
    assert got == licenses_by_hand(small_docs, licenses.TEMPLATES) and got


def test_licenses_short(spark, make_docs, small_docs):
    """Templates of one to four words, by plain string search in the words."""
    texts = (("A", "All rights reserved."), ("B", "Copyleft"), ("C", "(c) 2024"), ("D", "use at own risk"), ("E", "All rights not reserved."), *licenses.TEMPLATES[:3])
    rows = list(ODD)
    for n, (_, text) in enumerate(texts):
        words = text.split()
        rows += [(100 + n, f"{prose(n, 30)}\n{text}\n{prose(n + 1, 30)}"), (200 + n, f"{prose(n, 3)} {text.upper()}"), (300 + n, text), (None, text)]
        rows += [(400 + n, f"{prose(n, 9)} {words[0]}x {' '.join(words[1:])}"), (500 + n, " ".join(words[1:]) + f" {prose(n, 9)}")]
    rows += [(600, "all rights\nare reserved"), (601, "rights reserved all rights"), (602, "all\n\nrights -- RESERVED! " * 3), *small_docs]
    plain = [(i, f" {' '.join(re.findall(r'[0-9a-z\x80-\U0010ffff]+', (t or '').lower()))} ") for i, t in rows]
    short = [(n, name, " ".join(re.findall("[0-9a-z]+", text.lower()))) for n, (name, text) in enumerate(texts[:5])]
    want = {(i, name, n) for i, t in plain for n, name, words in short if f" {words} " in t}
    got = rows_of(licenses.license_notices(make_docs(rows), texts=texts), "doc_id", "license", "template")
    assert [x for x in got if x[2] < 5] == sorted(want, key=repr)
    alone = rows_of(licenses.license_notices(make_docs(rows), texts=texts[:5]), "doc_id", "license", "template")
    assert alone == sorted(want, key=repr)
    found = {r.doc_id for r in queries.license_scan(spark, SMALL).where("license = 'All-Rights-Reserved'").collect()}
    assert found == {i for i, t in small_docs if "All rights reserved." in (t or "")} and found


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.NET/x", "http://knet/", "ftp://example.net/en/?q", "http://example.net/en",
    "http://x.example.net/EN/", "http://example.net/en/#t", "http://anet.example.com/de/1?a=://b.net/", "http://example.com/de", "http://org/fr/", "http://org/net/fr/",
    "http://a.org?fr/", "http://.net/", "http://é.net/é", "http://u@a.org:80/fr/", "http://a.b.net#/x", "x://y://z.net/", "http://a.net/?/en/", "http://" + "a." * 5_000 + "net/" + "p" * 5_000,
]


def test_urls(spark):
    rand = random.Random(9)
    urls = URLS + ["http://" + "".join(rand.choices(["net", "org", "example", ".", "com", "/", "en", "fr", "de", "?", "#", "E"], k=rand.randint(1, 9))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(7))
    got = rows_of(url_filter.judge_urls(df), "page_id", "host", "path", "rule", "verdict")
    rules = [(r.verdict, r.name) for r in url_filter.RULES]
    assert got == sorted(((n, *brute.url(u, rules)) for n, u in enumerate(urls)), key=repr)
    many = tuple(url_filter.Rule(rand.choice(["allow", "block"]), f"h{i}.example.net/p{i}/") for i in range(50))  # many words of states
    urls = [f"http://a.h{i}.example.net/p{j}/x" for i in range(50) for j in (i, i + 1)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows_of(url_filter.judge_urls(df, rules=many), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((n, *brute.url(u, [(r.verdict, r.name) for r in many])) for n, u in enumerate(urls)), key=repr)
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, rules=()).collect()} == {"allow"}


def test_globs():
    globs = url_filter.Globs([b"a*c", b"a**c", b"a?c", b"**", b"", rb"\*x", b"*b"])
    texts = [b"ac", b"abc", b"a/c", b"abbc", b"", b"*x", b"xx", b"b", b"a/b"]
    want = [[1, 1, 0, 1, 0, 0, 0], [1, 1, 1, 1, 0, 0, 0], [0, 1, 1, 1, 0, 0, 0], [1, 1, 0, 1, 0, 0, 0], [0, 0, 0, 1, 1, 0, 0],
            [0, 0, 0, 1, 0, 1, 0], [0, 0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0, 1], [0, 0, 0, 1, 0, 0, 0]]
    assert globs.match(texts).astype(int).tolist() == want


def test_chat(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\nok \\<| \\\\ <\\| é🎉"
    turns = [(1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (2, 0, "assistant", "x"), (3, None, "user", "b"), (3, None, "user", "a"),
             (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 1, "assistant", "yo"), (None, 5, None, "<|"), (5, 0, "us\ner<|", ""), (6, 0, "user", "q"), (6, 1, "assistant", "w " * 50_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).repartition(3)
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "valid", chat.parsed(F.col("segments")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), chat.formatted(F.col("segments")).alias("text")).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t or -1, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert [tuple(t) for t in got[conv].turns] == [(r, x) for _, r, x in mine]
        assert got[conv].loss == "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].text.count("<|im_start|>") == got[conv].text.count("<|im_end|>") == len(mine)
    assert {c for c, r in got.items() if r.valid} == {1, 6}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_is_read_back_from_the_formatted_text(spark):
    """Texts and roles that look like marks, escapes and line feeds; no two conversations read alike."""
    rand = random.Random(9)
    bits = ["<", "|", "\\", "\n", "im_end", "im_start", ">", "<|im_end|>", "<|im_start|>", "assistant", "é🎉", " ", "x"]
    some = [("us\ner", "x"), ("us", "er\nx"), ("us\\", "\ner\nx"), ("", ""), ("user", "w <" * 20_000)]
    some += [("".join(rand.choices(bits, k=rand.randint(0, 4))), "".join(rand.choices(bits, k=rand.randint(0, 8)))) for _ in range(300)]
    turns = [(i, 0, *t) for i, t in enumerate(some)] + [(9_999, i, *t) for i, t in enumerate(some)]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = out.select("conv_id", chat.formatted(F.col("segments")).alias("text")).select("*", chat.read_back(F.col("text")).alias("turns"))
    got = {r.conv_id: (r.text, [tuple(t) for t in r.turns]) for r in out.collect()}
    assert got[9_999][1] == some and all(got[i][1] == [t] for i, t in enumerate(some))
    assert len({got[i][0] for i in range(len(some))}) == len(set(some))


def test_chat_registered(spark):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    turns += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: r for r in queries.chat_format(spark, SMALL).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, row in got.items():
        mine = sorted(t[1:] for t in turns if t[0] == conv)
        loss = "".join(x or "" for _, r, x in mine if r == "assistant")
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(mine), len(loss), brute.sha(loss))
        assert row.turns_sha256 == brute.sha("".join(f"{r}\n{x or ''}\n" for _, r, x in mine))


def test_pipeline(spark, small_docs):
    """Each stage beside its brute force, on the stage's own input."""
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in frame.collect()]
        frame = spark.createDataFrame(stage(spark, frame, SMALL).toPandas())
        after = {r.doc_id: r for r in frame.collect()}
        if name == "quality_rules":
            assert set(after) == {i for i, t in before if not brute.quality(t)[-1]}
        if name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == {i: k for i, _, _, k in brute.line_dedup(before)}
        if name == "simhash_near_dedup":
            assert set(after) == set(brute.components([(i, brute.simhash(t)) for i, t in before]).values())
        if name == "decontamination":
            for i, text in before:
                clean = decontaminate.normalised(text)
                held = any(body in clean for _, body in items)
                assert not (held and i in after)
        if name == "byte_bpe":
            assert set(after) == {i for i, _ in before} and all(r.round_trip for r in after.values())
        else:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    run = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id: bytes(r.ids) for r in run.collect()} == {i: bytes(r.ids) for i, r in after.items()}


def test_pipeline_on_odd_documents(spark, make_docs):
    frame = make_docs([*ODD, *repeats()])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SMALL)
    assert all(r.round_trip for r in frame.collect())
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
