import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import brute
from airloom.llm import bpe, queries, token_counts, token_files
from airloom.session import scratch
from llm_rows import ODD, SMALL

ALPHABET = ["a", "b", "é", "日", "본", " ", "\n", "1", "'s", "'", "\x1c", "\x85", "the", "ing", "🎉", "ا", "\t", "  ", "-", "<|endoftext|>", "\0", "▁"]


def noise(n, seed):
    rand = random.Random(seed)
    return ["".join(rand.choices(ALPHABET, k=rand.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    with open(queries.BPE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_bpe_equals_the_library_on_noise_and_on_every_letter(library):
    coder = bpe.encoder(queries.BPE_RANKS, public_tokenizers.PATTERN)
    letters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))
    texts = [*noise(3_000, 1), *[" ".join(letters[i : i + 500]) for i in range(0, len(letters), 500)], "ab" * 50_000]
    coded, sizes = coder.encode(pa.array(texts))
    for text, data, size in zip(texts, coded.to_pylist(), sizes, strict=True):
        assert ids_of(data) == library.encode_ordinary(text)
        assert size == len(data) and bpe.decoded(data, coder.tokens) == text.encode()


@pytest.mark.parametrize("pattern", [r" ?[^\s\p{L}\p{N}]++[\r\n]*+|\p{L}+|\s+|\p{N}", r"[\s\S]+", *bpe.GPT2_PATTERNS])
def test_bpe_of_any_pattern(library, pattern):
    """Matches that go on over a space or line feed are not cut there."""
    assert public_tokenizers.PATTERN in bpe.GPT2_PATTERNS
    tokens = [*(bytes([b]) for b in range(256)), b";\n", b"a b", b"the", b" t"]
    plain = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coder, texts = bpe.Encoder(tokens, pattern), ["a;\nb", "a b a b", "", "the;\n t the", *noise(300, 5)]
    coded, sizes = coder.encode(pa.array(texts))
    assert [ids_of(c) for c in coded.to_pylist()] == [plain.encode_ordinary(t) for t in texts]
    assert sizes == [len(c) for c in coded.to_pylist()]


def test_bpe_without_rank_order_still_equals_the_merges():
    """Ranks below those of their parts: fit() must then go by the merges."""
    tokens = [bytes([b]) for b in range(256)] + [b"abcd", b"cd", b"ab", b"bc", b"dab", b"cda"]
    coder, plain = bpe.Encoder(tokens, r"[\s\S]+"), None
    assert not coder.in_order
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rand = random.Random(3)
    for _ in range(2_000):
        plain = "".join(rand.choices("abcd", k=rand.randint(1, 14)))
        assert coder.piece(plain) == library.encode_ordinary(plain)


def test_bpe_query_on_odd_rows_and_clashing_columns(spark, make_docs, library):
    docs = make_docs(ODD).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    coded = bpe.encode(docs, queries.BPE_RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(coded, queries.BPE_RANKS).collect()
    assert len(got) == len(ODD)
    for row in got:
        assert ids_of(row.ids) == library.encode_ordinary(row.text or "")
        assert row.n_tokens == len(row.ids) // 4 and row.decoded == (row.text or "").encode()
    assert bpe.encode(make_docs([]), queries.BPE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_registered(spark, small_docs, library):
    got = {r.doc_id: r for r in queries.byte_bpe(spark, SMALL).collect()}
    for id, text in small_docs:
        ids = library.encode_ordinary(text)
        assert got[id].n_tokens == len(ids)
        assert got[id].ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes())
        assert got[id].decoded_sha256 == brute.sha(text)


def expected_files(docs):
    tokenizer, start, out = Tokenizer.from_file(queries.BPE_JSON), 0, []
    for id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((id, start, len(ids), brute.crc(ids)))
        start += len(ids)
    return out


def test_token_files_registered(spark, small_docs):
    rows = queries.token_output(spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == expected_files(sorted(small_docs))


def test_token_segments_equal_the_library():
    coder, texts = token_files._library(queries.BPE_JSON), noise(4_000, 2)
    coded, _ = coder.encode(pa.array(texts))
    want = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids_of(x) for x in coded.to_pylist()] == [e.ids for e in want]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_odd_rows_and_selective_reads(spark, make_docs, encoding):
    target = scratch(spark, "tokens")
    token_files.write_tokens(make_docs(ODD).withColumn("part", F.lit(1)), target, queries.BPE_JSON, encoding=encoding)
    whole = token_files.read_tokens(spark, target).collect()
    assert len(whole) == len(ODD)
    ends = sorted((r.start, r.start + r.n_tokens) for r in whole)
    assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]
    assert [r.doc_id for r in sorted(whole, key=lambda r: r.start)] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    some = token_files.read_tokens(spark, target, F.col("doc_id") == 10)
    assert [r.ids for r in some.collect()] == [r.ids for r in whole if r.doc_id == 10]
    metadata = token_files.read_metadata(spark, target)
    assert "ids" not in metadata._jdf.queryExecution().executedPlan().toString()
    assert metadata.count() == len(ODD)
    with pytest.raises(ValueError):
        token_files.write_tokens(make_docs(ODD), target, queries.BPE_JSON, encoding="none")


def test_token_files_empty_table(spark, make_docs):
    target = scratch(spark, "tokens")
    token_files.write_tokens(make_docs([]), target, queries.BPE_JSON)
    assert token_files.token_checks(spark, target).count() == 0


def unigram(vocabulary, unknown=0):
    model = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return model


def test_token_counts_equal_the_library(spark, make_docs, small_docs):
    vocabulary = token_counts.read_vocabulary(queries.UNIGRAM)
    model, counter = unigram(vocabulary), token_counts.counter(queries.UNIGRAM)
    texts = [*noise(1_500, 4), *[t for _, t in small_docs[:60]], *[t or "" for _, t in ODD if not t or len(t) < 1_000]]
    assert counter.count(texts) == [len(model.encode(t).ids) for t in texts]
    got = token_counts.count_tokens(make_docs(ODD).withColumn("n_tokens", F.lit("x")), queries.UNIGRAM).collect()
    assert [r.n_tokens for r in got] == counter.count([t or "" for _, t in ODD])
    assert token_counts.count_tokens(make_docs([]), queries.UNIGRAM).count() == 0
    assert queries.unigram_counts(spark, SMALL).count() == len(small_docs)


def test_token_counts_ties():
    """Equal scores all over: only the tie rule decides, also against unknown characters."""
    bytes_ = [(f"<0x{b:02X}>", -5.0) for b in range(256)]
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "bab", "▁a", "▁ab", "aa", "cc", "ac"]
    vocabulary = [("<unk>", 0.0), *bytes_, *[(p, -float(len(p))) for p in pieces]]
    model, counter, rand = unigram(vocabulary), token_counts.Counter(vocabulary), random.Random(5)
    texts = ["".join(rand.choices("aabbc é", k=rand.randint(0, 12))) for _ in range(3_000)]
    assert counter.count(texts) == [len(model.encode(t).ids) for t in texts]
