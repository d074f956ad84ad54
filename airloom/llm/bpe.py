"""Byte-level BPE: exact encoding by longest matches and backtracking, and decoding.

A list of tokens is the BPE result of its bytes exactly if every two neighbours are the BPE result
of theirs. So the encoder takes the longest vocabulary match at each place, goes back to shorter
ones when two neighbours do not fit, and never enters a place twice from which it had to go back:
time is linear in the piece. Matches come from one pass of an Aho-Corasick automaton over the bytes
mapped to Latin-1.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from airloom.llm.frames import texts_of, with_columns
from airloom.llm.segments import ROWS, Memo, coded

#: Pieces and pairs of tokens that a Python worker remembers.
MEMO = 50_000


#: Both spellings of the pattern for which ``segments`` knows where a new match begins.
_REST = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GPT2_PATTERNS = ("'s|'t|'re|'ve|'m|'ll|'d|" + _REST, "'(?:[sdmt]|ll|ve|re)|" + _REST)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """One vocabulary: ids of pieces, bytes of ids."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.cuts = pattern in GPT2_PATTERNS
        self.rank = {t: i for i, t in enumerate(tokens)}
        automaton = ahocorasick.Automaton()
        halves = [self._merged(t, 2) if len(t) > 1 else [t] for t in tokens]  # what the last merge joins
        reached = [len(t) == 1 or len(h) == 2 for t, h in zip(tokens, halves, strict=True)]
        self.parts = [tuple(self.rank[x] for x in h) if r and len(h) == 2 else None for h, r in zip(halves, reached, strict=True)]
        self.in_order = all(p is None or max(map(self._time, p)) < i for i, p in enumerate(self.parts))
        for i, token in enumerate(tokens):
            if reached[i] and len(token) > 1:  # others only ever stand for a whole piece
                automaton.add_word(token.decode("latin-1"), i)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.shorter = [self._prefix(t, reached) for t in tokens]
        self.size = [len(t) for t in tokens]
        self.byte = [self.rank.get(bytes([b]), -1) for b in range(256)]
        self.fits: dict[int, bool] = {}
        self.pieces = Memo(lambda pieces: [pack(f"<{len(ids := self.piece(p))}I", *ids) for p in pieces], MEMO)
        self.segments = Memo(self._segments, MEMO)

    def _prefix(self, token: bytes, reached: list[bool]) -> int:
        """The longest shorter token that this one begins with, or -1."""
        for end in range(len(token) - 1, 0, -1):
            i = self.rank.get(token[:end], -1)
            if i >= 0 and reached[i]:
                return i
        return -1

    def _time(self, token: int) -> int:
        return token if len(self.tokens[token]) > 1 else -1

    def _merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank first, down to ``least`` parts; only for the vocabulary."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > least:
            ranks = [rank.get(a + b, len(rank)) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are side by side, remembered for each pair."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            if self.in_order:
                known = self._fit(a, b)
            else:
                left, right = self.tokens[a], self.tokens[b]
                known = self._merged(left + right) == [left, right]
            if len(self.fits) >= MEMO:
                self.fits.clear()
            self.fits[a << 32 | b] = known
        return known

    def _fit(self, a: int, b: int) -> bool:
        """Undo both tokens' merges from the last to the first, and look whether at any time a merge
        across the border had come before the merge that used up either side (left first on ties)."""
        tokens, rank, parts = self.tokens, self.rank, self.parts
        left_used = right_used = len(tokens)
        while True:
            across = rank.get(tokens[a] + tokens[b])
            if across is not None and across < left_used and across <= right_used:
                return False
            if parts[a] is None and parts[b] is None:
                return True
            if parts[b] is None or parts[a] is not None and a > b:
                left_used, a = a, parts[a][1]
            else:
                right_used, b = b, parts[b][0]

    def piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern."""
        data = text.encode()
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        size, shorter, fits, n = self.size, self.shorter, self.fits, len(data)
        longest = [*map(self.byte.__getitem__, data)]
        for end, token in self.matches(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends grow, so the longest comes last
        dead, out, before = bytearray(n + 1), [], -1
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                to = at + size[token]
                if not dead[to]:
                    good = before < 0 or fits.get(before << 32 | token)
                    if good or good is None and self.fit(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if to == n:
                    return out
                before, at, token = token, to, longest[to]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token, before = shorter[token], out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def _segments(self, parts: list[str]) -> list[bytes]:
        """Ids of texts: each match of the pattern by itself."""
        matches = [self.split(p) for p in parts]
        different = list(dict.fromkeys(chain.from_iterable(matches)))
        ids = dict(zip(different, self.pieces(different), strict=True))
        return [ids[m[0]] if len(m) == 1 else b"".join([ids[x] for x in m]) for m in matches]

    def encode(self, texts: pa.Array) -> tuple[pa.Array, list[int]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and their bytes.

        Texts are cut into segments for the one pattern whose matches begin at the cuts; others see
        whole texts.
        """
        if self.cuts:
            return coded(texts, self.segments)
        codes = self._segments(texts.to_pylist())
        return pa.array(codes, pa.binary()), [len(c) for c in codes]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, built once in each Python worker."""
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """What each id stands for; decoding needs nothing else."""
    return read_ranks(path)


def decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens and the ids of each text (binary, little-endian unsigned 32-bit).

    Each match of ``pattern`` is encoded by itself; no string is a special token. A null text is
    read as empty and has no ids. Columns of these names in the input are replaced. The rank file
    must be readable at ``path`` on every executor.
    """
    at = docs.columns.index(text)

    def make():
        coder = encoder(path, pattern)

        def compute(batch):
            ids, sizes = coder.encode(texts_of(batch, at))
            return [ids, [n // 4 for n in sizes]]

        return compute

    return with_columns(docs, make, [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())], keep, ROWS)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``coded`` with the bytes of each list of ids; null ids are read as none."""
    at = coded.columns.index(ids)

    def make():
        tokens = token_bytes(path)

        def compute(batch):
            return [pa.array([decoded(c or b"", tokens) for c in batch.column(at).to_pylist()], pa.binary())]

        return compute

    return with_columns(coded, make, [T.StructField(out, T.BinaryType())], keep)
