"""Allow and block rules for URLs as globs, all matched at once by a bit-parallel automaton.

Each glob is a row of states: one before its first character and one after each. States of all
globs lie side by side in 64-bit words. A character moves every state on (shift, then AND with the
places where it fits) and keeps the states whose wildcard takes it: the Shift-And rule over as many
words as the globs need, for all URLs of a batch together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from airloom.llm.frames import utf8, with_columns

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and a path prefix, named like ``example.net/en/``."""

    verdict: str
    name: str

    def glob(self) -> bytes:
        host, slash, path = self.name.partition("/")
        plain = re.sub(r"([*?\\])", r"\\\1", f".{host}{slash}{path}")
        return b"*" + plain.encode() + b"**"


RULES = (Rule(BLOCK, "net/"), Rule(ALLOW, "example.net/en/"), Rule(BLOCK, "example.com/de/"), Rule(ALLOW, "org/fr/"))


def canonical(url: bytes | None) -> tuple[bytes, bytes]:
    """(host, path): the host after the first ``://`` with A-Z lower-cased, the path up to ``?`` or ``#``."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    host = re.match(rb"[^/?#]*", rest)[0]
    return host.lower(), re.match(rb"[^?#]*", rest[len(host) :])[0]


class Globs:
    """Globs over bytes: ``?`` is any byte, ``*`` any run without ``/``, ``**`` any run, ``\\`` quotes."""

    def __init__(self, globs: list[bytes]):
        places: list[tuple[int | None, int]] = []  # (byte or None for any, state before it)
        loops: list[tuple[bool, int]] = []  # (also over "/", state)
        starts, ends, state = [], [], 0
        for glob in globs:
            starts.append(state)
            for token in re.findall(rb"\*\*|\*|\?|\\.|.", glob, re.S):
                if token in (b"*", b"**"):
                    loops.append((token == b"**", state))
                    continue
                places.append((None if token == b"?" else token[-1], state))
                state += 1
            ends.append(state)
            state += 1
        self.words = state // 64 + 1
        self.first = self._mask(starts)
        self.steps = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        for byte, at in places:
            self.steps[slice(None) if byte is None else byte] |= self._mask([at + 1])
        for slash, at in loops:
            keep = self.loops[ord("/")].copy()
            self.loops[:] |= self._mask([at])
            if not slash:
                self.loops[ord("/")] = keep
        self.ends = [(end // 64, np.uint64(1) << np.uint64(end % 64)) for end in ends]

    def _mask(self, states: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for s in states:
            mask[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        return mask

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text and glob, whether the glob matches the whole text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")  # at each step the texts that go on stand first
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        active = np.tile(self.first, (len(texts), 1))
        ranked = sizes[order]
        one, high = np.uint64(1), np.uint64(63)
        for at in range(int(ranked[0]) if len(texts) else 0):
            n = int(np.searchsorted(-ranked, -at, "left"))
            byte = data[begin[:n] + at]
            now = active[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> high
            active[:n] = (moved & self.steps[byte]) | (now & self.loops[byte])
        out = np.empty((len(texts), len(self.ends)), bool)
        for g, (word, bit) in enumerate(self.ends):
            out[order, g] = active[:, word] & bit != 0
        return out


def judge_urls(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, otherwise: str = ALLOW, keep: list[str] | None = None
) -> DataFrame:
    """``pages`` with host, path, rule (name of the rule that holds, or null) and verdict.

    A rule fits its host and all subdomains if the path begins with its path; of several the one with
    the longest name holds, of equal names the first. A URL that no glob matches gets ``otherwise``.
    A null URL, or one without ``://``, has an empty host and path. Columns of these names in the
    input are replaced.
    """
    at = pages.columns.index(url)

    def make():
        globs = Globs([r.glob() for r in rules])
        by_length = np.array([-len(r.name) for r in rules]).argsort(kind="stable") if rules else np.empty(0, int)
        names = pa.array([rules[i].name for i in by_length], pa.string())
        verdicts = pa.array([*[rules[i].verdict for i in by_length], otherwise], pa.string())

        def compute(batch):
            parts = [canonical(u) for u in utf8(batch, at)]
            hits = globs.match([b"." + host + path for host, path in parts])[:, by_length]
            best = np.where(hits.any(1), hits.argmax(1) if len(rules) else 0, len(rules))
            named = pa.array(best, mask=best == len(rules))
            return [
                pa.array([h for h, _ in parts], pa.binary()).cast(pa.string()),
                pa.array([p for _, p in parts], pa.binary()).cast(pa.string()),
                names.take(named), verdicts.take(pa.array(best)),
            ]

        return compute

    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    return with_columns(pages, make, fields, keep, rows=4096)
