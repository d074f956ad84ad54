"""Cutting texts where byte-level tokenizers always cut, and coding each different part once."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: All that any of the engines at work here takes for white space, and the cut mark itself.
_SPACE = r"[\x00\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IRREGULAR = rf"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$|\x00"
#: A Latin letter or digit, and a comma or full stop that ends a segment.
_STOP = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([,.]\0)"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

#: Texts whose parts are looked up together.
ROWS = 512


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before single spaces and line feeds between two other characters.

    There a new match of the GPT-2 pattern begins whatever stands around it: a space belongs to what
    follows, a single line feed is a match of its own. So does one at a comma or full stop between a
    letter or digit and such a place. Returns all segments, and where each text's end.
    """
    odd = pc.match_substring_regex(texts, pattern=_IRREGULAR)
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
    marked = pc.replace_substring_regex(marked, _STOP, "\\1\0\\2")
    if not pc.any(odd).as_py():
        cut = pc.split_pattern(marked, "\0")
        return cut.flatten(), np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])
    lists = pc.split_pattern(marked, "\0").to_pylist()
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        lists[i] = _CUT.split(texts[i].as_py())
    return pa.array(chain.from_iterable(lists), texts.type), np.cumsum([0, *map(len, lists)])


class Memo:
    """Codes of parts that a Python worker has met. Above ``most`` the older ones go, unless used since."""

    def __init__(self, code: Callable[[list[str]], list[bytes]], most: int, longest: int = 64):
        self.code, self.most, self.longest, self.recent, self.older = code, most, longest, {}, {}

    def __call__(self, parts: list[str]) -> list[bytes]:
        if len(self.recent) > self.most:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        out = list(map(recent.get, parts))
        new, places = [], []
        for i in [i for i, x in enumerate(out) if x is None]:
            part = parts[i]
            code = older.get(part)
            if code is None:
                new.append(part)
                places.append(i)
            else:
                out[i] = recent[part] = code
        for i, part, code in zip(places, new, self.code(new) if new else [], strict=True):
            out[i] = code
            if len(part) <= self.longest:
                recent[part] = code
        return out


def coded(texts: pa.Array, memo: Memo) -> tuple[pa.Array, list[int]]:
    """The codes of each text's segments, joined (binary), and their lengths in bytes.

    Every different segment of the batch is looked up once, and Arrow strings the results together.
    """
    parts, ends = segments(texts)
    if not len(parts):
        return pa.array([b""] * len(texts), pa.binary()), [0] * len(texts)
    parts = parts.dictionary_encode()
    codes = pa.array(memo(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
    offsets = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1][ends]
    joined = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), codes.buffers()[2]])
    return joined.cast(pa.binary()), np.diff(offsets).tolist()
