"""Counts of unigram tokens without making the tokens.

An Aho-Corasick automaton names all vocabulary pieces that end at each place of a word. Dynamic
programming carries only the best score and its number of pieces, under the tokenizers library's
rules: the longest piece wins a tie (the path found first), and an unknown character costs ten more
than the worst piece and counts as its UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from airloom.llm.frames import strings, with_columns

UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Words that a Python worker remembers with their counts.
MEMO = 300_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts under a unigram vocabulary with byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The number of pieces on the best path through a word."""
        best: list[float | None] = [0.0, *[None] * len(word)]
        counts, done = [0] * (len(word) + 1), 0
        for last, (size, score) in self.automaton.iter(word):  # ends grow; at one end the longest comes first
            while done < last:
                done += 1
                self._unknown(word, done, best, counts)
            start, end = last + 1 - size, last + 1
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end], counts[end] = total, counts[start] + 1
        while done < len(word):
            done += 1
            self._unknown(word, done, best, counts)
        return counts[-1]

    def _unknown(self, word: str, end: int, best: list[float | None], counts: list[int]) -> None:
        """The last path to a place: a character that is no piece of its own, as its bytes."""
        ch = word[end - 1]
        if ch in self.single:
            return
        total = best[end - 1] + self.unknown
        if best[end] is None or total > best[end]:
            best[end], counts[end] = total, counts[end - 1] + len(ch.encode())

    def _counts(self, words: list[str]) -> list[int]:
        recent, older, out = self.recent, self.older, []
        for word in words:
            n = recent.get(word) or older.get(word)
            if n is None:
                n = self.word(MARK + word)
            if len(word) <= 64:
                recent[word] = n
            out.append(n)
        if len(recent) > MEMO:
            self.recent, self.older = {}, recent
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Pieces of each text: a word begins at each space, one is put before the text."""
        words = []
        for text in texts:
            text = text.replace(" ", MARK)
            words.append((text[1:] if text[:1] == MARK else text).split(MARK) if text else [])
        ends = np.cumsum([0, *map(len, words)])
        parts = pa.array(chain.from_iterable(words), pa.large_string()).dictionary_encode()
        each = np.array(self._counts(parts.dictionary.to_pylist()), np.int64)
        total = np.concatenate([[0], np.cumsum(each[parts.indices.to_numpy()])]) if len(parts) else np.zeros(1, np.int64)
        return np.diff(total[ends]).tolist()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a vocabulary file, built once in each Python worker."""
    return Counter(read_vocabulary(path))


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of unigram pieces of each text.

    The vocabulary is the pieces and scores of a sentencepiece file, readable at ``path`` on every
    executor. A null or empty text has none. A column named ``out`` in the input is replaced.
    """
    at = docs.columns.index(text)

    def make():
        model = counter(path)
        return lambda batch: [model.count(strings(batch, at))]

    return with_columns(docs, make, [T.StructField(out, T.LongType())], keep, rows=1024)
