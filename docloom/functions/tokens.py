"""Token counters: how many tokens a text has, and where they stand in it.

A counter cuts a text into spans, each worth some tokens. Sums over the spans
then give the size of any part of a long text in logarithmic time.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
from collections.abc import Sequence

_WORD = re.compile(r"\w+|[^\w\s]")
#: Fixed value: the published split pattern of the byte-level vocabularies.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that begin and end an encoder's input.
SPECIAL = 2


class WordTokens:
    """Words and single signs, one token each."""

    name = "words"

    def spans(self, text: str) -> tuple[Sequence[int], Sequence[int], Sequence[int]]:
        """Starts, ends and summed sizes (one more than spans, from 0) of the text's spans."""
        found = [m.span() for m in _WORD.finditer(text)]
        return [a for a, _ in found], [b for _, b in found], range(len(found) + 1)

    def part(self, piece: str) -> int:
        """Tokens of a part of one span."""
        return 1

    def count(self, text: str, special: bool = False) -> int:
        return self.spans(text)[2][-1] + SPECIAL * special


class CharacterTokens(WordTokens):
    """Every code point is a token."""

    name = "characters"

    def spans(self, text: str) -> tuple[Sequence[int], Sequence[int], Sequence[int]]:
        return range(len(text)), range(1, len(text) + 1), range(len(text) + 1)


class VocabularyTokens(WordTokens):
    """Tokens of a public byte-level vocabulary (a ``.tiktoken`` file), counted word by word."""

    def __init__(self, path: str):
        self.path = path
        self.name = path.rsplit("/", 1)[-1]

    def spans(self, text: str) -> tuple[Sequence[int], Sequence[int], Sequence[int]]:
        starts, ends, sums = [], [], [0]
        for m in _split_pattern().finditer(text):
            starts.append(m.start())
            ends.append(m.end())
            sums.append(sums[-1] + self.part(m[0]))
        return starts, ends, sums

    def part(self, piece: str) -> int:
        return _pieces(self.path, piece)


@functools.cache
def _split_pattern():
    import regex

    return regex.compile(SPLIT_PATTERN)


@functools.lru_cache(4)
def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` vocabulary file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(1 << 16)
def _pieces(path: str, word: str) -> int:
    return len(encoding(path).encode_ordinary(word))


WORDS, CHARACTERS = WordTokens(), CharacterTokens()


class Sizer:
    """Tokens of any part ``[a, b)`` of one text."""

    def __init__(self, text: str, tokens: WordTokens = WORDS):
        self.text, self.tokens = text, tokens
        self.starts, self.ends, self.sums = tokens.spans(text)

    def __call__(self, a: int, b: int) -> int:
        first = bisect.bisect_right(self.ends, a)  # spans that end behind a
        behind = bisect.bisect_left(self.starts, b)  # and begin before b
        if first >= behind or a >= b:
            return 0
        total = self.sums[behind] - self.sums[first]
        for i in {first, behind - 1}:  # spans that a or b cuts
            low, high = max(a, self.starts[i]), min(b, self.ends[i])
            if high - low < self.ends[i] - self.starts[i]:
                total += self.tokens.part(self.text[low:high]) - (self.sums[i + 1] - self.sums[i])
        return total


def passage(title: str, headings: tuple[str, ...] | list[str], text: str) -> str:
    """What an encoder sees of a chunk."""
    return f"passage: {title}\n{' > '.join(headings)}\n{text}"


def query_text(question: str) -> str:
    return f"query: {question}"


def smallest_reaching(size, limit: int, most: int) -> int | None:
    """The least n from 0 to ``most`` with ``size(n) >= limit`` for a size that never falls; None if there is none.

    The bound is doubled until it reaches the limit and then halved in, so a size
    that is costly to take is taken some 2 log n times.
    """
    high = 1
    while high < most and size(high) < limit:
        high *= 2
    high = min(high, most)
    if size(high) < limit:
        return None
    return bisect.bisect_left(range(high + 1), limit, key=size)
