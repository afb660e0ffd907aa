"""Vectorized text kernels shared by the operators of this folder.

A batch of texts becomes one array of code points; words, their 64-bit hashes
and their shingles are then found with array operations over the whole batch,
never with a Python loop over words.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Code points handled at once; bounds the memory of a Python worker.
BATCH_CHARS = 1_000_000

SPACE, WORD, OTHER, MARK = 0, 1, 2, 3

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def char_classes() -> np.ndarray:
    """SPACE, WORD (letters, digits, underscore), MARK (combining) or OTHER of each code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    for cls, pattern in ((WORD, r"\w+"), (SPACE, r"\s+")):
        for m in re.finditer(pattern, every):
            table[m.start() : m.end()] = cls
    table[0xD800:0xE000] = OTHER
    for code in [*range(0x300, 0x1E000), *range(0x1E000, 0x1F000), *range(0xE0100, 0xE01F0)]:
        if table[code] != WORD and unicodedata.category(chr(code))[0] == "M":
            table[code] = MARK
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(text: str) -> str:
    """Composed accents, lower case."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower()


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of some texts: ``hash[first[i]:first[i + 1]]`` are those of text i."""

    __slots__ = ("text", "hash", "start", "end", "first")

    def __init__(self, texts: list[str]):
        folded = [fold(t) for t in texts]
        lengths = np.fromiter(map(len, folded), np.int64, len(folded)) + 1
        self.text = "\n".join(folded) + "\n"
        points = code_points(self.text)
        inside = np.zeros(len(points) + 1, np.int8)
        inside[:-1] = char_classes()[points] == WORD
        edge = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = np.empty(len(self.start), np.uint64)
        # A word's hash does not depend on its place, so a very long text is hashed in slices.
        lo = 0
        while lo < len(self.start):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + BATCH_CHARS, side="right")))
            base = self.start[lo]
            part = points[base : self.end[hi - 1]]
            up, down = _powers(1 << max(len(part), 2).bit_length())
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(mix64(part) * up[: len(part)], out=sums[1:])
            start, end = self.start[lo:hi] - base, self.end[lo:hi] - base
            self.hash[lo:hi] = mix64((sums[end] - sums[start]) * down[start])
            lo = hi
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(lengths))))

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def runs_of(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words, and each text's first run."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    acc = words[at]
    for k in range(1, size):
        acc = mix64(acc) + words[at + k]
    return mix64(acc), begin


def distinct_sorted(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct values in ascending order."""
    values = values.copy()
    for i in range(len(begin) - 1):
        values[begin[i] : begin[i + 1]].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    inner = begin[:-1][np.diff(begin) > 0]
    keep[inner] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[begin]


def by_chars(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts of about BATCH_CHARS code points each (one text at least)."""
    lo, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= BATCH_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binaries(values: np.ndarray, begin: np.ndarray):
    """A pyarrow BINARY array whose element i holds the raw bytes of group i."""
    import pyarrow as pa

    width = values.dtype.itemsize
    offsets = (begin * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def groups_in_order(batches: Iterable, key: list[str]) -> Iterator:
    """Tables holding all rows of one or more whole key groups, from batches sorted by key.

    Rows of a group may span batches; what is held is one batch and the group
    that is still open.
    """
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            change[0] = any(
                last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() != batch.column(batch.schema.get_field_index(k))[0].as_py() for k in key
            )
        cuts = np.flatnonzero(change)
        if len(cuts) == 0:
            held.append(batch)
            continue
        cut = int(cuts[-1])
        head = held + ([batch.slice(0, cut)] if cut else [])
        if head:
            yield pa.Table.from_batches(head).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
