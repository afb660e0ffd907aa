"""Evaluation texts that stand wholly or in part in training documents.

Wu-Manber multi-pattern search over words. Patterns are the runs of ``run``
consecutive words of every test item (the whole item where it is shorter). The
search looks at blocks of two words: a shift table says how far the window may
move when a block ends it, blocks that end no pattern prefix skip up to
``window - 1`` words, and blocks with shift zero select a suffix bucket whose
patterns are compared with the text directly. Documents stream through one
narrow stage; only the test set travels, in blocks of bounded size.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import Words, by_chars, mix64
from docloom.session import materialize

#: Code points of test items per scan of the documents; 1.4 million took 0.3 GB of a Python worker.
CHARS_PER_SCAN = 2_000_000


def blocks_of(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it (the first has none)."""
    out = mix64(words)
    out[1:] = mix64(mix64(words[:-1]) + words[1:])
    return out


class WuManber:
    """Patterns of at least ``window`` words; matches begin with their first ``window`` words."""

    def __init__(self, patterns: dict[tuple[str, ...], set], hashes: dict[tuple[str, ...], np.ndarray]):
        self.window = min(map(len, patterns))
        self.far = max(self.window - 1, 1)
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[str, ...], set]]] = {}
        first = 1 if self.window > 1 else 0
        for words, owners in patterns.items():
            ends = blocks_of(hashes[words][: self.window]).tolist()
            for at in range(first, self.window):
                left = self.window - 1 - at
                if left < self.shift.get(ends[at], self.far):
                    self.shift[ends[at]] = left
            self.buckets.setdefault(ends[-1], []).append((words, owners))

    def search(self, some: Words):
        """Yields (text number, owners) for every occurrence inside one text."""
        blocks = (blocks_of(some.hash) if self.window > 1 else mix64(some.hash)).tolist()
        size, shift, far, buckets = len(blocks), self.shift.get, self.far, self.buckets
        at = self.window - 1
        while at < size:
            step = shift(blocks[at], far)
            if step:
                at += step
                continue
            begin = at - self.window + 1
            text = int(np.searchsorted(some.first, begin, side="right")) - 1
            end = some.first[text + 1]
            for words, owners in buckets.get(blocks[at], ()):
                if begin + len(words) <= end and all(some.word(begin + k) == w for k, w in enumerate(words)):
                    yield text, owners
            at += 1


def matchers(items: list[tuple], run: int) -> list[WuManber]:
    """One matcher for the runs of long items, and one for each class of short items (1, 2-3, 4-7, ... words).

    A matcher's window is its shortest pattern, so very short items never narrow
    the window of longer ones.
    """
    some = Words([text or "" for _, text in items])
    groups: dict[int, tuple[dict, dict]] = {}
    for i, (item, _) in enumerate(items):
        lo, hi = int(some.first[i]), int(some.first[i + 1])
        size = min(run, hi - lo)
        if not size:
            continue
        patterns, hashes = groups.setdefault(run if size == run else size.bit_length() - run, ({}, {}))
        for at in range(lo, hi - size + 1):
            words = tuple(some.word(k) for k in range(at, at + size))
            patterns.setdefault(words, set()).add(item)
            hashes[words] = some.hash[at : at + size]
    return [WuManber(p, h) for _, (p, h) in sorted(groups.items(), key=lambda x: x[0])]


#: The matchers of the scan that this Python worker is at.
_built: dict[str, list[WuManber]] = {}


def _matchers_of(name: str, items: list[tuple], run: int) -> list[WuManber]:
    if name not in _built:
        _built.clear()
        _built[name] = matchers(items, run)
    return _built[name]


def leaked_passages(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """Distinct ``(doc_id, item_id)``: the document holds ``run`` consecutive words of the item.

    An item of fewer than ``run`` words must stand whole. Null and empty texts on
    either side never match; repeated rows count once; rows with a null id are
    ignored; without items the result is empty. Other columns are ignored. Test
    items travel CHARS_PER_SCAN code points at a time, and every scan cuts the
    documents into words once; with several scans only one scan's items are on
    the driver and the executors at a time.
    """
    spark = documents.sparkSession
    known = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    scans = max(1, -(-int(chars) // CHARS_PER_SCAN))
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")

    def one(number: int) -> DataFrame:
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == number)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(tuple(r) for r in part.collect())))  # about CHARS_PER_SCAN

        def find(batches):
            search = _matchers_of(*shared.value, run)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = set()
                for lo, hi in by_chars(rows):
                    some = Words(rows[lo:hi])
                    for one_matcher in search:
                        for text, owners in one_matcher.search(some):
                            found.update((ids[lo + text], item) for item in owners)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found))], names=["doc_id", "item_id"])

        leaks = texts.mapInArrow(find, "doc_id long, item_id long")
        if scans > 1:
            leaks = materialize(leaks)
            shared.destroy()
        return leaks

    return reduce(DataFrame.union, [one(n) for n in range(scans)]).distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """One row ``(item_id, kind, lang, documents)`` per test item, 0 documents where it did not leak."""
    counts = leaks.groupBy("item_id").agg(F.count("*").alias("documents"))
    known = items.where("item_id is not null").select("item_id", "kind", "lang").dropDuplicates(["item_id"])
    return known.join(counts, "item_id", "left").select("item_id", "kind", "lang", F.coalesce("documents", F.lit(0)).alias("documents"))
