"""Cutting oversized texts at natural boundaries, with a fixed overlap.

Lexical-cohesion segmentation: at every natural boundary (heading, paragraph,
line or table row, sentence) the bags of words of the blocks on either side are
compared; a low similarity between two peaks is a topic valley. Inside each
size window the boundary with the deepest valley, helped a little by its kind,
becomes the cut. A window without any natural boundary is cut between tokens.
Every piece but the first repeats the last ``overlap`` tokens of the one before.

A token is a maximal run of letters, digits, underscores and combining accents,
or any other single code point that isn't white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.kernels import MARK, OTHER, WORD, by_chars, char_classes, code_points, mix64
from docloom.session import materialize

HARD, SENTENCE, LINE, PARAGRAPH, HEADING, END = range(6)
KINDS = ["token", "sentence", "line", "paragraph", "heading", "end"]
#: What a boundary's kind adds to the depth of its valley (depths lie in 0..2).
BONUS = np.array([0.0, 0.0, 0.15, 0.3, 0.6, 0.0])
#: Tokens in each of the two compared blocks, cells of a bag of words, boundaries looked at for a peak.
BLOCK, CELLS, PEAK = 60, 128, 4
#: Tokens of one text whose bags are held at once.
SLAB = 8192

_LF, _CR, _HASH = 10, 13, 35
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’*_`"], np.uint32)


class Tokens:
    """Token offsets of some texts: those of text i are ``first[i]:first[i + 1]``."""

    __slots__ = ("points", "start", "end", "first", "begin")

    def __init__(self, texts: list[str]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.points = code_points("\n".join(texts) + "\n")
        classes = char_classes()[self.points]
        part = (classes == WORD) | (classes == MARK)
        edge = np.diff(part.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        single = np.flatnonzero(classes == OTHER)
        start = np.concatenate((np.flatnonzero(edge == 1), single))
        end = np.concatenate((np.flatnonzero(edge == -1), single + 1))
        order = np.argsort(start, kind="stable")
        self.start, self.end = start[order], end[order]
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.begin)


def boundary_kinds(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The kind of natural boundary before each token (HARD where there is none)."""
    new_line = points == _LF
    new_line[:-1] |= (points[:-1] == _CR) & (points[1:] != _LF)
    lines = np.concatenate(([0], np.cumsum(new_line)))
    kinds = np.zeros(len(start), np.int8)
    if len(start) < 2:
        return kinds
    breaks = lines[start[1:]] - lines[end[:-1]]
    spaced = start[1:] > end[:-1]
    last = points[end[:-1] - 1]
    stop = np.isin(last, _STOPS)
    closed = np.isin(last, _CLOSERS)
    closed[1:] &= stop[:-1]
    closed[0] = False
    kinds[1:][spaced & (stop | closed)] = SENTENCE
    kinds[1:][breaks == 1] = LINE
    kinds[1:][breaks > 1] = PARAGRAPH
    kinds[1:][(breaks > 0) & (points[start[1:]] == _HASH)] = HEADING
    return kinds


def valley_depths(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Depth of the cohesion valley at each boundary: rise to the left peak plus rise to the right one.

    ``cells``: the bag cell of each token, negative for tokens without words.
    """
    if not len(at):
        return np.empty(0)
    alike = np.empty(len(at), np.float32)
    edges = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 + SLAB, SLAB))  # boundaries are in order, so a slab has a slice of them
    for lo, i, j in zip(range(0, int(at[-1]) + 1, SLAB), edges[:-1].tolist(), edges[1:].tolist()):
        if i == j:
            continue
        mine = slice(i, j)
        base = max(lo - BLOCK, 0)
        part = cells[base : lo + SLAB + BLOCK]
        bags = np.zeros((len(part) + 1, CELLS), np.float32)
        word = np.flatnonzero(part >= 0)
        bags[word + 1, part[word]] = 1
        np.cumsum(bags, axis=0, out=bags)
        here = at[mine] - base
        left = bags[here] - bags[np.maximum(here - BLOCK, 0)]
        right = bags[np.minimum(here + BLOCK, len(part))] - bags[here]
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        alike[mine] = (left * right).sum(1) / np.maximum(norm, 1e-9)
    padded = np.pad(alike, PEAK, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, PEAK + 1)
    return (windows[: len(at)].max(1) - alike) + (windows[PEAK : PEAK + len(at)].max(1) - alike)


def cut_points(count: int, at: np.ndarray, scores: np.ndarray, kinds: np.ndarray, maximum: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces ``(first token, end token, boundary kind)`` of at most ``maximum`` tokens."""
    overlap = min(max(overlap, 0), maximum - 1)
    pieces, begin = [], 0
    while count - begin > maximum:
        hi = begin + maximum
        cut, kind = hi, HARD
        for lo in (begin + max(maximum // 2, overlap), begin + overlap):
            i, j = np.searchsorted(at, lo, side="right"), np.searchsorted(at, hi, side="right")
            if j > i:
                best = i + int(np.argmax(scores[i:j]))
                cut, kind = int(at[best]), int(kinds[best])
                break
        pieces.append((begin, cut, kind))
        begin = cut - overlap
    pieces.append((begin, count, END))
    return pieces


def split_oversized(items: DataFrame, settings: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of every item that holds more tokens than its source's maximum.

    ``items``: ``kind``, ``key``, ``text``, ``source``; ``settings``: one row
    ``source``, ``maximum``, ``overlap`` per source. Result: ``item_kind``,
    ``item_key``, ``source``, ``piece_no`` (from 0), ``start`` and ``end`` (code
    points of the text), ``tokens``, ``boundary`` (what ends the piece) and, if
    asked for, ``text``. The pieces' ranges cover the whole text and neighbours
    share exactly ``overlap`` tokens (one less than the maximum at most; null
    counts as 0). Items within their maximum, null texts, sources without
    settings or with a null or non-positive maximum give no rows; repeated rows
    of an item give one set of pieces (of several texts of a key one counts, by a
    fixed rule); other columns are ignored. Only the texts of repeated keys are
    shuffled.
    """
    limits = settings.where("maximum > 0").groupBy("source").agg(
        F.min("maximum").cast("int").alias("maximum"), F.max(F.coalesce("overlap", F.lit(0))).cast("int").alias("overlap")
    )
    # No item has more tokens than code points, so shorter texts never reach Python.
    every = items.select("kind", "key", "source", "text").where("key is not null")
    repeated = materialize(every.groupBy("kind", "key").count().where("count > 1").select("kind", "key"))
    alone = every.join(repeated, ["kind", "key"], "left_anti")
    copies = every.join(repeated, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.max(F.struct(F.xxhash64("text", "source").alias("h"), "text", "source")).alias("one"))
    rows = alone.unionByName(copies.select("kind", "key", "one.source", "one.text")).join(limits, "source").where("length(text) > maximum")

    def run(batches):
        for batch in batches:
            kind, key, source, maximum, overlap = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "key", "source", "maximum", "overlap"))
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for lo, hi in by_chars(texts):
                out = list(_split(texts[lo:hi], maximum[lo:hi], overlap[lo:hi]))
                if not out:
                    continue
                which, number, start, end, tokens, bound = zip(*out)
                columns = [
                    pa.array([c[lo + i] for i in which]) for c in (kind, key, source)
                ] + [pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(tokens, pa.int32()), pa.array([KINDS[b] for b in bound])]
                names = ["item_kind", "item_key", "source", "piece_no", "start", "end", "tokens", "boundary"]
                if with_text:
                    columns.append(pa.array([texts[lo + i][s:e] for i, s, e in zip(which, start, end)]))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "item_kind string, item_key string, source string, piece_no int, start int, end int, tokens int, boundary string"
    return rows.select("kind", "key", "source", "text", "maximum", "overlap").mapInArrow(run, schema + (", text string" if with_text else ""))


def piece_totals(pieces: DataFrame, settings: DataFrame) -> DataFrame:
    """What an item's pieces hold, counted on their texts by another rule than the one that cut them.

    ``(item_kind, item_key, pieces, tokens, n_chars, within, shared)``: ``tokens``
    without the overlaps, ``within``: no piece is over the maximum, ``shared``: the
    overlaps of all pieces hold as many tokens as asked.
    """
    counted = F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    limits = settings.where("maximum > 0").groupBy("source").agg(F.min("maximum").alias("maximum"), F.max(F.coalesce("overlap", F.lit(0))).alias("overlap"))
    by = Window.partitionBy("item_kind", "item_key").orderBy("piece_no")
    again = F.lag("end").over(by) - F.col("start")  # code points that the piece before holds too
    one = pieces.withColumns({"n": counted, "again": again}).withColumn("twice", F.size(F.regexp_extract_all(F.substring(F.col("text"), F.lit(1), F.coalesce("again", F.lit(0))), F.lit(TOKEN), F.lit(0))))
    asked = F.least("overlap", F.col("maximum") - 1)
    return (
        one.join(limits, "source")
        .groupBy("item_kind", "item_key")
        .agg(
            F.count("*").alias("pieces"),
            (F.sum("n") - F.sum("twice")).alias("tokens"),
            F.max("end").cast("long").alias("n_chars"),
            F.max(F.col("n")).alias("most"),
            F.max("maximum").alias("maximum"),
            F.bool_and((F.col("piece_no") == 0) | (F.col("twice") == asked)).alias("shared"),
        )
        .select("item_kind", "item_key", "pieces", "tokens", "n_chars", (F.col("most") <= F.col("maximum")).alias("within"), "shared")
    )


#: The token rule as a pattern of the JVM, for checks.
TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"




def _split(texts: list[str], maximum: list[int], overlap: list[int]):
    some = Tokens(texts)
    counts = np.diff(some.first)
    large = [i for i in range(len(texts)) if counts[i] > maximum[i]]
    if not large:
        return
    kinds = boundary_kinds(some.points, some.start, some.end)
    low = some.points | np.uint32(32)  # folds ASCII case, enough for a bag of words
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(low))))
    cells = (mix64(sums[some.end] - sums[some.start]) % np.uint64(CELLS)).astype(np.int16)
    cells[(some.end - some.start) < 3] = -1
    for i in large:
        a, b = int(some.first[i]), int(some.first[i + 1])
        own = kinds[a:b]
        at = np.flatnonzero(own[1:] > HARD) + 1
        scores = valley_depths(cells[a:b], at) + BONUS[own[at]]
        start, base = some.start[a:b], int(some.begin[i])
        for number, (s, e, kind) in enumerate(cut_points(b - a, at, scores, own[at], maximum[i], overlap[i])):
            yield (
                i,
                number,
                0 if s == 0 else int(start[s]) - base,
                len(texts[i]) if e == b - a else int(start[e]) - base,
                e - s,
                kind,
            )
