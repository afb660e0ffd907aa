"""Texts that were decoded with a wrong character encoding, and their originals.

Adjacent character pairs are scored by their share of the corpus' mutual
information, p(ab) * log(p(ab) / (p(a) p(b))): pairs of garbled text may be
strongly tied to each other, but their share is small. Per document the
maximum-scoring segments of improbability isolate the suspicious runs, at one
level for bytes of one 8-bit encoding read as another and at a weaker one for
UTF-8 read as an 8-bit encoding (up to three times over), which proves itself by
its form. Only words inside those runs are tried with the inverse mappings. A
mapping is accepted if the restored characters are clearly more probable in the
corpus than the garbled ones. Control and replacement characters always make a
run. Once a mapping is proven for two words of a line, the words between them
are part of its passage and are restored where that makes them more probable.

Pair counts are taken over all documents. The alphabet is the fixed repertoire
of the encodings below (other characters count by their general category), so
the table that travels has a fixed size.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import by_chars, code_points

#: The 8-bit encodings a text may have been written in or read as.
ENCODINGS = [
    "cp1252", "cp1251", "koi8_r", "koi8_u", "cp866", "iso8859_5",
    "mac_cyrillic", "mac_roman", "cp437", "cp850", "cp1250", "latin_1",
]
#: log share of mutual information under which a pair is improbable, and under which UTF-8 is tried.
IMPROBABLE, DOUBTFUL = -11.0, -9.5
#: Gain of one word (natural log units) and per pair that proves a mapping; the same for all words of a document.
WORD_GAIN, WORD_MEAN, TEXT_GAIN, TEXT_MEAN = 6.5, 3.0, 12.0, 2.0
FLOOR, WEAKEST_PMI, FOLD_COST, SMALLEST = -20.0, 0.5, 1.5, 1e-9
UTF8_DEPTH = 3
_LOST = re.compile("[\x80-\x84\x86-\x9f�]")


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """Code point of each byte; bytes an encoding leaves undefined pass as control characters."""
    out = {}
    for name in ENCODINGS:
        points = np.arange(256, dtype=np.uint32)
        for byte in range(128, 256):
            try:
                points[byte] = ord(bytes([byte]).decode(name))
            except UnicodeDecodeError:
                pass
        out[name] = points
    return out


@functools.cache
def _bytes_of() -> dict[str, np.ndarray]:
    """Byte of each BMP code point, -1 where the encoding lacks it."""
    out = {}
    for name, points in _tables().items():
        back = np.full(65536, -1, np.int16)
        back[points[::-1]] = np.arange(255, -1, -1)
        out[name] = back
    return out


@functools.cache
def inverse_mappings() -> dict[tuple[str, str], np.ndarray]:
    """For (read as, written in): the code point meant by each BMP code point, 0 where impossible."""
    out, seen = {}, set()
    for wrong, back in _bytes_of().items():
        for right, points in _tables().items():
            # Nobody wrote control characters, and an inner space would only cut a word in two.
            sound = np.array([not (chr(p).isspace() or unicodedata.category(chr(p)) == "Cc") for p in points.tolist()])
            meant = np.where(back >= 0, np.where(sound, points, 0)[back], 0).astype(np.uint32)
            key = meant.tobytes()
            if wrong != right and key not in seen:
                seen.add(key)
                out[wrong, right] = meant
    return out


@functools.cache
def alphabet() -> tuple[np.ndarray, int, np.ndarray]:
    """Index of each BMP code point, number of indices, and each index's lower-case index (itself where none)."""
    known = sorted(
        {int(p) for t in _tables().values() for p in t} | {*range(0x20, 0x250)} | {*range(0x400, 0x530)} | {*range(0x2010, 0x2060)} | {9, 10, 13, 0xFFFD}
    )
    rest = {c: len(known) + i for i, c in enumerate("LMNPSZC")}
    index = np.fromiter((rest[unicodedata.category(chr(c))[0]] for c in range(65536)), np.int32, 65536)
    index[known] = np.arange(len(known))
    index[0xA0] = index[0x20]  # the no-break space is a space
    low = np.arange(len(known) + len(rest))
    for i, c in enumerate(known):
        low[i] = index[min(ord(chr(c).lower()[0]), 65535)]
    return index, len(low), low


def _indices(points: np.ndarray) -> np.ndarray:
    return alphabet()[0][np.minimum(points, 65535)]


def pair_counts(texts: DataFrame) -> np.ndarray:
    """Counts of adjacent pairs over all texts (one string column), in a table of fixed size."""
    size = alphabet()[1]

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for lo, hi in by_chars(rows):
                i = _indices(code_points("\n".join(t or "" for t in rows[lo:hi]))).astype(np.int64)
                if len(i) > 1:
                    total += np.bincount(i[:-1] * size + i[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size * size)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(size, size)


def pair_scores(counts: np.ndarray) -> np.ndarray:
    """log of each pair's share of the mutual information, relative to IMPROBABLE (negative: improbable)."""
    _, size, low = alphabet()
    p = counts / max(counts.sum(), 1)
    left, right = p.sum(1), p.sum(0)
    information = np.log((p + SMALLEST) / (left[:, None] * right[None, :] + SMALLEST))
    score = np.log(p * np.maximum(information, WEAKEST_PMI) + SMALLEST)
    upper = low != np.arange(size)
    folds = ~(~upper[:, None] & upper[None, :] & (np.isin(np.arange(size), low[upper]))[:, None])  # not from lower to upper case
    score = np.where(folds, np.maximum(score, score[low][:, low] - FOLD_COST), score)
    return np.maximum(score, FLOOR).astype(np.float32) - np.float32(IMPROBABLE)


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-scoring segments ``[start, end)`` of a sequence of weights (Ruzzo and Tompa)."""
    if not len(weights):
        return []
    positive = weights > 0
    cuts = np.concatenate(([0], np.flatnonzero(positive[1:] != positive[:-1]) + 1))
    sums = np.add.reduceat(weights, cuts).tolist()
    bounds = np.append(cuts, len(weights)).tolist()
    final: list[list] = []  # start, end, sum before, sum after
    kept: list[list] = []  # those that may still grow
    total = 0.0
    for k, value in enumerate(sums):
        if value <= 0:
            total += value
            continue
        item = [bounds[k], bounds[k + 1], total, total + value]
        total += value
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= item[2]:
                j -= 1
            if j < 0:  # nothing before can join what comes after
                final += kept
                kept = []
                break
            if kept[j][3] >= item[3]:
                break
            item = [kept[j][0], item[1], kept[j][2], item[3]]
            del kept[j:]
        kept.append(item)
    return [(s, e) for s, e, _, _ in final + kept]


class Restorer:
    """Finds garbled words of texts and what they were, by the corpus' pair scores.

    Many texts are handled as one array; per word Python runs only where a word
    can be read as UTF-8 and where a text is changed.
    """

    def __init__(self, scores: np.ndarray):
        self.scores = scores

    def pairs(self, points: np.ndarray) -> np.ndarray:
        i = _indices(points)
        return self.scores[i[:-1], i[1:]]

    def restore(self, texts: list[str]) -> dict[int, tuple[str, str | None, bool]]:
        """(restored text, mappings, whether garbled characters remain) of the texts that are not sound."""
        some = [i for i, t in enumerate(texts) if t and not t.isascii()]
        if not some:
            return {}
        joined = "\n" + "\n".join(texts[i] for i in some) + "\n"
        p = np.minimum(code_points(joined), 65535)
        begin = 1 + np.concatenate(([0], np.cumsum([len(texts[i]) + 1 for i in some])))
        s = np.append(self.pairs(p), np.float32(0))  # s[j]: the pair of characters j and j + 1
        edge = np.diff((p > 127).view(np.int8), prepend=np.int8(0))
        wa, wb = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.stack((wa - 1, wb), 1).ravel()  # a word's pairs include its two neighbours
        own = np.add.reduceat(s, bounds)[::2]
        text_of = np.searchsorted(begin, wa, side="right") - 1
        # A pair with a control or replacement character is as improbable as can be, however often the corpus holds it.
        gone = _lost()[p] > 0
        s[gone | np.append(gone[1:], False)] = FLOOR - IMPROBABLE
        inside = self.words_in_runs(s, begin, wa, wb, 0)
        doubtful = self.words_in_runs(s, begin, wa, wb, DOUBTFUL - IMPROBABLE)
        lost = np.bincount(text_of[inside], np.maximum.reduceat(_lost()[p], np.stack((wa, wb), 1).ravel())[::2][inside], len(some)) > 0

        changes: dict[int, str] = {}
        used: dict[int, dict[str, None]] = {}
        self._utf8(joined, p, wa, wb, own, text_of, np.flatnonzero(doubtful & _may_be_utf8(p, wa, wb)), changes, used)
        open_words = np.flatnonzero(inside)
        open_words = open_words[[w not in changes for w in open_words.tolist()]]
        every, utf8, mappings = open_words, set(changes), {}
        while True:  # passages of one text may have been misread in several ways
            known = len(changes)
            more = self._single(joined, p, wa, wb, own, text_of, open_words, every, utf8, mappings, len(some), changes, used)
            if len(changes) == known:
                break
            open_words = every[np.isin(text_of[every], more) & [w not in changes for w in every.tolist()]]

        of_text: dict[int, list[int]] = {k: [] for k in np.flatnonzero(lost).tolist()}
        for w in sorted(changes):
            of_text.setdefault(int(text_of[w]), []).append(w)
        found = {}
        for k, changed in of_text.items():
            out, at = [], int(begin[k])
            for w in changed:
                out += [joined[at : wa[w]], changes[w]]
                at = int(wb[w])
            restored = "".join(out) + joined[at : begin[k + 1] - 1]
            found[some[k]] = restored, ", ".join(used.get(k, ())) or None, bool(_LOST.search(restored))
        return found

    def words_in_runs(self, s: np.ndarray, begin: np.ndarray, wa: np.ndarray, wb: np.ndarray, level: float) -> np.ndarray:
        """Whether each word ``[wa, wb)`` meets a maximum-scoring segment of pairs that score below ``level``.

        No segment crosses two texts, which begin at ``begin``.
        """
        weights = np.clip(level - s, -6, 6)
        weights[begin[1:] - 1] = -1e6
        steps = np.zeros(len(wa) + 1, np.int32)
        if segments := maximal_segments(weights):
            sa, se = (np.array(c) for c in zip(*segments))
            np.add.at(steps, np.searchsorted(wb, sa, side="right"), 1)
            np.add.at(steps, np.searchsorted(wa, se, side="right"), -1)
        return np.cumsum(steps)[:-1] > 0

    def _utf8(self, joined, p, wa, wb, own, text_of, words, changes, used):
        paths: dict[int, set] = {}
        tried: dict[int, list] = {}
        for w in words.tolist():
            a, b = int(wa[w]), int(wb[w])
            tried[w] = utf8_readings(joined[a:b])
            best = None
            for path, t in tried[w]:
                new = self.pairs(np.concatenate((p[a - 1 : a], code_points(t), p[b : b + 1])))
                # Means, as the reading has fewer characters and so fewer pairs; or sums, if the corpus knows them all.
                if new.mean() > max(own[w] / (b - a + 1), 0) or new.sum() > own[w] and new.min() > FLOOR - IMPROBABLE + 1:
                    best = max(best or (new.mean(), path, t), (new.mean(), path, t))
            if best:
                k = int(text_of[w])
                changes[w] = best[2]
                paths.setdefault(k, set()).add(best[1])
                used.setdefault(k, {})["utf_8 as " + " as ".join(reversed(best[1]))] = None
        for w, readings in tried.items():  # what is proven for a text holds for its other readable words
            if w not in changes:
                proven = paths.get(int(text_of[w]), ())
                changes |= {w: t for path, t in readings if path in proven}

    def _single(self, joined, p, wa, wb, own, text_of, chosen, every, utf8, mappings, count, changes, used):
        """The 8-bit mapping that explains a text's chosen words best, where one is proven; the texts with one.

        Of several ``mappings`` proven for a text, each word of ``every`` is read by the one that makes it most probable.
        """
        if not len(chosen):
            return np.empty(0, int)
        a, b, doc = wa[chosen], wb[chosen], text_of[chosen]
        letter, space = _letters()
        ends = np.stack((a, b), 1).ravel()
        letters = np.add.reduceat(letter[p].astype(np.int32), ends)[::2]
        blank = np.add.reduceat(space[p].astype(np.int32), ends)[::2] == b - a
        # Two letters, or touching one, can prove a mapping; lone signs and letters prove nothing,
        # but for a lone letter that may have been a dash.
        core = ~blank & ((letters > 1) | (b - a > 1) & (letters > 0) | letter[p[a - 1]] | letter[p[b]])
        lone = (b - a == 1) & (letters == 1)
        sizes = b - a + 2
        first = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(first[-1]) + np.repeat(a - 1 - first[:-1], sizes)
        points = p[at]
        edge = np.zeros(len(points), bool)
        edge[first[:-1]] = edge[first[1:] - 1] = True
        before, pairs = own[chosen], sizes - 1
        best = np.zeros(count)
        choice = np.full(count, -1)
        names = list(inverse_mappings())
        index = alphabet()[0]
        for number, name in enumerate(names):
            mapped = np.where(edge, points, inverse_mappings()[name][points])
            possible = np.minimum.reduceat(mapped, first[:-1]) > 0
            tells = possible & (core | lone & _punctuation()[mapped[first[:-1] + 1]])
            if not tells.any():
                continue
            # Only the words this mapping can read are scored.
            used_words = np.flatnonzero(possible)
            part = np.repeat(possible, sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[used_words])))[:-1]
            i = index[mapped[part]]
            score = np.concatenate((np.zeros(1, np.float32), self.scores[i[:-1], i[1:]]))
            score[starts] = 0  # pairs across two words
            gain = np.add.reduceat(score, starts) - before[used_words]
            good = gain > 0
            # Evidence are only words all of whose pairs the corpus knows.
            told = good & tells[used_words] & (np.minimum.reduceat(score, starts) > FLOOR - IMPROBABLE + 1)
            docs, many = doc[used_words], pairs[used_words]
            total, told_pairs = np.bincount(docs[told], gain[told], count), np.bincount(docs[told], many[told], count)
            strong = told & (gain >= WORD_GAIN) & (gain >= WORD_MEAN * many)
            proven = (np.bincount(docs[strong], minlength=count) > 0) | (total >= TEXT_GAIN) & (total >= TEXT_MEAN * told_pairs)
            whole = np.bincount(docs[good], gain[good], count)
            better = proven & (whole > best)
            best[better], choice[better] = whole[better], number
        for k in np.flatnonzero(choice >= 0).tolist():
            wrong, right = name = names[choice[k]]
            mappings.setdefault(k, []).append(inverse_mappings()[name])
            done = []
            for w in every[text_of[every] == k].tolist():
                if (read := self._better(p, wa[w], wb[w], mappings[k], own[w])) is not None:
                    changes[w] = read
                    done.append(w)
            # Between two restored words of a line the mapping holds for every word that it makes more probable.
            for left, after in zip(done, done[1:]):
                if after > left + 1 and "\n" not in joined[wb[left] : wa[after]]:
                    for w in range(left + 1, after):
                        if w not in utf8 and (read := self._better(p, wa[w], wb[w], mappings[k], own[w])) is not None:
                            changes[w] = read
            used.setdefault(k, {})[f"{right} as {wrong}"] = None
        return np.flatnonzero(choice >= 0)

    def _better(self, p, a, b, meant, own) -> str | None:
        """The most probable of what mappings read for a word, if that is possible and more probable than the word."""
        best = None
        for read in (m[p[a:b]] for m in meant):
            if read.all() and (total := self.pairs(np.concatenate((p[a - 1 : a], read, p[b : b + 1]))).sum()) > own:
                best, own = "".join(map(chr, read.tolist())), total
        return best


@functools.cache
def _punctuation() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "P" for c in range(65536)), bool, 65536)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.fromiter((test(chr(c)) for c in range(65536)), bool, 65536) for test in (str.isalpha, str.isspace))


@functools.cache
def _lost() -> np.ndarray:
    return np.fromiter((_LOST.match(chr(c)) is not None for c in range(65536)), np.int8, 65536)


def _may_be_utf8(p: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Whether a word begins, in some encoding, with a lead byte and a continuation byte."""
    first, second = p[wa], p[np.minimum(wa + 1, len(p) - 1)]
    may = np.zeros(len(wa), bool)
    for back in _bytes_of().values():
        x, y = back[first], back[second]
        may |= (x >= 0xC2) & (x <= 0xF4) & (y >= 0x80) & (y <= 0xBF)
    return may & (wb - wa > 1)


@functools.lru_cache(1 << 15)
def utf8_readings(word: str, depth: int = UTF8_DEPTH):
    """(encodings it was read as, last first; text) for every way the word is misread UTF-8."""
    found = []
    points = np.minimum(code_points(word), 65535)
    for name, back in _bytes_of().items():
        first = back[points[0]]
        if first < 0xC2 or first > 0xF4:
            continue
        raw = back[points]
        if raw.min() < 0:
            continue
        try:
            text = raw.astype(np.uint8).tobytes().decode("utf-8")
        except UnicodeDecodeError:
            continue
        found.append(((name,), text))
        if depth > 1 and not text.isascii():
            found += [((name, *path), t) for path, t in utf8_readings(text, depth - 1)]
    return found


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, mappings, damaged, restored)`` of the documents with garbled characters.

    ``mappings`` says what was read as what, several where passages were misread
    in several ways (null where nothing could be restored), ``damaged`` whether garbled characters remain (replacement or
    control characters), ``restored`` is the text with all restorable words
    replaced. Null, empty and ASCII texts are sound; repeated rows of a document
    count once in the result (in the pair counts every row counts); rows with a
    null id are ignored; an empty table gives no rows; other columns are ignored.
    """
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    scores = rows.sparkSession.sparkContext.broadcast(pair_scores(pair_counts(rows.select("text"))))

    def run(batches):
        restorer = Restorer(scores.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in by_chars(texts):
                found = restorer.restore(texts[lo:hi])
                if found:
                    restored, mappings, damaged = zip(*found.values())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[lo + i] for i in found], pa.int64()), pa.array(mappings, pa.string()), pa.array(damaged), pa.array(restored)],
                        names=["doc_id", "mappings", "damaged", "restored"],
                    )

    return rows.mapInArrow(run, "doc_id long, mappings string, damaged boolean, restored string").dropDuplicates(["doc_id"])
