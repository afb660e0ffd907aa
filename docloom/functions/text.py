"""Text expressions evaluated in the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTER_BLANKS = r"(?U)^\s+|\s+$"
#: Strict instant: date, T, time, optional fraction, Z or an offset of 00-23 hours and 00-59 minutes.
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
TERM = r"[\p{L}\p{N}\p{Co}]+"


def strip_lower(value: Column) -> Column:
    """Lower case without outer white space; null stays null."""
    return F.lower(F.regexp_replace(value, OUTER_BLANKS, ""))


def instant_micros(value: Column) -> Column:
    """Microseconds of an ISO-8601 instant with any offset; null where unreadable.

    A time without an offset is taken as UTC (the session's zone).
    """
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(value, OUTER_BLANKS, "")))


def utc_instant(value: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` of a strict instant; null where it isn't one."""
    return F.when(value.rlike(INSTANT), F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def digest(value: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex."""
    return F.sha2(F.encode(value, "utf-8"), 256)


def percent_encoded(value: Column, keep_slash: bool = False) -> Column:
    """RFC 3986 percent-encoding of everything but unreserved characters (and ``/`` if kept)."""
    out = F.url_encode(value)
    for quoted, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *([("%2F", "/")] if keep_slash else [])):
        out = F.replace(out, F.lit(quoted), F.lit(plain))
    return out


@functools.cache
def latin_folding() -> tuple[str, str]:
    """Latin lower-case letters with exactly one diacritic, and the letters they fold to.

    Letters with two marks, Cyrillic and other scripts keep theirs.
    """
    source, target = [], []
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower() and unicodedata.combining(parts[1]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def terms(value: Column) -> Column:
    """Keyword terms of a text: runs of letters, digits and private-use characters, case and Latin marks folded."""
    low = F.lower(value)
    folded = F.translate(F.regexp_replace(low, "[\\u0300-\\u036f]", ""), *latin_folding())
    # Most texts have nothing to fold, and looking for it costs far less than folding.
    plain = F.when(low.rlike("[\\u00df-\\u024f\\u0300-\\u036f\\u1e00-\\u1eff]"), folded).otherwise(low)
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


def code_point_slice(value: Column, start: Column, end: Column) -> Column:
    """Half-open ``[start, end)`` slice in code points."""
    return F.substring(value, start + 1, end - start)
