"""Checks of single values: origins, queries, command lines, serialized numbers, object shapes."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = r"^https?://[^/@:?#\s\\]+(:\d{1,5})?$"
#: Largest code point counts of API fields, on the untrimmed text.
SHORT_FIELD, LONG_FIELD = 128, 4096


def is_origin(value: Column) -> Column:
    """Scheme and host with an optional port, without credentials, path, query or fragment; false for null."""
    return F.coalesce(value.rlike(ORIGIN), F.lit(False))


def origin_of(url: Column) -> Column:
    """The origin part of an address; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/@:?#\s\\]+(?::\d{1,5})?)(?:[/?#]|$)", 1), F.lit(""))


def is_field(value: Column, most: int = LONG_FIELD) -> Column:
    """Not blank and at most ``most`` code points before trimming; false for null."""
    return F.coalesce((F.trim(value) != "") & (F.length(value) <= most), F.lit(False))


def holds_lines(text: Column, command: Column) -> Column:
    """Whether the command's lines stand in the text as whole lines, one after the other (outer blanks ignored)."""

    def plain(value: Column) -> Column:
        lines = F.transform(F.split(F.replace(value, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
        return F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))

    return F.coalesce((F.trim(command) != "") & F.contains(plain(text), plain(command)), F.lit(False))


def require_count(k: object) -> None:
    """ValueError unless ``k`` is a positive integer (a bool is none)."""
    if type(k) is not int or k < 1:
        raise ValueError("k must be a positive integer")


def validate_query(question: object, k: object) -> None:
    """ValueError unless the question is non-blank text without NUL that encodes, and ``k`` a positive integer."""
    require_count(k)
    if not isinstance(question, str) or not question.strip() or "\0" in question:
        raise ValueError("the question must be text")
    question.encode("utf-8")


def same_float(a: float, b: float) -> bool:
    """Equal bit by bit, so that 0.0 and -0.0 differ."""
    return struct.pack("<d", a) == struct.pack("<d", b)


def has_shape(raw: str, shape: dict[str, type | tuple[type, ...]]) -> bool:
    """Whether a JSON object has exactly these keys with these types (a bool is no number)."""
    try:
        data = json.loads(raw)
    except ValueError:
        return False
    if not isinstance(data, dict) or data.keys() != shape.keys():
        return False

    def fits(value, kinds):
        kinds = kinds if isinstance(kinds, tuple) else (kinds,)
        return isinstance(value, kinds) and (bool in kinds or not isinstance(value, bool))

    return all(fits(data[k], kinds) for k, kinds in shape.items())


def cpu_identity(text: str, allowed: tuple[str, ...]) -> list[dict[str, object]]:
    """Allowed keys of each processor block of ``key : value`` lines; flags become a sorted list."""
    out = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        pairs = (line.partition(":") for line in block.splitlines() if ":" in line)
        found = {k.strip(): v.strip() for k, _, v in pairs if k.strip() in allowed}
        if found:
            out.append(found | ({"flags": sorted(found["flags"].split())} if "flags" in found else {}))
    return out
