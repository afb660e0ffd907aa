"""Canonical JSON and the identities derived from it."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, no ASCII escapes, no NaN or infinity (ValueError)."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def range_id(source: str, page_id: int, start: int, end: int) -> str:
    return hashlib.sha256(f"{source}:{page_id}:{start}:{end}".encode()).hexdigest()


def pair_fingerprint(a: Column, b: Column) -> Column:
    """SHA-256 of the canonical JSON of two texts, in the JVM."""
    return F.sha2(F.encode(F.to_json(F.array(a, b)), "utf-8"), 256)
