"""Constraint queries: each returns its violations, and nothing for sound data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import INSTANT, OUTER_BLANKS, digest
from docloom.functions.vectors import doubles, is_finite, norm

# What a segment may be.
ROLES = ["text", "heading", "code", "table", "table_header", "table_row", "overlap"]
REASONS = ["fence", "table_header", "separator"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.regexp_replace(value, OUTER_BLANKS, "") == "")


def broken(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for every row and rule that does not hold (null counts as not holding), in one pass."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items())))
    return rows.select(key.cast("string").alias("key"), F.explode(failed).alias("rule"))


def duplicates(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """``(key, rule)`` for every key value (joined by ``|``) that more than one row carries."""
    return rows.groupBy(*keys).count().where("count > 1").select(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"), F.lit(rule).alias("rule"))


def document_violations(documents: DataFrame) -> DataFrame:
    """Blank fields, unreadable times, wrong digests, repeated ids and repeated places of ``documents``."""
    rules = {
        "page_id": F.col("page_id") >= 1,
        "locale": ~is_blank(F.col("locale")),
        "path": ~is_blank(F.col("path")),
        "title": ~is_blank(F.col("title")),
        "source_url": ~is_blank(F.col("source_url")),
        "updated_at": F.col("updated_at").rlike(INSTANT),
        "markdown": F.col("markdown").isNotNull(),
        "digest": F.lower("content_sha256") == digest(F.col("markdown")),
    }
    return _union(
        [
            broken(documents, F.col("page_id"), rules),
            duplicates(documents, ["page_id"], "repeated_id"),
            duplicates(documents, ["source", "locale", "path"], "repeated_place"),
        ]
    )


def chunk_violations(chunks: DataFrame, documents: DataFrame, settings: DataFrame) -> DataFrame:
    """Chunks without their document, segments out of bounds or of unknown kind, texts and ranges that
    are not those of the segments, token counts beyond their limits, ordinals with holes."""
    pages = documents.dropDuplicates(["page_id"]).select(
        "page_id", F.col("source").alias("page_source"), "markdown", F.length("markdown").alias("length"), F.lit(True).alias("exists")
    )
    limits = settings.select("source", "maximum", "input_limit")
    whole = chunks.join(pages, "page_id", "left").join(limits, "source", "left")
    segment_ok = F.expr(
        "forall(segments, s -> case s.kind when 'source' then s.start >= 0 and s.start < s.end and s.end <= length and array_contains(array({roles}), s.role)"
        " when 'generated' then s.text is not null and array_contains(array({reasons}), s.reason) else false end)".format(
            roles=", ".join(f"'{r}'" for r in ROLES), reasons=", ".join(f"'{r}'" for r in REASONS)
        )
    )
    text = F.expr(
        "array_join(transform(segments, s -> if(s.kind = 'source', substring(markdown, s.start + 1, s.end - s.start), s.text)), '')"
    )
    ranges = F.expr("transform(filter(segments, s -> s.kind = 'source'), s -> struct(s.start as start, s.end as end))")
    rules = {
        "document": F.col("exists") & (F.col("page_source") == F.col("source")),
        "segments": segment_ok,
        "search_text": F.col("search_text") == text,
        "source_ranges": ranges == F.col("source_ranges"),
        "body_budget": (F.col("body_tokens") >= 0) & (F.col("body_tokens") <= F.col("maximum")),
        "input_budget": (F.col("input_tokens") >= F.col("body_tokens")) & (F.col("input_tokens") <= F.col("input_limit")),
    }
    holes = (
        chunks.groupBy("source", "page_id")
        .agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count_distinct("ordinal").alias("n"))
        .where("a <> 0 or b <> n - 1")
        .select(F.concat_ws("|", "source", F.col("page_id").cast("string")).alias("key"), F.lit("ordinals").alias("rule"))
    )
    return _union([broken(whole, F.col("chunk_id"), rules), duplicates(chunks, ["chunk_id"], "repeated_id"), holes])


def vector_violations(vectors: DataFrame, chunk_ids: DataFrame, dim: int, tolerance: float = 1e-5) -> DataFrame:
    """Wrong lengths, numbers that aren't finite, norms other than one, and ids on one side only."""
    size_ok = F.coalesce(F.size("vector") == dim, F.lit(False))
    finite = F.when(size_ok, is_finite(F.col("vector"))).otherwise(True)
    unit = F.when(size_ok & is_finite(F.col("vector")), F.abs(norm(F.col("vector")) - 1) <= tolerance).otherwise(True)
    ids, have = chunk_ids.select("chunk_id").distinct(), vectors.select("chunk_id").distinct()
    return _union(
        [
            broken(vectors, F.col("chunk_id"), {"dimension": size_ok, "finite": finite, "unit": unit}),
            have.join(ids, "chunk_id", "left_anti").select("chunk_id", F.lit("no_chunk")),
            ids.join(have, "chunk_id", "left_anti").select("chunk_id", F.lit("no_vector")),
        ]
    )


def inventory_difference(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``(keys, difference)``: missing from actual, unexpected in it, or with other values (null-safe)."""
    e = expected.select(*keys, *(F.col(v).alias(f"e_{v}") for v in values), F.lit(1).alias("e"))
    a = actual.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("a"))
    same = reduce(lambda x, y: x & y, [F.col(f"e_{v}").eqNullSafe(F.col(f"a_{v}")) for v in values], F.lit(True))
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~same, "different")
    return e.join(a, keys, "full").select(*keys, kind.alias("difference")).where("difference is not null")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is not null and not in ``parent``."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def span_violations(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence spans whose page is absent, has another digest, or holds another text there."""
    pages = documents.dropDuplicates(["page_id"]).select("page_id", "markdown", F.lower("content_sha256").alias("sha"))
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("markdown"))
    same = F.substring(F.col("markdown"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("exact_text")
    kind = (
        F.when(F.col("sha").isNull(), "no_page")
        .when(~(F.lower("content_sha256") == F.col("sha")), "digest")
        .when(~F.coalesce(fits, F.lit(False)), "range")
        .when(~F.coalesce(same, F.lit(False)), "text")
    )
    return spans.join(pages, "page_id", "left").select("case_id", "page_id", "start", "end", kind.alias("rule")).where("rule is not null")


def reference_violations(cases: DataFrame) -> DataFrame:
    """Facts that name unknown evidence, evidence that no fact names, and lists with repeats."""
    named = F.flatten(F.transform("required_facts", lambda f: f.evidence_ids))
    known = F.transform("evidence", lambda e: e.id)
    rules = {
        "unknown_evidence": F.size(F.array_except(named, known)) == 0,
        "unused_evidence": F.size(F.array_except(known, named)) == 0,
        "repeated_evidence": F.size(F.array_distinct(known)) == F.size(known),
        "repeated_tags": F.size(F.array_distinct("tags")) == F.size("tags"),
    }
    return broken(cases, F.col("id"), rules)
