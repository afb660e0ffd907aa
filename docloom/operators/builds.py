"""Building and proving a whole index: documents, chunks, vectors and lexical tables of one generation."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.tokens import WORDS, WordTokens
from docloom.operators import chunking, lexical, models, validation
from docloom.sources import generations

#: Tables of a generation.
TABLES = ("documents", "chunks", "vectors", "terms", "metadata")
FORMAT_VERSION = 1


class BuildError(RuntimeError):
    """A candidate generation that may not be published."""


def index_fields(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, text)`` of what a keyword index reads of a chunk: its page's title, heading path and search text."""
    text = F.concat_ws("\n", "title", F.array_join("heading_path", " > "), "search_text")
    return chunks.join(documents.select("page_id", "title"), "page_id", "left").select(F.col("chunk_id").alias("id"), text.alias("text"))


def passages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(chunk_id, passage)``: what an encoder reads of a chunk."""
    text = F.concat(F.lit("passage: "), F.coalesce("title", F.lit("")), F.lit("\n"), F.array_join("heading_path", " > "), F.lit("\n"), "search_text")
    return chunks.join(documents.select("page_id", "title"), "page_id", "left").select("chunk_id", text.alias("passage"))


def identity(model: str, dim: int, tokens: WordTokens, version: str) -> dict[str, str]:
    """What vectors and chunks were made with; two indexes can only be joined if it is equal."""
    return {"model": model, "dimension": str(dim), "tokenizer": tokens.name, "chunking": version, "format": str(FORMAT_VERSION)}


def identity_differences(a: dict[str, str], b: dict[str, str]) -> dict[str, tuple[str | None, str | None]]:
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def semantic_table(chunks: DataFrame, documents: DataFrame, load: Callable) -> DataFrame:
    """``(chunk_id, vector)`` of every chunk."""
    return models.encode(passages(chunks, documents), "passage", load).select("chunk_id", "vector")


def table_fingerprint(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(rows, fingerprint)`` that does not depend on order; repeated rows count."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    halves = (F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16))
    return table.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *halves), 256).alias("fingerprint"))


def metadata(spark: SparkSession, about: dict[str, str], documents: int, chunks: int, when: dt.datetime) -> DataFrame:
    """The one row that says what a generation holds."""
    row = (FORMAT_VERSION, when.astimezone(dt.timezone.utc).isoformat(), documents, chunks, about)
    return spark.createDataFrame([row], "format_version int, indexed_at string, documents long, chunks long, identity map<string,string>")


def protect(root: str, *inputs: str) -> None:
    """BuildError if the output lies in an input or an input in the output (links resolved where the path is a local one)."""

    def plain(path: str) -> str:
        local = path.removeprefix("file://")
        return os.path.realpath(local) if "://" not in local else local.rstrip("/")

    out = plain(root)
    for path in map(plain, inputs):
        if f"{out}/".startswith(f"{path}/") or f"{path}/".startswith(f"{out}/"):
            raise BuildError(f"{root} and {path} overlap")


def rebuild(
    spark: SparkSession,
    root: str,
    documents: DataFrame,
    settings: DataFrame,
    load: Callable,
    about: dict[str, str],
    chunks: DataFrame | None = None,
    tokens: WordTokens = WORDS,
    when: dt.datetime | None = None,
) -> str:
    """Make every table of an index from documents, prove it, and publish it by one pointer change; returns its name.

    ``chunks`` are cut from the documents unless they are given. One build at a
    time works on ``root``. Tables are proved as they were written; if anything
    fails the generation before stays current and the candidate is removed.
    """
    with generations.builder_lock(spark, root):
        name = generations.new_name()

        def write(table: str, df: DataFrame) -> DataFrame:
            return generations.write(spark, root, name, table, df)

        try:
            own = write("documents", documents)
            made = chunks if chunks is not None else chunking.chunk_documents(own, settings, about.get("chunking", chunking.VERSIONS[0]), tokens)
            cut = write("chunks", made)
            if "error" in cut.columns and not (bad := cut.where("error is not null").limit(1)).isEmpty():
                raise BuildError(f"a page cannot be cut: {bad.first()['error']}")
            write("vectors", semantic_table(cut, own, load))
            write("terms", lexical.build_index(index_fields(cut, own)).documents)
            write("metadata", metadata(spark, about, own.count(), cut.count(), when or dt.datetime.now(dt.timezone.utc)))
            problems = index_violations(spark, f"{root}/{name}", int(about["dimension"]))
            if not problems.isEmpty():
                raise BuildError(f"candidate generation: {problems.first().asDict()}")
        except BaseException:
            generations.remove(spark, f"{root}/{name}")
            raise
        generations.point_to(spark, root, name)
    return name


def index_violations(spark: SparkSession, folder: str, dim: int) -> DataFrame:
    """``(key, rule)`` of everything in a generation's folder that does not fit together.

    Chunks and vectors must have the same ids, vectors be of unit length, the
    lexical table hold every chunk once with the terms of its own text, and the
    metadata row count what is there.
    """
    documents, chunks, vectors, terms, about = (spark.read.parquet(f"{folder}/{t}") for t in TABLES)
    counted = documents.agg(F.count("*").alias("d")).crossJoin(chunks.agg(F.count("*").alias("c")))  # single rows
    wrong = about.crossJoin(counted).where(f"documents <> d or chunks <> c or format_version <> {FORMAT_VERSION}")
    return validation._union(
        [
            validation.vector_violations(vectors, chunks, dim),
            lexical_violations(terms, index_fields(chunks, documents)),
            wrong.select(F.lit("metadata").alias("key"), F.lit("metadata_counts").alias("rule")),
        ]
    )


def lexical_violations(terms: DataFrame, fields: DataFrame) -> DataFrame:
    """``(key, rule)`` of a lexical table ``(id, terms)`` against the texts it should hold.

    ``terms_missing``: a text without a row; ``terms_unexpected``: a row without a
    text; ``terms_repeated``: an id with several rows; ``terms_content``: other
    postings than the text gives (order aside).
    """
    want = lexical.build_index(fields).documents.select("id", F.array_sort("terms").alias("want"))
    have = terms.groupBy("id").agg(F.count("*").alias("n"), F.min(F.array_sort("terms")).alias("have"))
    both = want.join(have, "id", "full")
    rule = (
        F.when(F.col("have").isNull(), "terms_missing")
        .when(F.col("want").isNull(), "terms_unexpected")
        .when(F.col("n") > 1, "terms_repeated")
        .when(~F.col("want").eqNullSafe(F.col("have")), "terms_content")
    )
    return both.select(F.col("id").cast("string").alias("key"), rule.alias("rule")).where("rule is not null")


def schema_differences(actual: StructType, expected: StructType) -> list[tuple[str, str]]:
    """``(column, difference)``: missing, unexpected, or of another type; the order of columns does not matter."""
    have, want = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (actual, expected))
    out = [(c, "missing") for c in want if c not in have] + [(c, "unexpected") for c in have if c not in want]
    return sorted(out + [(c, f"{have[c]} instead of {want[c]}") for c in want if c in have and have[c] != want[c]])


def index_status(spark: SparkSession, root: str) -> dict[str, object]:
    """State of the current generation (missing, invalid, ok) and, if it is ok, what its metadata says."""
    state = generations.status(spark, root, list(TABLES))
    if state != "ok":
        return {"state": state}
    row = generations.read(spark, root, "metadata").first()
    sound = row is not None and row["format_version"] == FORMAT_VERSION
    return {"state": "ok", **row.asDict()} if sound else {"state": "invalid"}
