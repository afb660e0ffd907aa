"""Document snapshots: strict JSON, JDBC views, and hashed files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.checks import has_shape
from docloom.functions.identity import canonical_json

DOCUMENT = (
    "page_id long, locale string, path string, title string, source_url string, updated_at string, markdown string, content_sha256 string"
)
COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]


def strict_json(raw: bytes):
    """Parse UTF-8 JSON without repeated keys, NaN or infinity (ValueError otherwise)."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    return json.loads(raw.decode("utf-8"), object_pairs_hook=once, parse_constant=refuse)


def read_json_snapshot(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Documents of snapshot files ``{schema_version, source, documents: [...]}``, with their ``source``.

    ``strict`` checks every file for repeated keys, non-finite numbers and bad
    UTF-8, which Spark's own reader would accept; a bad file fails the read.
    """
    rows = spark.read.schema(f"schema_version int, source string, documents array<struct<{DOCUMENT.replace(' ', ':')}>>".replace(",:", ", "))
    if strict:
        def check(batches):
            for pdf in batches:
                for content in pdf["content"]:
                    strict_json(bytes(content))
                yield pdf[["path"]]

        spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(check, "path string").count()
    return rows.json(path, multiLine=True).select("source", F.explode("documents").alias("d")).select("source", "d.*")


VIEW_COLUMNS = ("page_id", "locale", "path", "title", "markdown", "updated_at")


def read_jdbc_view(
    spark: SparkSession,
    url: str,
    view: str,
    properties: dict[str, str] | None = None,
    partition_by: str = "page_id",
    bounds: tuple[int, int, int] | None = None,
    timeout_s: int = 60,
    quoted_columns: bool = False,
) -> DataFrame:
    """The fixed columns of a database view; ``bounds`` (least, most, parts) reads it in parallel ranges.

    Statements end after ``timeout_s``, connections are opened read-only where the
    driver has such a property, and a part that fails fails the whole read.
    ``quoted_columns``: names are case-sensitive in the database.
    """

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    columns = ", ".join(map(quoted, VIEW_COLUMNS) if quoted_columns else VIEW_COLUMNS)
    query = f"(select {columns} from {'.'.join(map(quoted, view.split('.')))}) v"
    options = {"readOnly": "true", **(properties or {}), "queryTimeout": str(timeout_s)}
    if bounds:
        options |= dict(zip(("lowerBound", "upperBound", "numPartitions"), map(str, bounds))) | {"partitionColumn": partition_by}
    return spark.read.format("jdbc").options(url=url, dbtable=query, **options).load()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line)`` of text files."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def strict_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, strict)``: whether each text is JSON without repeated keys, NaN or infinity; false for null."""

    def strict(raw: str | None) -> bool:
        try:
            strict_json((raw or "").encode("utf-8"))
        except ValueError:
            return False
        return True

    return _judged(rows, key, text, "strict", strict)


def shaped_lines(rows: DataFrame, key: str, text: str, shape: dict) -> DataFrame:
    """``(key, fits)``: whether each text is a JSON object with exactly these keys of these types; false for null."""
    return _judged(rows, key, text, "fits", lambda raw: has_shape(raw or "", shape))


def _judged(rows: DataFrame, key: str, text: str, name: str, judge) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = pa.array([judge(raw) for raw in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, name])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {name} boolean")


CHUNK = (
    "chunk_id string, source string, page_id long, ordinal int, heading_path array<string>,"
    " segments array<struct<kind string, start int, end int, role string, text string, reason string>>,"
    " source_ranges array<struct<start int, end int>>, search_text string, body_tokens int, input_tokens int, structure string"
)


def write_chunk_output(chunks: DataFrame, path: str) -> None:
    """Chunks as canonical JSON, one object a line: equal chunks give equal bytes, ordered by id within each file."""
    columns = chunks.columns

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical_json(row) for row in batch.to_pylist()], pa.string())], names=["value"])

    chunks.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").select(*columns).mapInArrow(run, "value string").write.text(path)


def read_chunk_output(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines with the columns of CHUNK; a line that is not strict JSON, or has other keys, fails the read."""
    wanted = {c.split()[0] for c in CHUNK.replace("struct<start int, end int>", "x").replace("struct<kind string, start int, end int, role string, text string, reason string>", "x").split(", ")}

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if (data := strict_json(raw.encode("utf-8"))).keys() != wanted:
                    raise ValueError(f"other keys than a chunk's: {sorted(data.keys() ^ wanted)}")
            yield batch

    lines = spark.read.text(path).mapInArrow(run, "value string")
    return lines.select(F.from_json("value", CHUNK, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def write_json_snapshot(documents: DataFrame, path: str, schema_version: int = 1) -> None:
    """A file with one object ``{schema_version, source, documents}`` per source, documents ordered by page; read_json_snapshot reads the folder.

    A snapshot file holds all pages of one source by definition, so a source is one group here. Where
    the groups fall doesn't matter: a file ends after one row. Without documents there are no files.
    """
    fields = F.struct(*(F.col(c) for c in COLUMNS))
    grouped = documents.groupBy("source").agg(F.array_sort(F.collect_list(fields)).alias("documents"))
    line = F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), "source", "documents"), {"ignoreNullFields": "false"})
    grouped.select(line.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    _drop_empty_files(documents.sparkSession, path)


def _drop_empty_files(spark: SparkSession, path: str) -> None:
    """Spark writes a file for the first partition even if it has no rows."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in fs.listStatus(folder):
        if file.isFile() and not file.getLen() and file.getPath().getName().startswith("part-"):
            fs.delete(file.getPath(), False)


def missing_files(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """``(path, difference)`` of a stated list ``(path, sha256)`` against file_digests: missing, other or unexpected files."""
    both = expected.select("path", F.col("sha256").alias("want")).join(digests.select("path", F.col("sha256").alias("have")), "path", "full")
    kind = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "other")
    return both.select("path", kind.alias("difference")).where("difference is not null")
