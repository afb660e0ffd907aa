"""Whole generations of derived tables, published by one atomic pointer change.

A generation is a folder of Parquet tables that is complete before the pointer
file names it. Readers resolve the pointer once. The pointer is replaced by a
rename through Hadoop's file system, atomic where the file system's rename is
(local disks and HDFS; object stores need their own commit service).
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, LOCK = "CURRENT", "BUILDING"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, in one aggregation (map columns cannot be compared)."""
    keys = [F.struct(*a.columns).alias("row")]
    signed = a.select(*keys, F.lit(1).alias("n")).union(b.select(a.columns).select(*keys, F.lit(-1)))
    return signed.groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()


def new_name() -> str:
    return f"gen-{uuid.uuid4().hex}"


def write(spark: SparkSession, root: str, name: str, table: str, df: DataFrame) -> DataFrame:
    """Write one table of a generation that is not current yet, and read it back."""
    df.write.parquet(f"{root}/{name}/{table}")
    return spark.read.parquet(f"{root}/{name}/{table}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], verify: bool = True) -> str:
    """Write all tables as a new generation, compare what was written, then point to it; returns its name.

    On any failure the generation before stays current and the candidate is removed.
    """
    name = new_name()
    try:
        for table, df in tables.items():
            back = write(spark, root, name, table, df)
            if verify and not same_rows(df, back):
                raise ValueError(f"table {table} was not read back as written")
    except BaseException:
        remove(spark, f"{root}/{name}")
        raise
    point_to(spark, root, name)
    return name


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _fs(spark, path)
    fs.delete(hadoop.Path(path), True)


def point_to(spark: SparkSession, root: str, name: str) -> None:
    """Make a complete generation the current one, by one rename."""
    hadoop, fs = _fs(spark, root)
    draft = hadoop.Path(f"{root}/{POINTER}.{name}")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(hadoop.Path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, hadoop.Path(f"{root}/{POINTER}"), options)


@contextlib.contextmanager
def builder_lock(spark: SparkSession, root: str):
    """Held while a generation is built: a file that only one builder can create. A second builder gets a ValueError."""
    hadoop, fs = _fs(spark, root)
    path = hadoop.Path(f"{root}/{LOCK}")
    fs.mkdirs(hadoop.Path(root))
    if not fs.createNewFile(path):
        raise ValueError(f"another build works on {root}")
    try:
        yield
    finally:
        fs.delete(path, False)


def current(spark: SparkSession, root: str) -> str | None:
    """Name of the current generation, None if there is none."""
    hadoop, fs = _fs(spark, root)
    if not fs.exists(hadoop.Path(f"{root}/{POINTER}")):
        return None
    return spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0].strip()


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    name = current(spark, root)
    if name is None:
        raise ValueError(f"no generation is published in {root}")
    return spark.read.parquet(f"{root}/{name}/{table}")


def status(spark: SparkSession, root: str, required: list[str]) -> str:
    """missing, invalid (a required table cannot be read) or ok."""
    name = current(spark, root)
    if name is None:
        return "missing"
    hadoop, fs = _fs(spark, root)
    done = all(fs.exists(hadoop.Path(f"{root}/{name}/{t}/_SUCCESS")) for t in required)
    return "ok" if done else "invalid"
