"""Session defaults and the few runtime services the operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Setting under which the shuffle files of a finished query are deleted at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[str, str]] = []


def get_spark(app: str = "docloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that runs on
    this machine alone gets a folder of its own where the setting is missing; any
    other refuses to run.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "docloom-checkpoint"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    What was shuffled for the table is deleted once it is written: nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


_remembered: dict[tuple, DataFrame] = {}


def remembered(spark: SparkSession, name: tuple, make) -> DataFrame:
    """A small table that is written once per application, under a name; ``release`` forgets it."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _remembered:
        _remembered[key] = materialize(make())
    return _remembered[key]


def release(spark: SparkSession) -> int:
    """Delete the tables this application has written with ``materialize``; results that read them end with it."""
    jvm, done = spark.sparkContext._jvm, 0
    for key in [k for k in _remembered if k[0] == spark.sparkContext.applicationId]:
        del _remembered[key]
    for item in [x for x in _written if x[0] == spark.sparkContext.applicationId]:
        path = jvm.org.apache.hadoop.fs.Path(item[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(item)
        done += 1
    return done


def parallelism(spark: SparkSession) -> int:
    """Partitions for an exchange whose consumer is a Python stage."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer tasks than there are; otherwise as it is, without an exchange."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docloom-code-")  # served by the driver to the end of the application
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{root.name}-code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
