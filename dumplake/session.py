"""Session defaults for local runs and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_MIN_SPLITS = "spark.sql.files.minPartitionNum"


def local_session(cpus: int = 8, app: str = "dumplake", memory: str = "12g", **conf) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_split_plan(spark: SparkSession) -> None:
    """Fix the number of file splits for this session.

    The statement scan reads its input twice and joins the two reads on the split
    offsets. Spark derives the split size from the cores it sees at planning time, which
    move under dynamic allocation; naming the minimum makes both reads split alike.
    """
    if spark.conf.get(_MIN_SPLITS, None) is None:
        spark.conf.set(_MIN_SPLITS, str(spark.sparkContext.defaultParallelism))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dumplake-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def _stage_root(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "dumplake-stage", spark.sparkContext.applicationId)


# A table is broadcast if its staged size is at most this many bytes.
BROADCAST_BYTES = 32 * 1024**2


def broadcast_within(df: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if Spark's own size of it (that of its files) is within ``most``, and whether it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return (F.broadcast(df), True) if size <= most else (df, False)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return a reader over it.

    Later readers get column pruning and partition pruning, and an executor loss never
    repeats the work behind the table.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    # With few partitions, open writers side by side instead of sorting every task's rows.
    before = spark.conf.get(_WRITERS, "0")
    spark.conf.set(_WRITERS, "4" if partition_by else before)
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)
    return spark.read.schema(df.schema).parquet(path)


_scope: ContextVar[list[str] | None] = ContextVar("stage_scope", default=None)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for sinks that write other formats."""
    path = os.path.join(_stage_root(spark), f"{name}-{uuid.uuid4().hex}")
    if (made := _scope.get()) is not None:
        made.append(path)
    return path


@contextmanager
def stage_scope(spark: SparkSession):
    """Delete at the end what was staged inside, as after a batch of a stream."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stage(spark: SparkSession) -> bool:
    """Delete everything this application staged."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions started without it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_dumplake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="dumplake-package-"), "dumplake_package.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                bundle.write(full, os.path.join("dumplake", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._dumplake_shipped = True
