"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # long texts must not make large batches: both sides hold a batch or two per task
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # stream state outgrows executor heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

BUILD_CONF = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "starlens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**BUILD_CONF, **RUNTIME_CONF, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting (tests, a laptop) gets a temporary one; a cluster
    session without it is refused, since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
        if folder:
            return folder
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="starlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so every later use reads the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/starlens/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: later jobs don't compute it again, and its shuffles are gone.

    A caller that removes it gives a ``path`` of ``work_path``.
    """
    spark = df.sparkSession
    path = path or work_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _lead_workers(spark: SparkSession) -> None:
    """Workers find this package where the driver found it, if it isn't installed."""
    environment = spark.sparkContext.environment
    found = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in found:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *found] if x)


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers find this package, and keep no free Arrow memory between tasks."""
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    _lead_workers(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_column(function: Callable, returns: str, *columns: Column) -> Column:
    """A column that ``function`` makes from Arrow arrays; its workers find this package."""
    _lead_workers(SparkSession.active())
    return F.arrow_udf(function, returns)(*columns)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    java_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java_path.getFileSystem(spark._jsc.hadoopConfiguration()), java_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, java_path = file_system(spark, path)
    return fs.exists(java_path)


def remove(spark: SparkSession, path: str) -> None:
    fs, java_path = file_system(spark, path)
    fs.delete(java_path, True)


def remove_work(spark: SparkSession) -> None:
    """Remove all that ``work_path`` handed out to this application; call it when results are stored."""
    fs, java_path = file_system(spark, _work_folder(spark))
    fs.delete(java_path, True)
