"""Shared scratch storage: the one place where intermediate results are cut off from their lineage.

Everything that has to survive the loss of an executor is written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``.  Only in local mode, where that setting may be absent, a folder
of our own is made and set; a cluster without it is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; read from the session, set only where unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="convolith-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
        _delete_at_exit(spark, found)
    return found.rstrip("/")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/convolith/{uuid.uuid4().hex}/{label}"
    _delete_at_exit(spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, parted by the columns ``by``, and read it back, so that its lineage ends in files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes inside is deleted at the end, and shuffle files of steps that are over are let go.

    Without the call for garbage these stay on disk until the driver happens to collect it.  No frame that
    was made inside may be read afterwards.
    """
    token = _MADE.set([])
    try:
        yield
    finally:
        for path in _MADE.get():
            delete_path(spark, path.rpartition("/")[0])
        _MADE.reset(token)
        spark.sparkContext._jvm.System.gc()


def table_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, used to prove a bound before anything is broadcast."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(stats.sizeInBytes().toString())


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_convolith_shipped", False):
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        work = Path(folder, "tree")
        shutil.copytree(here, work / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        made = tempfile.mkdtemp(prefix="convolith-ship-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        name = shutil.make_archive(str(Path(made, "convolith")), "zip", work)
    sc.addPyFile(name)
    sc._convolith_shipped = True
