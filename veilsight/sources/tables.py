"""Stored tables: reading, spreading small ones over the cores, and writing results that are read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt out to all cores, as work per row may be heavy; a large one as its files lie.

    Decided from the plan's size estimate alone: no job is run. A file of one row group is one task, so
    only inputs with fewer split sizes than cores are dealt anew.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < split * cores else df


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_made: list[tuple[int, SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """Where executors share files: ``spark.checkpoint.dir``; locally, and there alone, a temporary folder will do."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        where = tempfile.mkdtemp(prefix="veilsight-")
        atexit.register(shutil.rmtree, where, True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back, so that later steps plan from a table and not from all before.

    The table goes with ``release``, or when the program ends.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append((threading.get_ident(), df.sparkSession, path))  # first, so that what a failed write leaves goes too
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``release``."""
    return len(_made)


def _remove(entries: list[tuple[int, SparkSession, str]]) -> None:
    for entry in entries:
        _made.remove(entry)
        _, spark, path = entry
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(mark: int = 0) -> None:
    """Removes the tables that this thread has written since the mark; what is read from them must be written elsewhere by then."""
    _remove([x for x in _made[mark:] if x[0] == threading.get_ident()])


def _sweep() -> None:
    try:
        _remove(list(_made))
    except Exception:  # the session has ended; the folder belongs to the cluster
        return


atexit.register(_sweep)
