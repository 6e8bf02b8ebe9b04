"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local master, which runs in one machine, takes a temporary
    one; a cluster can't know which folders it shares, so there it is an error."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="ionweave-")
    sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is put there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    for held in _open:
        held.append((spark, path))
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again: the lineage ends there, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


_open: list[list] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Folders made inside go at the end; results that read them must be complete by then."""
    held: list = []
    _open.append(held)
    try:
        yield
    finally:
        _open.remove(held)
        for spark, path in held:
            delete_folder(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """Few and small splits dealt to all cores, for steps that take much longer than reading; larger inputs have splits enough."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * (64 << 20) else df
