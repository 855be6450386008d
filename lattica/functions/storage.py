"""Tables and folders that all executors share, for cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master
    (tests), and an error on a cluster, whose executors could not read it."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can read and write")
    if not (kept := getattr(sc, "_lattica_shared", None)):
        kept = sc._lattica_shared = tempfile.mkdtemp(prefix="lattica-shared-")
        sc.setCheckpointDir(kept)
    return kept


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: cuts lineage and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Meanwhile, what a query has shuffled is deleted as it ends, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join with another large table: both are shuffled and merged, whatever Spark takes their sizes for.

    Left to itself, Spark goes by the bytes of compressed files, and would gather and broadcast through the driver what is many times as
    large in memory.
    """
    return df.hint("merge")


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing is to be read from it any more."""
    for file in df.inputFiles()[:1]:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def published(spark: SparkSession, draft: str, folder: str) -> None:
    """Gives a folder that has been written in full its name, in one step. One of that name must be empty, if there is any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path(folder)):
        if len(system.listStatus(path(folder))):
            raise FileExistsError(folder)
        system.delete(path(folder), False)
    if not system.rename(path(draft), path(folder)):
        raise OSError(f"{draft} could not be renamed to {folder}")


def discarded(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
