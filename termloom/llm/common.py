"""Shared helpers: working storage, table access and bounded collection."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-JVM local session may run without the setting; it then gets
    a temporary folder.  A cluster session without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    master = context.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="termloom-"))
    return context.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"


_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Deletes the tables that ``materialize`` writes inside, at the end, also
    after an error; the function it gives marks those that stay because a
    result reads them."""
    made: list[DataFrame] = []
    stay: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        stay.append(df._termloom_path)
        return df

    _OPEN.append(made)
    try:
        yield kept
    finally:
        _OPEN.pop()
        for df in made:
            if df._termloom_path not in stay:
                discard(df)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts lineage.

    The files outlive any executor, so a later task never recomputes what
    stands above them.  Inside ``scratch`` they go with it.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._termloom_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote."""
    path = getattr(df, "_termloom_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
