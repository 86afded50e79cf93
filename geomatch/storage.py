"""Intermediate tables that are read more than once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that the session names in ``spark.checkpoint.dir``.

    A cluster sets it to storage that all executors see; without it there is an error, as the machines
    have no place in common. Only a local session, where the driver is the one machine, gets the warehouse's
    folder instead. The folder belongs to the application: the driver removes it when it ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{top.rstrip('/')}/geomatch-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed(spark: SparkSession) -> AbstractContextManager[None]:
    """For jobs whose shuffles nothing reads once they are done: those go with the job, not when the driver collects garbage."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def write(df: DataFrame, path: str) -> None:
    with freed(df.sparkSession):
        df.write.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, dense: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, survives the loss of
    executors, and its size is known when Spark plans the joins on it. ``dense`` spends more time on packing long texts. A ``path``
    from :func:`scratch` lets the caller :func:`remove` the table."""
    spark = df.sparkSession
    path = path or scratch(spark)
    with _settings(spark, {"spark.sql.parquet.compression.codec": "zstd"} if dense else {}):
        write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove what lies at a path of :func:`scratch`, once no later job reads it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tasks_of(spark: SparkSession, rows: int, task_rows: int) -> int:
    """How many tasks rows are dealt to. Short texts take many times their shuffled bytes when they are sorted, so their number decides."""
    return max(rows // task_rows + 1, spark.sparkContext.defaultParallelism)
