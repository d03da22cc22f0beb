"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share: ``spark.checkpoint.dir``.

    Only a local master, whose driver and executors are one machine, gets a temporary folder where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str, *by: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing before it.

    Rows that differ in ``by``, its last columns, lie in files of their own; ``options`` are the writer's.  The table is deleted when the driver ends,
    for results are read from it after a query has returned, or before by ``discard``.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).partitionBy(*by).parquet(path)
    _made[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the table that ``materialized`` made and that ``df`` reads; nothing may read it afterwards."""
    files = df.inputFiles()
    if files:
        path = next((p for p in _made if files[0].startswith(p) or p.removeprefix("file://") in files[0]), None)
        delete(df.sparkSession, path or files[0].rsplit("/", 1)[0])
        _made.pop(path, None)


@atexit.register
def sweep() -> None:
    """Deletes the tables that this driver made, as far as its gateway still answers."""
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone, and with it nothing is left to tell
            return
