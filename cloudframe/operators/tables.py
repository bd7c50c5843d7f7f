"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows at most of a table that is broadcast after it was counted.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local[...] session, as in tests, may go without and gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tables-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder: its lineage ends there, and lost executors take nothing with them.

    discard() deletes it; else it goes when the driver's Python ends.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for table in tables:
        _drop(table.sparkSession, table._path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session has ended; its scratch folder goes with it
        pass


def broadcast_if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it counts at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
