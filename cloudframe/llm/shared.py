"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to a Python worker, whatever the texts' lengths.
ARROW_BATCH_BYTES = 16 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """Limit what a Python worker gets at once by bytes, so very long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir.

    Only a local[...] session, as in tests, may go without that setting; it gets a
    temporary folder. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return it as read from there.

    This cuts the lineage, survives lost executors, and lets Spark know the size of what
    it joins next. discard() deletes the table; else it goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for table in tables:
        drop_path(table.sparkSession, table._shared_path)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of `taken` has it (in any case of letters)."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df, without those of the names `but` in any case of letters; names may hold dots."""
    lower = {c.lower() for c in but}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in lower]


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast df if its counted rows are at most so many; else the join shuffles it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of materialize(), if the session still runs."""
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  the session has ended; its scratch folder goes with it
        pass


def fingerprint(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string, 128 bits together."""
    return F.xxhash64(text), F.xxhash64(F.lit(7919), text)


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone, the same in any SQL engine with md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))
