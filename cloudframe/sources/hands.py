"""The normalized hand file (NPZ): rows of schemas.HANDS and one of schemas.HANDS_META a file."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudframe.schemas import HANDS, HANDS_META
from cloudframe.sources.clouds import npz_arrays
from cloudframe.sources.store import write_contents


def _plain(value: np.ndarray | None, row: int | None = None):
    if value is None:
        return None
    value = value if row is None else value[row]
    return value.tolist() if isinstance(value, np.ndarray) else value.item() if isinstance(value, np.generic) else value


def _parse(schema: T.StructType, by_row: bool):
    names = [f.name for f in schema.fields if f.name != "path"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                arrays = npz_arrays(bytes(content))
                n = len(arrays["frame_index"]) if by_row else 1
                rows = [{"path": path} | {c: k if c == "row_id" else _plain(arrays.get(c), k if by_row else None) for c in names} for k in range(n)]
                yield pd.DataFrame(rows, columns=["path", *names])

    return parse


def read_hands(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(hands, meta), each with the file's path. Fields that the file lacks, or that would need pickle, are null."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    path = T.StructType([T.StructField("path", T.StringType())])
    out = []
    for schema, by_row in ((HANDS, True), (HANDS_META, False)):
        full = T.StructType([*path.fields, *schema.fields])
        out.append(files.mapInPandas(_parse(schema, by_row), full))
    return out[0], out[1]


def clip_files(hands: DataFrame, meta: DataFrame, clip: str = "clip") -> DataFrame:
    """(path, content) of a compressed NPZ file for each clip, made in tasks, for store.write_contents().

    hands and meta have the column `clip`, which names the file; meta has one row a clip. A clip's rows,
    a few kilobytes each, meet in one task.
    """
    rows = hands.select(F.col(clip).cast("string").alias("clip"), F.struct(*HANDS.fieldNames()).alias("row"))
    once = meta.select(F.col(clip).cast("string").alias("clip"), F.struct(*HANDS_META.fieldNames()).alias("once"))

    def make(key: tuple[pa.Scalar], rows: pa.Table, once: pa.Table) -> pa.Table:
        if not rows.num_rows or not once.num_rows:
            return pa.table({"path": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
        entries = sorted((r["row"] for r in rows.select(["row"]).to_pylist()), key=lambda r: r["row_id"])
        about = once["once"][0].as_py()
        arrays = {f.name: np.array([e[f.name] for e in entries]) for f in HANDS.fields if f.name != "row_id"} | {f.name: np.array(about[f.name]) for f in HANDS_META.fields}
        buffer = io.BytesIO()
        np.savez_compressed(buffer, **arrays)
        return pa.table({"path": [f"{key[0].as_py()}.npz"], "content": pa.array([buffer.getvalue()], pa.binary())})

    return rows.groupBy("clip").cogroup(once.groupBy("clip")).applyInArrow(make, "path string, content binary")


def write_hands(hands: DataFrame, meta: DataFrame, path: str) -> None:
    """Write one clip's rows as the NPZ file at path, in the order of row_id, by a task. Texts are stored as unicode arrays, never as objects."""
    folder, _, name = path.rpartition("/")
    clip = F.lit(name.removesuffix(".npz"))
    write_contents(clip_files(hands.withColumn("clip", clip), meta.withColumn("clip", clip)), folder or ".")
