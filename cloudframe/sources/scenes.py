"""Scenes: cameras.json with one folder of npy arrays a view, and reports as JSON."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.schemas import CAMERAS, LABELS
from cloudframe.sources.store import write_contents

METADATA = (
    "scene_id string, coordinate_frame string, depth_unit string, mask_labels map<string,int>, views array<struct<camera_id: string, width: int, height: int, timestamp: string, "
    "intrinsics: struct<fx: double, fy: double, cx: double, cy: double>, extrinsics: struct<camera_to_world: array<array<double>>>, files: struct<rgb: string, depth: string, mask: string>>>"
)
PLANES = "view_idx int, v int, u int, depth float, label smallint, r smallint, g smallint, b smallint"


def read_metadata(spark: SparkSession, scene_dir: str) -> DataFrame:
    """scene_id, coordinate_frame, depth_unit, mask_labels, views of a scene."""
    return spark.read.schema(METADATA).json(f"{scene_dir}/cameras.json", multiLine=True)


def read_scene(spark: SparkSession, scene_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, cameras) of a scene; the order of its views is view_idx.

    A camera_to_world that isn't 4x4, or arrays that don't have the camera's size, are errors.
    """
    views = read_metadata(spark, scene_dir).select("scene_id", F.posexplode("views").alias("view_idx", "view"))
    m = F.col("view.extrinsics.camera_to_world")
    square = (F.size(m) == 4) & F.forall(m, lambda row: F.size(row) == 4)
    checked = F.when(square, m).otherwise(F.raise_error(F.concat(F.lit("camera_to_world must be 4x4 for "), F.col("view.camera_id"))))
    views = views.withColumn("m", checked)
    pose = [F.col("m")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [F.col("m")[i][3].alias(c) for i, c in enumerate(("tx", "ty", "tz"))]
    numbers = [F.col(f"view.intrinsics.{c}").alias(c) for c in ("fx", "fy", "cx", "cy")]
    cameras = views.select("scene_id", "view_idx", "view.camera_id", "view.width", "view.height", *numbers, *pose, F.coalesce("view.timestamp", F.lit("")).alias("timestamp"))

    sizes = views.select("view_idx", "view.width", "view.height", "view.files")
    planes = F.explode(F.array(*(F.struct(F.lit(k).alias("plane"), F.col(f"files.{k}").alias("file")) for k in ("depth", "mask", "rgb"))))
    listed = sizes.select("view_idx", "width", "height", planes.alias("f")).select("view_idx", "width", "height", "f.plane", "f.file")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(scene_dir)
    content = content.select(F.substring_index("path", "/", -3).alias("tail"), "content")
    found = listed.join(content, F.substring_index("file", "/", -3) == F.col("tail"))
    views_of_planes = found.groupBy("view_idx", "width", "height").pivot("plane", ["depth", "mask", "rgb"]).agg(F.first("content"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, width, height, *files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                depth, mask, rgb = (np.load(io.BytesIO(f), allow_pickle=False) for f in files)
                if depth.shape != (height, width) or mask.shape != (height, width) or rgb.shape != (height, width, 3):
                    raise ValueError(f"view {view}: arrays don't have the size {height} x {width}")
                v, u = np.divmod(np.arange(width * height, dtype=np.int32), np.int32(width))
                columns = [np.full(width * height, view, np.int32), v, u, depth.ravel().astype(np.float32), mask.ravel().astype(np.int16), *rgb.reshape(-1, 3).T.astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["view_idx", "v", "u", "depth", "label", "r", "g", "b"])

    pixels = views_of_planes.mapInArrow(unpack, PLANES)
    return pixels, cameras


def view_files(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """path (within the scene's folder) and content of the npy files of every view, made in tasks from one pass over the pixels.

    A view is one image, which bounds what a task holds.
    """
    sized = cameras.select("view_idx", "camera_id", "width", "height")
    rows = sized.join(pixels.select("view_idx", "v", "u", "depth", "label", "r", "g", "b"), "view_idx", "left")

    def files(table: pa.Table) -> pa.Table:
        camera, width, height = (table[c][0].as_py() for c in ("camera_id", "width", "height"))
        table = table.filter(table["v"].is_valid())
        at = table["v"].to_numpy(), table["u"].to_numpy()
        depth, mask, rgb = np.zeros((height, width), np.float32), np.zeros((height, width), np.uint8), np.zeros((height, width, 3), np.uint8)
        depth[at], mask[at] = table["depth"].to_numpy(), table["label"].to_numpy()
        rgb[at] = np.stack([table[c].to_numpy() for c in "rgb"], axis=1)
        out = []
        for plane in (depth, mask, rgb):
            buffer = io.BytesIO()
            np.save(buffer, plane)
            out.append(buffer.getvalue())
        return pa.table({"path": [f"frames/{camera}/{name}.npy" for name in ("depth", "mask", "rgb")], "content": pa.array(out, pa.binary())})

    return rows.groupBy("view_idx").applyInArrow(files, "path string, content binary")


def write_scene(pixels: DataFrame, cameras: DataFrame, scene_dir: str, overwrite: bool = False) -> None:
    """Write a scene's files; a scene that is there stays unless overwrite.

    The tasks make and store the views' files; the driver writes cameras.json, a few hundred bytes a view.
    """
    target = os.path.join(scene_dir, "cameras.json")
    if os.path.exists(target) and not overwrite:
        return
    write_contents(view_files(pixels, cameras), scene_dir)
    views = []
    rows = cameras.select(*CAMERAS.fieldNames()).orderBy("view_idx").collect()
    for cam in rows:
        folder = f"frames/{cam['camera_id']}"
        matrix = [[cam[f"r{i}{j}"] for j in range(3)] + [cam[t]] for i, t in enumerate(("tx", "ty", "tz"))] + [[0.0, 0.0, 0.0, 1.0]]
        views.append({
            "camera_id": cam["camera_id"], "width": cam["width"], "height": cam["height"], "timestamp": cam["timestamp"], "intrinsics": {k: cam[k] for k in ("fx", "fy", "cx", "cy")},
            "extrinsics": {"camera_to_world": matrix}, "files": {k: f"{folder}/{k}.npy" for k in ("rgb", "depth", "mask")},
        })
    metadata = {"scene_id": rows[0]["scene_id"] if rows else "", "coordinate_frame": "world", "depth_unit": "meter", "mask_labels": LABELS, "views": views}
    os.makedirs(scene_dir, exist_ok=True)
    write_json(metadata, target)


def write_json(value: dict | DataFrame, path: str) -> None:
    """A report of one row, or a dict, as indented JSON with a newline at the end; other scripts' letters are kept."""
    if isinstance(value, DataFrame):
        value = json.loads(value.toJSON().first())
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False) + "\n")
