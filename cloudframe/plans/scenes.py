"""Many scenes in one job: tables of scenes, and their reconstruction scene by scene without a loop.

python -m cloudframe.plans.scenes --tables DIR --output-dir DIR [--voxel-size-m 0.003] [--hand-side right]

A scene's rows are found by scene_id. Tables are Parquet, partitioned by scene (pixels also by
view), so that a scene or a view is read alone, and replaced alone.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.functions.transforms import NAMES
from cloudframe.functions.vectors import rounded
from cloudframe.operators.depth import per_view_stats, world_points
from cloudframe.operators.hands import finished_rows, intrinsics, meta_row, placed_joints
from cloudframe.operators.points import validate_points, with_voxel_keys
from cloudframe.operators.reports import pose_struct, quality_columns
from cloudframe.operators.tables import broadcast_if_few, discard, written
from cloudframe.schemas import LABELS

SCENE, VIEW = "scene_id", ("scene_id", "view_idx")
MODES = ("error", "append", "overwrite", "replace")


def write_scene_tables(pixels: DataFrame, cameras: DataFrame, folder: str, mode: str = "error") -> None:
    """pixels and cameras of any number of scenes as the tables `pixels` and `cameras` of the folder.

    error: nothing may be there; append: beside what is there; overwrite: instead of all of it;
    replace: instead of the views, and the scenes' cameras, that come, and of no other. A view's
    pixels become one file, but for views of more than ten million pixels.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    kept = pixels.repartition(*VIEW).sortWithinPartitions(*VIEW, "v", "u")
    for name, table, keys in (("pixels", kept, VIEW), ("cameras", cameras.repartition(SCENE), (SCENE,))):
        writer = table.write.partitionBy(*keys).option("maxRecordsPerFile", 10_000_000).mode("overwrite" if mode == "replace" else mode)
        writer = writer.option("partitionOverwriteMode", "dynamic" if mode == "replace" else "static")
        writer.parquet(f"{folder}/{name}")


def read_scene_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, cameras) of write_scene_tables(); filters on scene_id and view_idx skip other scenes' files."""
    kinds = {"pixels": "v int, u int, depth float, label smallint, r smallint, g smallint, b smallint, scene_id string, view_idx int"}
    pixels = spark.read.schema(kinds["pixels"]).parquet(f"{folder}/pixels")
    cameras = spark.read.parquet(f"{folder}/cameras")
    return pixels, cameras.withColumn(SCENE, F.col(SCENE).cast("string"))


@dataclass
class Scenes:
    """Tables of all scenes by scene_id: voxels, stats (a row a view), poses, quality, hands and meta (a row a scene)."""

    voxels: DataFrame
    stats: DataFrame
    poses: DataFrame
    quality: DataFrame
    hands: DataFrame
    meta: DataFrame

    def release(self) -> None:
        discard(self.voxels)


def boxes(voxels: DataFrame) -> DataFrame:
    """scene_id and the structs fused, hand, object: point_count, n (points behind the voxels), low, high and centre of each.

    One aggregation for all three; what a scene doesn't have is null.
    """
    kind = F.when(F.col("all_labels") == 1, "fused").when(F.col("label") == LABELS["hand"], "hand").when(F.col("label") == LABELS["object"], "object")
    sides = [F.array(*(f(c) for c in "xyz")).alias(name) for name, f in (("low", F.min), ("high", F.max), ("centre", F.avg))]
    each = voxels.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(SCENE, "kind").agg(F.count("*").alias("point_count"), F.sum("n").alias("n"), *sides)
    box = F.struct("point_count", "n", "low", "high", "centre")
    return each.groupBy(SCENE).agg(*(F.max(F.when(F.col("kind") == k, box)).alias(k) for k in ("fused", "hand", "object")))


def scene_voxels(pixels: DataFrame, cameras: DataFrame, voxel_size: float) -> DataFrame:
    """scene_id, kx, ky, kz, label, all_labels, x, y, z, n: each scene on a grid of its own, for all points and for each label."""
    points = world_points(pixels.select(*VIEW, "u", "v", "depth", "label"), cameras, keys=VIEW)
    keyed = with_voxel_keys(validate_points(points), voxel_size)
    cell = [SCENE, "kx", "ky", "kz"]
    sets = keyed.groupingSets([cell, [*cell, "label"]], *cell, "label")
    return sets.agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"), F.grouping("label").alias("all_labels"))


def reconstruct_scenes(pixels: DataFrame, cameras: DataFrame, voxel_size: float = 0.003, is_right: bool = True, frame_index: int = 0) -> Scenes:
    """All scenes of the tables at once; each comes out as reconstruct() gives it alone.

    A scene is a row of cameras at least; one without pixels, hand or object has its reports too. The
    voxels are written as a table, which the reports read once, until release().
    """
    voxels = written(scene_voxels(pixels, cameras, voxel_size))
    stats = per_view_stats(pixels, cameras, keys=VIEW).join(cameras.select(*VIEW, "camera_id"), list(VIEW))
    first = cameras.groupBy(SCENE).agg(
        F.max(F.when(F.col("view_idx") == 0, F.struct(*NAMES, "fx", "fy", "cx", "cy"))).alias("camera"), F.max(F.when(F.col("view_idx") == 1, F.struct("tx", "ty", "tz"))).alias("second")
    )
    views = stats.groupBy(SCENE).agg(
        F.count("*").alias("view_count"), F.count_if(F.col("depth_valid_ratio") >= 0.01).alias("good"), F.coalesce(F.avg("depth_valid_ratio"), F.lit(0.0)).alias("mean_ratio"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera_id", rounded("depth_valid_ratio", 6).alias("ratio"))))).alias("per_view"),
    )
    told = first.join(views, SCENE).join(broadcast_if_few(boxes(voxels)), SCENE, "left")
    hand, other = pose_struct(F.col("hand"), "hand", "hand_0"), pose_struct(F.col("object"), "object", "object_0")
    told = told.withColumns({"hand_pose": hand, "object_pose": other})
    both = (F.col("hand_pose.status") == "ok") & (F.col("object_pose.status") == "ok")
    poses = told.select(F.when(both, "ok").otherwise("partial").alias("status"), SCENE, F.lit("world").alias("coordinate_frame"), F.lit("").alias("timestamp"), F.array("hand_pose").alias("hands"), F.array("object_pose").alias("objects"))
    counts = {f"n_{k}": F.coalesce(F.col(f"{k}.point_count"), F.lit(0)) for k in ("fused", "hand", "object")}
    extent = F.coalesce(F.zip_with("fused.high", "fused.low", lambda a, b: rounded(a - b)), F.array(*[F.lit(0.0)] * 3))
    known = told.withColumns(counts | {"extent": extent, "n_raw": F.coalesce(F.col("fused.n"), F.lit(0)), "sure": (F.col("hand_pose.confidence") + F.col("object_pose.confidence")) / 2})
    quality = quality_columns(known, F.col(SCENE))
    joints = placed_joints(told.select(SCENE, F.coalesce("hand.point_count", F.lit(0)).alias("point_count"), "hand.low", "hand.high", "hand.centre", "camera"))
    rows = finished_rows(joints, frame_index, is_right, scene_id=F.col(SCENE), keep=(SCENE,))
    gap: Column = sum(((F.col(f"second.{c}") - F.col(f"camera.{c}")) ** 2 for c in ("tx", "ty", "tz")), F.lit(0.0))
    meta = told.select(SCENE, F.coalesce(F.sqrt(gap), F.lit(0.0)).alias("baseline_m"), F.when(F.col("camera").isNotNull(), intrinsics("camera.")).alias("k"))
    return Scenes(voxels, stats, poses, quality, rows, meta_row(meta, is_right, keep=(SCENE,)))


def run(spark: SparkSession, tables: str, output_dir: str, voxel_size: float = 0.003, hand_side: str = "right") -> int:
    """Reconstruct all scenes of the tables; every result is a Parquet table of output_dir. Returns how many scenes didn't pass."""
    out = reconstruct_scenes(*read_scene_tables(spark, tables), voxel_size, hand_side == "right")
    try:
        for name in ("voxels", "stats", "poses", "quality", "hands", "meta"):
            getattr(out, name).write.mode("overwrite").parquet(f"{output_dir}/{name}")
    finally:
        out.release()
    return spark.read.parquet(f"{output_dir}/quality").where("NOT passed").count()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--tables", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--voxel-size-m", type=float, default=0.003)
    parser.add_argument("--hand-side", choices=("left", "right"), default="right")
    given = parser.parse_args(args)
    failed = run(SparkSession.builder.appName("scenes").getOrCreate(), given.tables, given.output_dir, given.voxel_size_m, given.hand_side)
    print(f"{failed} scenes didn't pass")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
