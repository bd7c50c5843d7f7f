"""Scene to fused clouds, pose, quality and hand rows, with files as an option.

python -m cloudframe.plans.reconstruct --scene-dir DIR --output-dir DIR [--voxel-size-m 0.003] [--hand-side right] [--overwrite-mock-data]
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.operators.depth import per_view_stats, world_points
from cloudframe.operators.hands import hand_meta, hand_rows
from cloudframe.operators.points import voxels_by_label
from cloudframe.operators.reports import pose_output, quality
from cloudframe.operators.synth import mock_scene
from cloudframe.schemas import LABELS
from cloudframe.sources.clouds import write_ply
from cloudframe.sources.hands import write_hands
from cloudframe.sources.scenes import read_metadata, read_scene, write_json, write_scene


@dataclass
class Reconstruction:
    cameras: DataFrame
    fused: DataFrame
    hand: DataFrame
    other: DataFrame
    stats: DataFrame
    pose: DataFrame
    quality: DataFrame
    row: dict
    voxels: DataFrame

    def release(self) -> None:
        """Let go of the grids kept in memory, once the reports are written."""
        self.voxels.unpersist()

    @property
    def hands(self) -> DataFrame:
        return hand_rows(self.hand, self.cameras, **self.row)

    @property
    def meta(self) -> DataFrame:
        return hand_meta(self.cameras, self.row["is_right"])


def reconstruct(pixels: DataFrame, cameras: DataFrame, voxel_size: float = 0.003, scene_id: str = "", is_right: bool = True, frame_index: int = 0) -> Reconstruction:
    """One pass over the pixels gives the voxels of all points, of the hand and of the object.

    Reports work on voxel means. The fused grids are kept in memory for the reports, spilling
    to disk, until release().
    """
    points = world_points(pixels.select("view_idx", "u", "v", "depth", "label"), cameras)
    voxels = voxels_by_label(points.select("x", "y", "z", "label"), voxel_size).persist()
    fused = voxels.where("all_labels = 1").drop("label", "all_labels")
    hand, other = (voxels.where((F.col("all_labels") == 0) & (F.col("label") == LABELS[name])).drop("label", "all_labels") for name in ("hand", "object"))
    stats = per_view_stats(pixels, cameras).join(cameras.select("view_idx", "camera_id"), "view_idx")
    raw = int(fused.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    poses = pose_output(hand, other, scene_id)
    report = quality(stats, fused, raw, hand, other, poses, scene_id)
    return Reconstruction(cameras, fused, hand, other, stats, poses, report, {"frame_index": frame_index, "is_right": is_right, "scene_id": scene_id}, voxels)


def run(spark: SparkSession, scene_dir: str, output_dir: str, voxel_size: float = 0.003, hand_side: str = "right", overwrite: bool = False) -> dict:
    """The demo: make the mock scene if there is none, reconstruct, write files, return the summary."""
    if overwrite or not os.path.exists(os.path.join(scene_dir, "cameras.json")):
        write_scene(*mock_scene(spark), scene_dir, overwrite=True)
    pixels, cameras = read_scene(spark, scene_dir)
    scene_id = read_metadata(spark, scene_dir).first()["scene_id"]
    out = reconstruct(pixels, cameras, voxel_size, scene_id, hand_side == "right")
    os.makedirs(output_dir, exist_ok=True)
    names = {"fused_pointcloud": "fused.ply", "hand_pointcloud": "hand.ply", "object_pointcloud": "object.ply", "pose_output": "pose.json", "quality_report": "quality.json", "hands": "hands.npz", "summary": "summary.json"}
    paths = {k: os.path.join(output_dir, v) for k, v in names.items()}
    clouds = {"fused": out.fused, "hand": out.hand, "object": out.other}
    counts = {name: write_ply(cloud, paths[f"{name}_pointcloud"], ("kx", "ky", "kz")) for name, cloud in clouds.items()}
    write_json(out.pose, paths["pose_output"])
    write_json(out.quality, paths["quality_report"])
    write_hands(out.hands, out.meta, paths["hands"])
    passed = out.quality.first()["passed"]
    views = [json.loads(r) for r in out.stats.orderBy("view_idx").toJSON().collect()]
    summary = {
        "status": "ok" if passed else "failed", "scene_id": scene_id, "scene_dir": scene_dir, "output_dir": output_dir, "parameters": {"voxel_size_m": voxel_size, "hand_side": hand_side},
        "outputs": paths, "per_view_stats": views, "point_counts": counts, "passed": passed,
    }
    out.release()
    write_json(summary, paths["summary"])
    return summary


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--scene-dir", default="data/mock_scene")
    parser.add_argument("--output-dir", default="outputs/mock_scene")
    parser.add_argument("--voxel-size-m", type=float, default=0.003)
    parser.add_argument("--hand-side", choices=("left", "right"), default="right")
    parser.add_argument("--overwrite-mock-data", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("reconstruct").getOrCreate()
    summary = run(spark, given.scene_dir, given.output_dir, given.voxel_size_m, given.hand_side, given.overwrite_mock_data)
    print(json.dumps(summary, indent=2))
    return int(not summary["passed"])


if __name__ == "__main__":
    raise SystemExit(main())
