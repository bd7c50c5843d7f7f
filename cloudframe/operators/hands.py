"""Normalized hand rows from a hand's fused points and the scene's cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.hand_angles import landmarks, with_hand_angles
from cloudframe.functions.transforms import NAMES, applied_inverse
from cloudframe.operators.depth import baseline
from cloudframe.operators.points import bounding_box
from cloudframe.schemas import ANGLE_NAMES, HANDS, HANDS_META, JOINT_NAMES

JOINTS = len(JOINT_NAMES)


def _fill(value: str, n: int, kind: str) -> Column:
    return F.expr(f"cast(array_repeat({value}, {n}) as array<{kind}>)")


def intrinsics(camera: str = "") -> Column:
    """The 3x3 matrix of fx, fy, cx, cy."""
    fx, fy, cx, cy = (F.col(f"{camera}{n}") for n in ("fx", "fy", "cx", "cy"))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.array(fx, zero, cx), F.array(zero, fy, cy), F.array(zero, zero, one))


def landmarks_of(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, point_count and joints (array of 21 [x, y, z]) of each cloud; zeros for an empty one."""
    box = bounding_box(points, by)
    low, high, centre = ([F.col(f"{name}_{c}") for c in "xyz"] for name in ("min", "max", "centre"))
    joints = F.when(F.col("point_count") > 0, landmarks(low, high, centre)).otherwise(F.expr(f"array_repeat(array_repeat(0D, 3), {JOINTS})"))
    return box.select(*by, "point_count", joints.alias("joints"))


def hand_rows(points: DataFrame, cameras: DataFrame, frame_index: int = 0, is_right: bool = True, left_row: int = -1, right_row: int = -1, global_scale: float = 1.0, scene_id: str = "") -> DataFrame:
    """One row of schemas.HANDS: landmarks of the hand's points in the frame of view 0.

    Without points or without cameras the row is "invalid": zero joints and false masks.
    """
    first = cameras.where("view_idx = 0").select(F.struct(*NAMES).alias("camera")).limit(1)
    sides = [F.array(*(F.col(f"{name}_{c}") for c in "xyz")).alias(short) for name, short in (("min", "low"), ("max", "high"), ("centre", "centre"))]
    base = bounding_box(points).select("point_count", *sides).join(first, F.lit(True), "left")
    return finished_rows(placed_joints(base), frame_index, is_right, left_row, right_row, global_scale, F.lit(scene_id))


def placed_joints(base: DataFrame) -> DataFrame:
    """Rows of point_count, low, high, centre and camera with `ok` and the landmarks as joints_3d_left_m, in the camera's frame; zeros where not ok."""
    ok = (F.col("point_count") > 0) & F.col("camera").isNotNull()
    m = [F.col(f"camera.{n}") for n in NAMES]
    joints = landmarks(*([F.col(name)[k] for k in range(3)] for name in ("low", "high", "centre")))
    moved = F.transform(joints, lambda j: F.array(*applied_inverse(m, j[0], j[1], j[2])))
    zeros = F.expr(f"array_repeat(array_repeat(0D, 3), {JOINTS})")
    return base.withColumn("ok", ok).withColumn("joints_3d_left_m", F.when(F.col("ok"), moved).otherwise(zeros))


def finished_rows(base: DataFrame, frame_index: int = 0, is_right: bool = True, left_row: int = -1, right_row: int = -1, global_scale: float = 1.0, scene_id: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of schemas.HANDS, after the columns to keep, from those of placed_joints()."""
    side, scene_id = 1 if is_right else 0, F.lit("") if scene_id is None else scene_id
    rows = with_hand_angles(base)
    for unit in ("rad", "deg"):
        rows = rows.withColumn(f"hand_angles_20dof_{unit}", F.when(F.col("ok"), F.col(f"hand_angles_20dof_{unit}")).otherwise(_fill("0D", len(ANGLE_NAMES), "double")))
    mask = F.when(F.col("ok"), _fill("true", JOINTS, "boolean")).otherwise(_fill("false", JOINTS, "boolean"))
    confidence = F.when(F.col("ok"), F.lit(1.0)).otherwise(F.lit(0.0))
    root, status, zero3 = F.col("joints_3d_left_m")[0], F.when(F.col("ok"), "ok").otherwise("invalid"), _fill("0D", 3, "double")
    summary = F.to_json(F.struct(
        scene_id.alias("scene_id"), F.lit(frame_index).alias("frame_index"), F.lit(side).alias("hand_side"), F.lit(is_right).alias("is_right"), status.alias("status"),
        F.lit("mock_rgbd_pointcloud").alias("source"), F.col("point_count"), F.lit("rectified_left_camera").alias("coordinate_frame"), F.lit("m").alias("position_unit"), F.lit("rad").alias("rotation_unit"),
    ))
    values = {
        "row_id": F.lit(0), "frame_index": F.lit(frame_index), "left_row": F.lit(left_row), "right_row": F.lit(right_row), "root_translation_m": root,
        "global_orient_residual_rotvec": zero3, "global_orient_residual_deg": F.lit(0.0), "global_scale": F.lit(float(global_scale)), "scale_group": F.lit(side),
        "hand_side": F.lit(side), "is_right": F.lit(is_right), "wrist_pose_6d_left_m_rad": F.concat(root, zero3), "hand_angles_20dof_rad": F.col("hand_angles_20dof_rad"),
        "hand_angles_20dof_deg": F.col("hand_angles_20dof_deg"), "joints_3d_left_m": F.col("joints_3d_left_m"), "valid_joint_mask": mask, "anchor_mask": mask, "visible_anchor_mask": mask,
        "anchor_confidence": F.array_repeat(confidence, F.lit(JOINTS)), "frame_confidence": confidence, "frame_status": status, "summary_json": summary,
    }
    return rows.select(*keep, *(values[f.name].cast(f.dataType).alias(f.name) for f in HANDS.fields))


def hand_meta(cameras: DataFrame, is_right: bool = True, global_scale: float = 1.0) -> DataFrame:
    """The one row of schemas.HANDS_META; without cameras the identity and a baseline of 0."""
    first = cameras.where("view_idx = 0").select(intrinsics().alias("k")).limit(1)
    return meta_row(baseline(cameras).join(first, F.lit(True), "left"), is_right, global_scale)


def meta_row(base: DataFrame, is_right: bool = True, global_scale: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of schemas.HANDS_META, after the columns to keep, from rows of baseline_m and k (null without a first camera)."""
    identity = F.expr("array(array(1D, 0D, 0D), array(0D, 1D, 0D), array(0D, 0D, 1D))")
    scale = F.to_json(F.struct(F.lit("mock_placeholder").alias("source"), F.lit(float(global_scale)).alias("global_scale"), F.lit(int(is_right)).alias("scale_group"), F.col("baseline_m"), F.lit("row fields are -1 placeholders").alias("note")))
    values = {
        "K": F.coalesce("k", identity), "baseline_m": F.col("baseline_m"), "hand_angle_names_20dof": F.array(*map(F.lit, ANGLE_NAMES)),
        "joint_names": F.array(*map(F.lit, JOINT_NAMES)), "anchor_confidence_source": F.lit("anchor_mask_placeholder"), "scale_meta_json": scale,
    }
    return base.select(*keep, *(values[f.name].cast(f.dataType).alias(f.name) for f in HANDS_META.fields))
