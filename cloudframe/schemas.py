"""Schemas of the tables, and the fixed names that go with them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

STRING, DOUBLE, FLOAT, LONG, INT, SHORT, BOOLEAN = T.StringType(), T.DoubleType(), T.FloatType(), T.LongType(), T.IntegerType(), T.ShortType(), T.BooleanType()


def fields(*groups: tuple[str, T.DataType]) -> T.StructType:
    """A schema from ("names apart by spaces", type) pairs; it needs no session, so modules can be imported first."""
    return T.StructType([T.StructField(name, kind) for names, kind in groups for name in names.split()])


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table from the driver, by Arrow: Spark plans it as a local relation, without a job of its own."""
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


POINTS = fields(("cloud_id", STRING), ("point_id", LONG), ("x y z", DOUBLE), ("r g b", SHORT))
PIXELS = fields(("scene_id", STRING), ("view_idx v u", INT), ("depth", FLOAT), ("label r g b", SHORT))
CAMERAS = fields(("scene_id", STRING), ("view_idx", INT), ("camera_id", STRING), ("width height", INT), ("fx fy cx cy r00 r01 r02 r10 r11 r12 r20 r21 r22 tx ty tz", DOUBLE), ("timestamp", STRING))
_DOUBLES, _FLAGS, _MATRIX = T.ArrayType(DOUBLE), T.ArrayType(BOOLEAN), T.ArrayType(T.ArrayType(DOUBLE))
#: Rows of the normalized hand file: one hand in one frame.
HANDS = fields(
    ("row_id frame_index left_row right_row", LONG), ("root_translation_m global_orient_residual_rotvec", _DOUBLES), ("global_orient_residual_deg global_scale", DOUBLE),
    ("scale_group hand_side", LONG), ("is_right", BOOLEAN), ("wrist_pose_6d_left_m_rad hand_angles_20dof_rad hand_angles_20dof_deg", _DOUBLES), ("joints_3d_left_m", _MATRIX),
    ("valid_joint_mask anchor_mask visible_anchor_mask", _FLAGS), ("anchor_confidence", _DOUBLES), ("frame_confidence", DOUBLE), ("frame_status summary_json", STRING),
)
#: What the file has once.
HANDS_META = fields(("K", _MATRIX), ("baseline_m", DOUBLE), ("hand_angle_names_20dof joint_names", T.ArrayType(STRING)), ("anchor_confidence_source scale_meta_json", STRING))
LABELS = {"background": 0, "hand": 1, "object": 2}

# Fixed values, down to the end of this file: the file format's names of joints and angles in their order, the bones
# between joints, the sizes of array fields and the fields that a file must have.
FINGERS = ("index", "middle", "ring", "pinky")
JOINT_NAMES = ["wrist", "thumb_cmc", "thumb_mcp", "thumb_ip", "thumb_tip"] + [f"{f}_{j}" for f in FINGERS for j in ("mcp", "pip", "dip", "tip")]
ANGLE_NAMES = ["thumb_cmc_flexion", "thumb_cmc_abduction", "thumb_mcp_flexion", "thumb_ip_flexion"] + [
    f"{f}_{a}" for f in FINGERS for a in ("mcp_abduction", "mcp_flexion", "pip_flexion", "dip_flexion")
]
#: (parent, child) of the twenty bones: from the wrist to each root, then along the finger.
BONES = [pair for root in (1, 5, 9, 13, 17) for pair in ((0, root), (root, root + 1), (root + 1, root + 2), (root + 2, root + 3))]
#: Sizes of the array fields of a row; None stands for a scalar.
HAND_SIZES = {
    "root_translation_m": 3, "global_orient_residual_rotvec": 3, "wrist_pose_6d_left_m_rad": 6, "hand_angles_20dof_rad": 20,
    "hand_angles_20dof_deg": 20, "joints_3d_left_m": 21, "valid_joint_mask": 21, "anchor_mask": 21, "visible_anchor_mask": 21, "anchor_confidence": 21,
}
META_SIZES = {"K": 3, "hand_angle_names_20dof": 20, "joint_names": 21}
REQUIRED_FIELDS = [
    "K", "baseline_m", "frame_index", "left_row", "right_row", "root_translation_m", "global_orient_residual_rotvec", "global_orient_residual_deg",
    "global_scale", "scale_group", "hand_side", "is_right", "wrist_pose_6d_left_m_rad", "hand_angles_20dof_rad", "hand_angles_20dof_deg",
    "hand_angle_names_20dof", "joint_names", "joints_3d_left_m", "valid_joint_mask", "anchor_mask", "visible_anchor_mask", "anchor_confidence",
    "anchor_confidence_source", "frame_confidence", "frame_status", "scale_meta_json", "summary_json",
]
