"""Pose and quality reports: aggregates with threshold rules, as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.vectors import rounded
from cloudframe.operators.points import bounding_box


def pose_confidence(n: Column) -> Column:
    """Points over 900, at least 0.05 and at most 0.95; 0 without points."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.95), n / F.lit(900.0))))


def _vector(prefix: str) -> Column:
    return F.array(*(rounded(f"{prefix}_{c}") for c in "xyz"))


def pose(points: DataFrame, label_name: str, item_id: str) -> DataFrame:
    """One row: a pose of centroid, box and confidence of a cloud (of voxel means, in the pipeline)."""
    n = F.col("point_count")
    identity = F.array(*(F.array(*(F.lit(1.0 if i == j else 0.0) for j in range(3))) for i in range(3)))
    return bounding_box(points).select(
        F.lit(item_id).alias("id"), F.lit(label_name).alias("label"), F.lit("mock_bbox_centroid").alias("pose_type"),
        F.when(n > 0, "ok").otherwise("no_points").alias("status"), _vector("centre").alias("translation_m"), identity.alias("rotation_matrix"),
        F.struct(_vector("min").alias("min"), _vector("max").alias("max")).alias("bbox_3d_m"), n, rounded(pose_confidence(n), 6).alias("confidence"),
    )


def pose_struct(box: Column, label_name: str, item_id: str) -> Column:
    """As pose(), from a struct of point_count, low, high and centre; a null one is an empty cloud's."""
    n = F.coalesce(box["point_count"], F.lit(0))
    identity = F.array(*(F.array(*(F.lit(1.0 if i == j else 0.0) for j in range(3))) for i in range(3)))

    def place(name: str) -> Column:
        return F.coalesce(F.transform(box[name], lambda x: rounded(x)), F.array(*[F.lit(0.0)] * 3))

    return F.struct(
        F.lit(item_id).alias("id"), F.lit(label_name).alias("label"), F.lit("mock_bbox_centroid").alias("pose_type"), F.when(n > 0, "ok").otherwise("no_points").alias("status"),
        place("centre").alias("translation_m"), identity.alias("rotation_matrix"), F.struct(place("low").alias("min"), place("high").alias("max")).alias("bbox_3d_m"),
        n.alias("point_count"), rounded(pose_confidence(n), 6).alias("confidence"),
    )


def pose_output(hand: DataFrame, other: DataFrame, scene_id: str = "", frame: str = "world", timestamp: str = "") -> DataFrame:
    """One row with both poses; ok only if both are."""
    h = pose(hand, "hand", "hand_0").select(F.struct("*").alias("hand"))
    o = pose(other, "object", "object_0").select(F.struct("*").alias("object"))
    both = (F.col("hand.status") == "ok") & (F.col("object.status") == "ok")
    return h.crossJoin(o).select(
        F.when(both, "ok").otherwise("partial").alias("status"), F.lit(scene_id).alias("scene_id"), F.lit(frame).alias("coordinate_frame"),
        F.lit(timestamp).alias("timestamp"), F.array("hand").alias("hands"), F.array("object").alias("objects"),
    )


def pose_confidences(output: DataFrame) -> DataFrame:
    """The confidences of all hands and objects of a pose_output()."""
    return output.select(F.explode(F.concat(F.transform("hands", lambda p: p["confidence"]), F.transform("objects", lambda p: p["confidence"]))).alias("confidence"))


def quality(stats: DataFrame, fused: DataFrame, raw_count: int | Column, hand: DataFrame, other: DataFrame, output: DataFrame, scene_id: str = "", min_ratio: float = 0.01, min_points: int = 100) -> DataFrame:
    """One row: the metrics, the warnings in their order, and whether there are none.

    stats has camera_id and depth_valid_ratio of every view; counts of hand and object are
    of their fused points.
    """
    views = stats.agg(
        F.count("*").alias("view_count"), F.count_if(F.col("depth_valid_ratio") >= min_ratio).alias("good"), F.coalesce(F.avg("depth_valid_ratio"), F.lit(0.0)).alias("mean_ratio"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera_id", rounded("depth_valid_ratio", 6).alias("ratio"))))).alias("per_view"),
    )
    box = bounding_box(fused).select(F.col("point_count").alias("n_fused"), _vector("extent").alias("extent"))
    counts = hand.agg(F.count("*").alias("n_hand")).crossJoin(other.agg(F.count("*").alias("n_object")))
    sure = pose_confidences(output).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("sure"))
    joined = views.crossJoin(box).crossJoin(counts).crossJoin(sure).withColumn("n_raw", raw_count if isinstance(raw_count, Column) else F.lit(raw_count))
    return quality_columns(joined, F.lit(scene_id), min_ratio, min_points)


def quality_columns(joined: DataFrame, scene_id: Column, min_ratio: float = 0.01, min_points: int = 100) -> DataFrame:
    """The report of each row of view_count, good, mean_ratio, per_view, extent, n_fused, n_raw, n_hand, n_object and sure."""
    rules = [("one_or_more_views_have_low_valid_depth_ratio", F.col("good") < F.col("view_count")), ("fused_point_count_below_threshold", F.col("n_fused") < min_points), ("no_hand_points", F.col("n_hand") == 0), ("no_object_points", F.col("n_object") == 0)]
    warnings = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
    joined = joined.withColumn("warnings", warnings).withColumn("passed", F.size("warnings") == 0)
    metrics = F.struct(
        rounded("mean_ratio", 6).alias("depth_valid_ratio_mean"), F.col("per_view").alias("depth_valid_ratio_per_view"), F.col("n_hand").alias("hand_point_count"),
        F.col("n_object").alias("object_point_count"), F.col("n_raw").cast("bigint").alias("raw_point_count"), F.col("n_fused").alias("fused_point_count"), F.col("good").alias("views_with_valid_depth"),
        F.col("extent").alias("bbox_extent_m"), rounded(F.col("good") / F.greatest(F.lit(1), F.col("view_count")), 6).alias("coverage_score"), rounded("sure", 6).alias("pose_confidence_mean"),
    )
    thresholds = F.struct(F.lit(float(min_ratio)).alias("min_valid_depth_ratio"), F.lit(min_points).alias("min_fused_points"))
    return joined.select(F.when(F.col("passed"), "ok").otherwise("failed").alias("status"), scene_id.alias("scene_id"), "view_count", metrics.alias("metrics"), thresholds.alias("thresholds"), "passed", "warnings")
