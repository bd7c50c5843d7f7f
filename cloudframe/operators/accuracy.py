"""Accuracy of hand rows: against themselves and against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.vectors import array_distance
from cloudframe.operators.order import summary, with_previous
from cloudframe.schemas import BONES, HAND_SIZES, META_SIZES, REQUIRED_FIELDS

#: What a row that lacks a field counts as, for the metrics.
ABSENT = {
    "joints_3d_left_m": "array_repeat(array_repeat(0D, 3), 21)", "valid_joint_mask": "array_repeat(false, 21)", "frame_status": "'invalid'",
    "frame_confidence": "0D", "root_translation_m": "array_repeat(0D, 3)", "hand_side": "0L",
}


def or_zero(value: Column) -> Column:
    """An empty mean, least value or percentile counts as 0."""
    return F.coalesce(value, F.lit(0.0))


def with_defaults(hands: DataFrame, absent: dict[str, str] = ABSENT) -> DataFrame:
    return hands.withColumns({name: F.expr(value) for name, value in absent.items() if name not in hands.columns})


def match_rows(prediction: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns p and r (structs) of the rows with equal frame_index and hand_side.

    Of reference rows with the same key the last by row_id counts; all predictions of a key
    match it. Where either side lacks a key column, rows are matched by row_id.
    """
    p = prediction.select(F.struct("*").alias("p"))
    keys = ("frame_index", "hand_side")
    if not all(k in side.columns for side in (prediction, reference) for k in keys):
        return p.join(reference.select(F.struct("*").alias("r")), F.col("p.row_id") == F.col("r.row_id"))
    last = reference.groupBy(*keys).agg(F.max_by(F.struct(*reference.columns), "row_id").alias("r"))
    return p.join(last, (F.col("p.frame_index") == F.col("frame_index")) & (F.col("p.hand_side") == F.col("hand_side"))).select("p", "r")


def _mask(matched: DataFrame, side: str) -> Column:
    """Which joints of a side are valid; a missing mask counts as all valid."""
    names = matched.schema[side].dataType.names
    return F.col(f"{side}.valid_joint_mask") if "valid_joint_mask" in names else F.expr("array_repeat(true, 21)")


def _joints(matched: DataFrame) -> Column:
    """array<struct<a, b, m, n>>: both sides' places and masks, joint by joint."""
    return F.arrays_zip(F.col("p.joints_3d_left_m").alias("a"), F.col("r.joints_3d_left_m").alias("b"), _mask(matched, "p").alias("m"), _mask(matched, "r").alias("n"))


def joint_errors(matched: DataFrame) -> DataFrame:
    """row_id, frame_index, hand_side, joint, error of the joints valid on both sides."""
    names = [k for k in ("row_id", "frame_index", "hand_side") if k in matched.schema["p"].dataType.names]
    rows = matched.select(*(F.col(f"p.{k}").alias(k) for k in names), F.posexplode(_joints(matched)).alias("joint", "j"))
    return rows.where("j.m and j.n").select(*names, "joint", array_distance(F.col("j.a"), F.col("j.b")).alias("error"))


def reference_metrics(prediction: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of all metrics against the reference; without a match only matched_rows is not null.

    Joint errors count joints valid on both sides; roots and angles count all matched rows. The
    matches' figures are one aggregate, the joints' another; each joins the two sides once.
    """
    matched = match_rows(prediction, reference)
    angles = [_angle_mae()] if all("hand_angles_20dof_deg" in matched.schema[side].dataType.names for side in "pr") else []
    found = matched.agg(F.count("*").alias("matched_rows"), _root_rmse(), *angles).crossJoin(joint_report(matched))  # one row each
    names = ["root_translation_rmse_m", "mpjpe_m", "mpjpe_mm", "joint_error_p95_m"] + ["hand_angle_mae_deg"] * len(angles)
    return found.select("matched_rows", *(F.when(F.col("matched_rows") > 0, F.col(c)).alias(c) for c in names))


def joint_report(matched: DataFrame) -> DataFrame:
    """mpjpe_m, mpjpe_mm and joint_error_p95_m over the joints valid on both sides."""
    mean = or_zero(F.avg("error"))
    found = summary(joint_errors(matched).select("error"), [mean.alias("mpjpe_m"), (mean * 1000.0).alias("mpjpe_mm")], {"joint_error_p95_m": ("error", 0.95)})
    return found.withColumn("joint_error_p95_m", or_zero(F.col("joint_error_p95_m")))


def _root_rmse() -> Column:
    root = array_distance(F.col("p.root_translation_m"), F.col("r.root_translation_m"))
    return or_zero(F.sqrt(F.avg(root * root))).alias("root_translation_rmse_m")


def _angle_mae() -> Column:
    off = F.zip_with("p.hand_angles_20dof_deg", "r.hand_angles_20dof_deg", lambda a, b: F.abs(a - b))
    return or_zero(F.try_divide(F.sum(F.aggregate(off, F.lit(0.0), lambda total, x: total + x)), F.sum(F.size(off)))).alias("hand_angle_mae_deg")


def root_rmse(matched: DataFrame) -> DataFrame:
    """matched_rows and root_translation_rmse_m over all matched rows."""
    return matched.agg(F.count("*").alias("matched_rows"), _root_rmse())


def angle_mae(matched: DataFrame) -> DataFrame:
    """hand_angle_mae_deg over all angles of all matched rows."""
    return matched.agg(_angle_mae())


def _bones() -> Column:
    """The lengths of the twenty bones of a row's joints."""
    joint = F.col("joints_3d_left_m")
    return F.array(*(array_distance(F.get(joint, F.lit(b)), F.get(joint, F.lit(a))) for a, b in BONES))


def bone_lengths(hands: DataFrame) -> DataFrame:
    """row_id, bone, length of the twenty bones of every row, valid or not."""
    return hands.select("row_id", F.posexplode(_bones()).alias("bone", "length"))


def with_root_step(hands: DataFrame) -> DataFrame:
    """Add `step`: how far the root moved since the side's row before, null for a side's first row."""
    moved = with_previous(hands, "root_translation_m", "before", "hand_side", "frame_index", "row_id")
    return moved.withColumn("step", array_distance(F.col("root_translation_m"), F.col("before"))).drop("before")


def root_steps(hands: DataFrame) -> DataFrame:
    """hand_side, frame_index, step: how far the root moved since the side's row before."""
    return with_root_step(hands).where("step is not null").select("hand_side", "frame_index", "step")


STEPS = {"root_step_median_m": ("step", 0.5), "root_step_p95_m": ("step", 0.95)}


def root_step_metrics(hands: DataFrame) -> DataFrame:
    """Median and 95th percentile of the steps of both sides together."""
    found = summary(root_steps(hands), [F.count("*").alias("n")], STEPS)
    return found.select(*(or_zero(F.col(c)).alias(c) for c in STEPS))


def self_consistency(hands: DataFrame) -> DataFrame:
    """One row of the nine metrics that need no reference, in one pass over the rows; absent fields count as ABSENT."""
    hands = with_defaults(hands, ABSENT | {"frame_index": "row_id"})
    rows = with_root_step(hands.select("row_id", "frame_index", *ABSENT))
    rows = rows.select("frame_status", "valid_joint_mask", "frame_confidence", "step", F.posexplode(_bones()).alias("bone", "length"))
    first = F.col("bone") == 0  # one of a hand's rows speaks for the hand
    valid = F.aggregate("valid_joint_mask", F.lit(0), lambda n, x: n + x.cast("int"))
    once = lambda c: F.when(first, c)
    aggregates = [
        F.count_if(first).alias("row_count"), or_zero(F.avg(once((F.col("frame_status") == "ok").cast("double")))).alias("ok_frame_ratio"),
        or_zero(F.try_divide(F.sum(once(valid)), F.sum(once(F.size("valid_joint_mask"))))).alias("valid_joint_ratio"),
        or_zero(F.avg(once(F.col("frame_confidence")))).alias("frame_confidence_mean"), or_zero(F.min(once(F.col("frame_confidence")))).alias("frame_confidence_min"),
        or_zero(F.avg("length")).alias("bone_length_mean_m"),
    ]
    steps = rows.withColumn("step", once(F.col("step")))
    found = summary(steps, aggregates, {"bone_length_p95_m": ("length", 0.95)} | STEPS)
    names = ["row_count", "ok_frame_ratio", "valid_joint_ratio", "frame_confidence_mean", "frame_confidence_min", "bone_length_mean_m", "bone_length_p95_m", *STEPS]
    return found.select(*(or_zero(F.col(c)).alias(c) if c in ("bone_length_p95_m", *STEPS) else F.col(c) for c in names))


def missing_fields(hands: DataFrame, meta: DataFrame | None) -> list[str]:
    """The required fields that neither the rows nor the file-level part have."""
    there = {*hands.columns, *(meta.columns if meta is not None else ())}
    return [name for name in REQUIRED_FIELDS if name not in there]


def shape_errors(hands: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """field, expected, bad_rows for array fields of a wrong length in some row."""
    def wrong(name: str, size: int) -> Column:
        bad = F.col(name).isNull() | (F.size(name) != size)
        inner = 3 if name in ("joints_3d_left_m", "K") else None
        return bad | F.exists(name, lambda x: F.size(x) != inner) if inner else bad

    def counted(df: DataFrame, sizes: dict[str, int]) -> DataFrame | None:
        names = {k: v for k, v in sizes.items() if k in df.columns}
        if not names:
            return None
        row = df.agg(*(F.count_if(wrong(k, v)).alias(k) for k, v in names.items()))
        entries = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(v).alias("expected"), F.col(k).alias("bad_rows")) for k, v in names.items()))
        return row.select(F.inline(entries)).where("bad_rows > 0")

    parts = [p for p in (counted(hands, HAND_SIZES), counted(meta, META_SIZES) if meta is not None else None) if p is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verdict(hands: DataFrame, meta: DataFrame | None = None, reference: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """One row: status, passed, missing_fields, shape_errors, metrics, reference_metrics, warnings."""
    missing = missing_fields(hands, meta)
    errors = shape_errors(hands, meta).agg(F.array_sort(F.collect_list(F.concat(F.col("field"), F.lit(" expected "), F.col("expected")))).alias("shape_errors"))
    keyed = "frame_index" in hands.columns
    row = errors.crossJoin(self_consistency(hands).select(F.struct("*").alias("metrics")))
    if reference is not None:
        row = row.crossJoin(reference_metrics(hands, reference).select(F.struct("*").alias("reference_metrics")))
    rules = [("missing_required_fields", F.lit(bool(missing))), ("invalid_field_shapes", F.size("shape_errors") > 0 if keyed else F.lit(True))]
    rules += [(f"low_{name}", F.col(f"metrics.{name}") < least if keyed else F.lit(True)) for name in ("valid_joint_ratio", "ok_frame_ratio")]
    if reference is not None:
        rules.append(("no_reference_rows_matched", F.col("reference_metrics.matched_rows") == 0))
    row = row.withColumn("warnings", F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules))))
    passed = F.size("warnings") == 0
    names = F.array(*map(F.lit, missing)) if missing else F.array().cast("array<string>")
    extra = ["reference_metrics"] if reference is not None else []
    return row.select(F.when(passed, "ok").otherwise("failed").alias("status"), passed.alias("passed"), names.alias("missing_fields"), "shape_errors", "metrics", *extra, "warnings")
