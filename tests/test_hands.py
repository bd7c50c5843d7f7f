import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.functions.hand_angles import with_hand_angles
from cloudframe.operators import accuracy, hands
from cloudframe.schemas import ANGLE_NAMES, BONES, JOINT_NAMES


def numpy_angles(j):
    def unit(v, fallback):
        n = np.linalg.norm(v)
        return v / n if n >= 1e-12 else np.array(fallback, float)

    x = unit(j[17] - j[5], (1, 0, 0))
    y = unit(j[9] - j[0], (0, 1, 0))
    z = unit(np.cross(x, y), (0, 0, 1))
    frame = np.stack([x, unit(np.cross(z, x), y), z])

    def base(v):
        a, b, c = frame @ v
        return np.arctan2(a, b), np.arctan2(abs(c), b)

    def bent(a, b, c):
        p, q = unit(j[a] - j[b], (0, 0, 0)), unit(j[c] - j[b], (0, 0, 0))
        return np.pi - np.arccos(np.clip(p @ q, -1, 1))

    out = [*base(j[2] - j[1])[::-1], bent(1, 2, 3), bent(2, 3, 4)]
    for k in (5, 9, 13, 17):
        out += [*base(j[k + 1] - j[k]), bent(k, k + 1, k + 2), bent(k + 1, k + 2, k + 3)]
    return np.array(out)


def test_angles_of_random_and_degenerate_hands(spark):
    rng = np.random.default_rng(2)
    sets = [*rng.normal(size=(5, 21, 3)), np.zeros((21, 3))]
    df = spark.createDataFrame([(k, j.tolist()) for k, j in enumerate(sets)], "row_id int, joints_3d_left_m array<array<double>>")
    for r in with_hand_angles(df).collect():
        assert np.allclose(r.hand_angles_20dof_rad, numpy_angles(sets[r.row_id]), atol=1e-9)
        assert np.allclose(r.hand_angles_20dof_deg, np.degrees(r.hand_angles_20dof_rad))


def test_names():
    assert len(JOINT_NAMES) == 21 and len(ANGLE_NAMES) == 20 and len(BONES) == 20 and (0, 17) in BONES and (19, 20) in BONES


def test_landmarks_rank_axes_and_place_thickness_from_the_centre(spark):
    rows = [(0.0, 0.0, 0.0), (0.1, 0.3, 0.02), (0.05, 0.1, 0.01)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    joints = hands.landmarks_of(df).first().joints
    centre_z = np.mean([z for *_, z in rows])
    assert joints[0] == pytest.approx([0.52 * 0.1, 0.13 * 0.3, centre_z])
    assert joints[4] == pytest.approx([-0.04 * 0.1, 0.68 * 0.3, centre_z + 0.1 * 0.02])


def hand(spark, rows):
    return spark.createDataFrame(
        [(k, f, s, [[float(x)] * 3] * 21, [float(x)] * 3, [ok] * 21, [float(x)] * 20, 0.5, "ok" if ok else "invalid") for k, f, s, x, ok in rows],
        "row_id bigint, frame_index bigint, hand_side bigint, joints_3d_left_m array<array<double>>, root_translation_m array<double>, valid_joint_mask array<boolean>, "
        "hand_angles_20dof_deg array<double>, frame_confidence double, frame_status string",
    )


def test_last_duplicate_of_the_reference_wins_and_masks_apply(spark):
    pred = hand(spark, [(0, 1, 0, 0.0, True), (1, 1, 0, 1.0, True), (2, 2, 0, 0.0, False), (3, 9, 1, 0.0, True)])
    ref = hand(spark, [(0, 1, 0, 5.0, True), (1, 1, 0, 2.0, True), (2, 2, 0, 1.0, True)])
    matched = accuracy.match_rows(pred, ref)
    assert sorted((r.p.row_id, r.r.row_id) for r in matched.collect()) == [(0, 1), (1, 1), (2, 2)]
    m = accuracy.reference_metrics(pred, ref).first()
    assert m.matched_rows == 3
    assert m.mpjpe_m == pytest.approx(1.5 * 3**0.5) and m.mpjpe_mm == pytest.approx(1500 * 3**0.5)  # the third row isn't valid
    assert m.root_translation_rmse_m == pytest.approx((3 * (4 + 1 + 1) / 3) ** 0.5)
    assert m.hand_angle_mae_deg == pytest.approx(4 / 3)


def test_no_match_and_missing_keys(spark):
    pred, ref = hand(spark, [(0, 1, 0, 0.0, True)]), hand(spark, [(0, 2, 0, 0.0, True)])
    m = accuracy.reference_metrics(pred, ref).first()
    assert m.matched_rows == 0 and m.mpjpe_m is None
    assert "no_reference_rows_matched" in accuracy.verdict(pred, None, ref).first().warnings
    assert accuracy.match_rows(pred.drop("hand_side"), ref).count() == 1


def test_steps_stay_within_a_side_and_ignore_gaps(spark):
    h = hand(spark, [(0, 5, 0, 2.0, True), (1, 1, 0, 0.0, True), (2, 100, 1, 7.0, True), (3, 9, 0, 3.0, True)])
    assert sorted(r.step for r in accuracy.root_steps(h).collect()) == pytest.approx([3**0.5, 2 * 3**0.5])
    assert accuracy.root_step_metrics(h.limit(0)).first().root_step_median_m == 0.0


def test_self_consistency_counts_invalid_rows_and_defaults(spark):
    h = hand(spark, [(0, 1, 0, 1.0, True), (1, 2, 0, 2.0, False)])
    m = accuracy.self_consistency(h).first()
    assert (m.row_count, m.ok_frame_ratio, m.valid_joint_ratio, m.bone_length_mean_m) == (2, 0.5, 0.5, 0.0)
    bare = accuracy.self_consistency(h.select("row_id", "frame_index")).first()
    assert (bare.row_count, bare.ok_frame_ratio, bare.valid_joint_ratio) == (2, 0.0, 0.0)
    assert accuracy.self_consistency(h.limit(0)).first().frame_confidence_min == 0.0


def test_shape_errors(spark):
    h = hand(spark, [(0, 1, 0, 1.0, True)]).withColumn("valid_joint_mask", F.expr("array(true)"))
    assert [(r.field, r.bad_rows) for r in accuracy.shape_errors(h).collect()] == [("valid_joint_mask", 1)]
    assert "invalid_field_shapes" in accuracy.verdict(h).first().warnings
