"""Queries that SQL cannot answer, number for number against NumPy written from the survey's contract."""

import json
import math

import numpy as np
import pytest

from conftest import DATA
from cloudframe.plans import fixtures as fx
from cloudframe.plans import queries


def places(df):
    rows = df.select("point_id", "x", "y", "z").orderBy("point_id").collect()
    return np.array([[r.x, r.y, r.z] for r in rows]).reshape(-1, 3)


def pairs_of(moved, target, threshold, trim, least):
    square = ((moved[:, None] - target[None]) ** 2).sum(axis=2)
    to, d = square.argmin(axis=1), np.sqrt(square.min(axis=1))
    kept = np.flatnonzero(d <= threshold) if threshold else np.arange(len(d))
    if trim < 1 and len(kept):
        k = min(len(kept), max(least, math.ceil(len(kept) * trim)))
        kept = kept[d[kept] <= np.sort(d[kept])[k - 1]]
    return kept, to[kept], d[kept]


def fit(a, b):
    h = (a - a.mean(0)).T @ (b - b.mean(0))
    u, _, v = np.linalg.svd(h)
    if np.linalg.det(v.T @ u.T) < 0:
        v[2] *= -1
    m = np.eye(4)
    m[:3, :3] = v.T @ u.T
    m[:3, 3] = b.mean(0) - m[:3, :3] @ a.mean(0)
    return m


def icp(source, target, iterations=50, tolerance=1e-6, threshold=None, trim=0.9, least=30):
    m, before, history, status = np.eye(4), np.inf, [], "max_iterations"
    for _ in range(iterations):
        moved = source @ m[:3, :3].T + m[:3, 3]
        kept, to, d = pairs_of(moved, target, threshold, trim, least)
        if len(kept) < least:
            status = "not_enough_pairs"
            break
        history.append((len(kept), d.mean(), np.sqrt((d**2).mean())))
        m = fit(moved[kept], target[to]) @ m
        if abs(before - d.mean()) < tolerance:
            status = "converged"
            break
        before = d.mean()
    kept, _, d = pairs_of(source @ m[:3, :3].T + m[:3, 3], target, threshold, trim, least)
    return m, status, history, d.mean(), np.sqrt((d**2).mean()), len(kept) / len(source)


def same(row, want):
    m, status, history, mean, rmse, fitness = want
    assert np.allclose(row.transform, m, atol=1e-7) and (row.status, row.iterations) == (status, len(history))
    assert (row.mean_error, row.rmse, row.fitness) == pytest.approx((mean, rmse, fitness), abs=1e-8)
    assert [(h.iteration, h.pair_count) for h in row.history] == [(k, n) for k, (n, *_) in enumerate(history, 1)]
    assert np.allclose([(h.mean_error, h.rmse) for h in row.history], [h[1:] for h in history], atol=1e-8)


def test_icp_register(spark):
    (row,) = queries.icp_register(spark, DATA).collect()
    same(row, icp(places(fx.cloud(spark, DATA, 0)), places(fx.cloud(spark, DATA, 1))))


def test_icp_multi_source(spark):
    rows = {r.source: r for r in queries.icp_multi_source(spark, DATA).collect()}
    sources, target = (fx.cloud(spark, DATA, k) for k in (0, 1))
    assert len(rows) == 3
    for label in range(3):
        same(rows[str(label)], icp(places(sources.where(f"label = {label}")), places(target)))


def test_icp_merge(spark):
    def voxels(p, *more):
        cells = {}
        for k, x in zip(map(tuple, np.floor(p / queries.VOXEL).astype(int)), p, strict=True):
            cells.setdefault(k, []).append(x)
        return {k: np.mean(v, axis=0) for k, v in cells.items()}

    target, source = (places(fx.cloud(spark, DATA, k)) for k in (0, 1))
    m, *_ = icp(np.array(list(voxels(source).values())), np.array(list(voxels(target).values())), 60, 1e-7, 0.3, 0.9, 80)
    want = voxels(np.vstack([target, source @ m[:3, :3].T + m[:3, 3]]))
    got = {(r.kx, r.ky, r.kz): (r.x, r.y, r.z) for r in queries.icp_merge(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-7) for k in want)


def test_mock_scene_pixels(spark):
    """A painter who draws points nearest first, one after the other, on depths kept as float."""
    points = queries.scene_points(spark, DATA).orderBy("point_id").collect()
    world = np.array([[p.x, p.y, p.z] for p in points])
    got = {}
    for r in queries.mock_scene_pixels(spark, DATA).collect():
        got.setdefault(r.view_idx, {})[r.v, r.u] = (r.depth, r.label, (r.r, r.g, r.b))
    assert set(got) == {0, 1, 2, 3}
    for view, pixels in got.items():
        angle = 2 * math.pi * view / 4 + math.pi / 4
        eye = np.array([0.64 * math.cos(angle), 0.64 * math.sin(angle), 0.46])
        ahead = np.array([0, 0, 0.43]) - eye
        ahead /= np.linalg.norm(ahead)
        right = np.cross(ahead, [0, 0, 1.0])
        right /= np.linalg.norm(right)
        local = (world - eye) @ np.stack([right, np.cross(ahead, right), ahead], axis=1)
        depth, content = np.zeros((96, 128), np.float32), {}
        for k in np.argsort(local[:, 2], kind="stable"):
            x, y, z = local[k]
            if z <= 0.05:
                continue
            u, v = int(np.rint(118 * x / z + 63.5)), int(np.rint(118 * y / z + 47.5))
            if not (0 <= u < 128 and 0 <= v < 96):
                continue
            for dv in (-1, 0, 1):
                for du in (-1, 0, 1):
                    a, b = v + dv, u + du
                    if 0 <= a < 96 and 0 <= b < 128 and (depth[a, b] == 0 or z < depth[a, b]):
                        depth[a, b], content[a, b] = z, (points[k].label, (points[k].r, points[k].g, points[k].b))
        assert len(pixels) == 96 * 128
        off = sum(pixels[v, u] != (depth[v, u], *content.get((v, u), (0, (0, 0, 0)))) for v in range(96) for u in range(128))
        assert off <= 2  # a last bit of z may round the other way


def test_hand_payload_in_full(spark):
    """What the query of joints leaves out: every field of the file, one hand and an empty one."""
    from cloudframe.plans.reconstruct import reconstruct
    from cloudframe.schemas import ANGLE_NAMES, HANDS, HANDS_META, JOINT_NAMES

    pixels, cameras = fx.pixels(spark, DATA), fx.cameras(spark)
    out = reconstruct(pixels, cameras, queries.GRID)
    row, meta = out.hands.first(), out.meta.first()
    assert row.__fields__ == HANDS.fieldNames() and meta.__fields__ == HANDS_META.fieldNames()
    joints = np.array(row.joints_3d_left_m)
    across, up = joints[17] - joints[5], joints[9] - joints[0]
    x = across / np.linalg.norm(across)
    z = np.cross(x, up / np.linalg.norm(up))
    z /= np.linalg.norm(z)
    frame = np.stack([x, np.cross(z, x), z])

    def bend(a, b, c):
        p, q = joints[a] - joints[b], joints[c] - joints[b]
        return math.pi - math.acos(np.clip(p @ q / np.linalg.norm(p) / np.linalg.norm(q), -1, 1))

    def base(a, b):
        lx, ly, lz = frame @ (joints[b] - joints[a])
        return math.atan2(lx, ly), math.atan2(abs(lz), ly)

    angles = [*base(1, 2)[::-1], bend(1, 2, 3), bend(2, 3, 4)] + [v for k in (5, 9, 13, 17) for v in (*base(k, k + 1), bend(k, k + 1, k + 2), bend(k + 1, k + 2, k + 3))]
    assert np.allclose(row.hand_angles_20dof_rad, angles, atol=1e-6) and np.allclose(row.hand_angles_20dof_deg, np.degrees(angles), atol=1e-4)
    assert row.root_translation_m == joints[0].tolist() and row.wrist_pose_6d_left_m_rad == [*joints[0], 0, 0, 0]
    assert (row.frame_index, row.left_row, row.right_row, row.scale_group, row.hand_side, row.is_right, row.global_scale, row.frame_status, row.frame_confidence) == (0, -1, -1, 1, 1, True, 1.0, "ok", 1.0)
    assert all(row.valid_joint_mask) and row.valid_joint_mask == row.anchor_mask == row.visible_anchor_mask and row.anchor_confidence == [1.0] * 21
    assert json.loads(row.summary_json)["point_count"] == out.hand.count() and meta.K == [[118, 0, 63.5], [0, 118, 47.5], [0, 0, 1]]
    assert (meta.joint_names, meta.hand_angle_names_20dof) == (JOINT_NAMES, ANGLE_NAMES) and json.loads(meta.scale_meta_json)["baseline_m"] == pytest.approx(meta.baseline_m)
    out.release()
    none = reconstruct(pixels.where("label = 2"), cameras, queries.GRID)
    empty = none.hands.first()
    assert empty.frame_status == "invalid" and empty.joints_3d_left_m == [[0, 0, 0]] * 21 and not any(empty.valid_joint_mask) and empty.hand_angles_20dof_rad == [0] * 20
    none.release()


def test_selftest_of_the_synthetic_hand(spark):
    from cloudframe.plans.registration import selftest

    (row,) = selftest(spark, cases=1).collect()
    assert row.ok and row.status in ("converged", "max_iterations")
