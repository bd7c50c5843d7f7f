import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import depth, synth
from cloudframe.plans.reconstruct import reconstruct


@pytest.fixture(scope="module")
def cameras(spark):
    return synth.ring_cameras(spark, 3)


def pixel_rows(spark, rows):
    return spark.createDataFrame(rows, "view_idx int, u int, v int, depth float, label smallint")


def test_invalid_depths_and_labels(spark, cameras):
    rows = [(0, 1, 1, 1.0, 1), (0, 2, 1, 0.0, 1), (0, 3, 1, -1.0, 1), (0, 4, 1, float("nan"), 1), (0, 5, 1, float("inf"), 1), (0, 6, 1, 2.0, 2), (0, 7, 1, None, 2)]
    px = pixel_rows(spark, rows)
    assert depth.backproject(px, cameras).count() == 2
    assert depth.backproject(px, cameras, 2).count() == 1
    assert depth.backproject(px, cameras, []).count() == 0
    stats = {r.view_idx: r for r in depth.per_view_stats(px, cameras, 2).collect()}
    assert stats[0].valid_depth_point_count == 2 and stats[0].selected_point_count == 1
    assert stats[0].depth_valid_ratio == pytest.approx(2 / (128 * 96)) and stats[1].depth_valid_ratio == 0.0


def test_projecting_a_backprojected_pixel_gives_it_back(spark, cameras):
    px = pixel_rows(spark, [(k % 3, (k * 7) % 128, (k * 5) % 96, 0.3 + 0.01 * k, 1) for k in range(60)])
    world = depth.world_points(px, cameras).withColumn("point_id", F.monotonically_increasing_id())
    seen = depth.project(world.withColumnsRenamed({"u": "u0", "v": "v0", "view_idx": "view0"}), cameras).where("view0 = view_idx")
    assert seen.count() == 60 and seen.where("u <> u0 or v <> v0").count() == 0


def test_many_views_are_looked_up_by_cell(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cams = synth.ring_cameras(spark, 9, width=40, height=30, focal=60.0)
    rows = [(k, *map(float, p)) for k, p in enumerate(rng.normal(0, 0.4, (1500, 3)) + [0.1, 0, 0.4])] + [(-1, float("nan"), 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "point_id bigint, x double, y double, z double")
    want = sorted(map(tuple, depth.project(pts, cams).collect()))
    monkeypatch.setattr(depth, "FEW_VIEWS", 3)
    views = cams.select("view_idx", "width", "height", "fx", "fy", "cx", "cy", *depth.NAMES)
    assert sorted(map(tuple, depth.project(pts, cams).collect())) == want and len(want) > 300
    assert depth._in_reach(pts.where("point_id >= 0"), views).count() < 0.6 * 1500 * 9
    assert depth.project(pts.limit(0), cams).count() == 0


def test_baseline_needs_two_views(spark, cameras):
    assert depth.baseline(cameras.limit(0)).first().baseline_m == 0.0
    assert depth.baseline(cameras.where("view_idx = 0")).first().baseline_m == 0.0
    assert depth.baseline(cameras).first().baseline_m > 0


def painter(u, v, z, labels, width, height):
    """Nearest first, each against the float depth already there."""
    image, out = np.full((height, width), np.inf, np.float32), np.zeros((height, width), int)
    for k in np.argsort(z):
        for dv in (-1, 0, 1):
            for du in (-1, 0, 1):
                x, y = u[k] + du, v[k] + dv
                if 0 <= x < width and 0 <= y < height and z[k] < image[y, x]:
                    image[y, x], out[y, x] = z[k], labels[k]
    return image, out


def test_exact_rendering_is_the_painters(spark):
    rng = np.random.default_rng(5)
    cams = synth.ring_cameras(spark, 1, 16, 12, 15.0)
    rows = [(k, *map(float, rng.normal(0, 0.05, 3) + [0, 0, 0.43]), int(k % 3)) for k in range(300)]
    pts = spark.createDataFrame(rows, "point_id bigint, x double, y double, z double, label int")
    seen = depth.project(pts, cams).toPandas()
    image, labels = painter(seen.u.to_numpy(), seen.v.to_numpy(), seen.zc.to_numpy(), seen.label.to_numpy(), 16, 12)
    for r in depth.render(pts, cams, exact=True).collect():
        assert np.float32(r.depth) == image[r.v, r.u] and r.label == labels[r.v, r.u]
    assert depth.render(pts, cams, exact=True).count() == np.isfinite(image).sum() == depth.render(pts, cams).count()


def test_mock_scene_passes(spark):
    pixels, cams = synth.mock_scene(spark)
    assert pixels.count() == 4 * 128 * 96
    out = reconstruct(pixels, cams, 0.003, "s")
    q = out.quality.first()
    assert q.passed and q.metrics.hand_point_count > 100 and q.metrics.object_point_count > 100 and q.status == "ok"
    assert out.pose.first().status == "ok"
    hand = out.hands.first()
    assert hand.frame_status == "ok" and hand.hand_side == 1 and len(hand.joints_3d_left_m) == 21 and len(hand.hand_angles_20dof_rad) == 20
    none = reconstruct(pixels.where("label = 0"), cams)
    assert none.quality.first().warnings == ["one_or_more_views_have_low_valid_depth_ratio", "fused_point_count_below_threshold", "no_hand_points", "no_object_points"]
    empty = none.hands.first()
    assert empty.frame_status == "invalid" and not any(empty.valid_joint_mask) and sum(map(sum, empty.joints_3d_left_m)) == 0
    assert none.pose.first().status == "partial"
