"""Reprojection, depth residuals, clouds' distances and volumes against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import closed_loop, tsdf
from cloudframe.operators.synth import ring_cameras
from cloudframe.plans import fixtures as fx
from cloudframe.plans import loop_queries as queries

DATA = "/root/testdata/sf0.001"
POINT = "point_id bigint, x double, y double, z double"


def cloud(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], POINT)


def test_stereo_reprojection(spark):
    joints = spark.createDataFrame([(1, 0, 0.1, -0.2, 0.5), (1, 1, 0.0, 0.0, 1.0)], "row_id int, joint int, x double, y double, z double")
    seen = closed_loop.reproject_stereo(joints, 100.0, 110.0, 50.0, 40.0, 0.06)
    rows = {r.joint: r for r in seen.collect()}
    assert (rows[0].left_u, rows[0].left_v, rows[0].right_u, rows[0].right_v) == pytest.approx((70.0, -4.0, 58.0, -4.0))
    observed = spark.createDataFrame([(1, 0, "left", 73.0, 0.0), (1, 0, "right", None, 1.0), (1, 1, "right", 44.0, 41.0), (2, 1, "left", 1.0, 1.0)], "row_id int, joint int, side string, u double, v double")
    errors = closed_loop.reprojection_errors(seen, observed, "row_id")
    assert {(r.joint, r.side): r.error for r in errors.collect()} == {(0, "left"): pytest.approx(5.0), (1, "right"): pytest.approx(1.0)}
    (frame,) = closed_loop.frames_passed(errors, "row_id").collect()
    assert (frame["count"], frame["mean"], frame["median"], frame["p95"], frame["passed"]) == (2, 3.0, 3.0, pytest.approx(4.8), True)
    assert closed_loop.overall_errors(errors.where("false")).first()["count"] == 0


def test_joints_that_count(spark):
    hands = spark.createDataFrame([(1, [[0.0, 0.0, 1.0], [0.0, 0.0, -1.0], [float("nan"), 0.0, 1.0], [1.0, 1.0, 1.0]], [True, True, True, False])], "row_id int, joints_3d_left_m array<array<double>>, valid_joint_mask array<boolean>")
    assert [r.joint for r in closed_loop.joint_rows(hands, "row_id").collect()] == [0]
    assert [r.joint for r in closed_loop.joint_rows(hands.drop("valid_joint_mask"), "row_id").collect()] == [0, 3]


def test_residuals_from_a_slope(spark):
    """A surface whose depth is linear in u and v is interpolated exactly; a hole, an edge and an occluder aren't."""
    pixels = spark.createDataFrame([(0, u, v, 0.0 if (u, v) == (3, 3) else 1.0 + 0.01 * u + 0.02 * v) for u in range(8) for v in range(6)], "view_idx int, u int, v int, depth double")
    cameras = spark.createDataFrame([(0, 1.0, 1.0, 0.0, 0.0)], "view_idx int, fx double, fy double, cx double, cy double")
    asked = [(1.5, 2.25, 0.004), (0.0, 0.0, -0.03), (2.5, 3.5, 0.0), (7.5, 1.0, 0.0), (4.2, 1.1, 0.2), (6.0, 4.0, 0.0), (5.5, 0.5, float("nan"))]
    rows = [(k, 0, u * (d := 1.0 + 0.01 * u + 0.02 * v + off), v * d, d) for k, (u, v, off) in enumerate(asked)]
    got = {r.point_id: r for r in closed_loop.depth_residuals(spark.createDataFrame(rows, "point_id int, view_idx int, x double, y double, z double"), pixels, cameras).collect()}
    assert sorted(got) == [0, 1, 4, 5]
    assert (got[0].residual, got[1].residual, got[5].residual) == pytest.approx((0.004, 0.03, 0.0), abs=1e-12)
    assert got[4].occluded and got[4].residual is None and not got[0].occluded


def brute_normals(points, size, least=5):
    keys = np.floor(points / size).astype(int)
    out = {}
    for key in {tuple(k) for k in keys}:
        near = points[(np.abs(keys - key) <= 1).all(axis=1)]
        if len(near) >= least:
            values, vectors = np.linalg.eigh(np.cov(near.T, bias=True))
            normal = vectors[:, 0]
            last = max(k for k in range(3) if abs(normal[k]) > 1e-9)
            out[key] = (normal * (1 if normal[last] > 0 else -1), values[0] / values.sum())
    return out


def test_normals_are_those_of_27_cells(spark):
    rng = np.random.default_rng(2)
    plane = np.column_stack([rng.uniform(-3, 3, 900), rng.uniform(-3, 3, 900)])
    points = np.column_stack([plane, 0.3 * plane[:, 0] - 0.5 * plane[:, 1] + rng.normal(0, 0.01, 900)]) + 1e3
    want = brute_normals(points, 0.5)
    got = {(r.kx, r.ky, r.kz): r for r in closed_loop.cell_normals(cloud(spark, [*points, [np.nan, 0, 0]]), 0.5).collect()}
    assert got.keys() == want.keys()
    for k, (normal, flat) in want.items():
        assert np.allclose([got[k].nx, got[k].ny, got[k].nz], normal, atol=1e-5) and got[k].flatness == pytest.approx(flat, abs=1e-8)
    true = np.array([-0.3, 0.5, 1.0]) / np.sqrt(1.34)
    assert np.mean([np.dot(n, true) > 0.99 for n, _ in want.values()]) > 0.95


def test_point_to_plane_query(spark):
    def places(k):
        rows = sorted((r.point_id, r.x, r.y, r.z) for r in fx.cloud(spark, DATA, k).collect() if r.point_id % 23 != 4)
        return np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])

    (ids, p), (target_ids, t) = places(0), places(1)
    normals = brute_normals(t, 2 * queries.VOXEL)
    got = {r.point_id: r for r in queries.point_to_plane(spark, DATA).collect()}
    assert sorted(got) == ids.tolist()
    none = 0
    for k, place in zip(ids, p, strict=True):
        near = int(((t - place) ** 2).sum(axis=1).argmin())
        found = normals.get(tuple(np.floor(t[near] / (2 * queries.VOXEL)).astype(int)))
        assert got[k].target_id == target_ids[near]
        if found is None:
            none += 1
            assert got[k].plane_distance is None
        else:
            assert got[k].plane_distance == pytest.approx(abs((place - t[near]) @ found[0]), abs=1e-6)
    assert none < len(ids)


def test_cloud_report(spark):
    rng = np.random.default_rng(4)
    plane = np.column_stack([rng.uniform(0, 2, (800, 2)), np.zeros(800)])
    lifted = plane[:300] + [0.0, 0.0, 0.03]
    row = closed_loop.cloud_report(cloud(spark, [*lifted, [50, 50, 50]]), cloud(spark, plane), 0.2, 0.1).first()
    assert (row.pair_count, row.icp_rmse_m, row.point_to_plane_rmse_m) == (300, pytest.approx(0.03), pytest.approx(0.03)) and row.icp_fitness == pytest.approx(300 / 301)
    same = closed_loop.chamfer(cloud(spark, plane), cloud(spark, plane)).first()
    assert (same.count_ab, same.chamfer_l2_m) == (800, 0.0)


RADIUS, MIDDLE, VOXEL = 0.15, np.array([0.0, 0.0, 0.43]), 0.012


@pytest.fixture(scope="module")
def sphere(spark):
    """Depth images of a sphere from the ring of cameras, by the quadratic formula in SQL."""
    cameras = ring_cameras(spark, 8, 128, 96).withColumns({"fx": F.col("fx") * 2, "fy": F.col("fy") * 2})
    pixels = cameras.select("*", F.explode(F.sequence(F.lit(0), F.lit(128 * 96 - 1))).alias("k")).withColumns({"u": F.expr("k % 128"), "v": F.expr("k div 128")})
    pixels = pixels.withColumns({"a": F.expr("(u - cx) / fx"), "b": F.expr("(v - cy) / fy")})
    middle = {f"m{c}": F.expr(f"r0{k} * (0 - tx) + r1{k} * (0 - ty) + r2{k} * (0.43 - tz)") for k, c in enumerate("xyz")}
    pixels = pixels.withColumns(middle).withColumns({"qa": F.expr("a * a + b * b + 1"), "qb": F.expr("a * mx + b * my + mz")}).withColumn("disc", F.expr(f"qb * qb - qa * (mx * mx + my * my + mz * mz - {RADIUS ** 2})"))
    depth = F.when(F.col("disc") > 0, (F.col("qb") - F.sqrt(F.greatest("disc", F.lit(0.0)))) / F.col("qa")).otherwise(0.0)
    return pixels.select("view_idx", "u", "v", depth.alias("depth")).persist(), cameras


def test_a_sphere_comes_back(spark, sphere):
    pixels, cameras = sphere
    volume = tsdf.integrate(pixels, cameras, VOXEL, 3 * VOXEL).persist()
    row = volume.agg(F.min("tsdf").alias("low"), F.max("tsdf").alias("high"), F.max("weight").alias("most"), F.count_if(F.expr("bx <> floor(kx / 8) or by <> floor(ky / 8) or bz <> floor(kz / 8)")).alias("wrong")).first()
    assert -1 <= row.low < -0.5 and row.high == 1 and row.most >= 3 and row.wrong == 0
    found = tsdf.surface(volume, VOXEL).toPandas()
    triangles = np.array([[list(p) for p in t] for t in found.triangle])
    assert len(triangles) > 2000
    away = np.linalg.norm(triangles - MIDDLE, axis=2)
    assert np.abs(away - RADIUS).max() < VOXEL
    normal = np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0])
    assert ((normal * (triangles.mean(axis=1) - MIDDLE)).sum(axis=1) > 0).mean() > 0.99  # they face outwards
    assert 0.5 * np.linalg.norm(normal, axis=1).sum() > 0.5 * 4 * np.pi * RADIUS**2  # what a ring of cameras above sees
    # Each edge inside the surface is shared by two triangles that run along it in opposite ways.
    corners = np.round(triangles, 9)
    edges = {}
    for t in corners:
        for a, b in ((0, 1), (1, 2), (2, 0)):
            edges[tuple(t[a]), tuple(t[b])] = edges.get((tuple(t[a]), tuple(t[b])), 0) + 1
    paired = sum((b, a) in edges for a, b in edges)
    assert paired / len(edges) > 0.9


def test_volumes_merge_as_one(spark, sphere):
    pixels, cameras = sphere
    parts = [tsdf.integrate(pixels.where(f"view_idx % 2 = {k}"), cameras, VOXEL, 3 * VOXEL) for k in (0, 1)]
    both = {(r.kx, r.ky, r.kz): (r.weight, round(r.tsdf, 9)) for r in tsdf.merge_volumes(*parts).collect()}
    assert both == {(r.kx, r.ky, r.kz): (r.weight, round(r.tsdf, 9)) for r in tsdf.integrate(pixels, cameras, VOXEL, 3 * VOXEL).collect()}


def test_surface_of_a_table_by_brute_force(spark):
    """The query's triangles lie on edges whose ends differ in sign, where the distance is zero between them."""
    volume = tsdf.integrate(*queries.walls(spark, DATA), queries.CELL, queries.BAND).collect()
    value = {(r.kx, r.ky, r.kz): r.tsdf for r in volume}
    cells = [k for k in value if all((k[0] + a, k[1] + b, k[2] + c) in value for a, b, c in tsdf.CORNERS)]
    crossed = {k for k in cells if min(v := [value[k[0] + a, k[1] + b, k[2] + c] for a, b, c in tsdf.CORNERS]) < 0 <= max(v)}
    got = queries.tsdf_surface(spark, DATA).collect()
    assert {(r.kx, r.ky, r.kz) for r in got} == crossed and len(got) > len(crossed) > 0
    for r in got:
        low = (np.array([r.kx, r.ky, r.kz]) + 0.5) * queries.CELL
        for p in np.array(r[3:]).reshape(3, 3):
            assert (p > low - 1e-5).all() and (p < low + queries.CELL + 1e-5).all()


def test_nothing_to_see(spark, sphere):
    pixels, cameras = sphere
    empty = tsdf.integrate(pixels.where("depth < 0"), cameras, VOXEL, 3 * VOXEL)
    assert empty.count() == 0 and tsdf.surface(empty, VOXEL).count() == 0
    one = tsdf.cut_cells(np.zeros((1, 3)), np.array([[-1.0, 1, 1, 1, 1, 1, 1, 1]]), 1.0)
    assert len(one[0]) == 6 and np.allclose(one[1].max(), 0.5)
