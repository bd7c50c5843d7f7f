"""The queries registered for the driver, and the SQL that DuckDB answers them with."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.functions.hand_angles import with_hand_angles, with_palm_frame
from cloudframe.functions.transforms import NAMES, applied, euler_matrix, make_transform
from cloudframe.functions.vectors import angle_between, bend, at, euler_rotation, minus, rotation_angle, rounded
from cloudframe.operators import accuracy, depth, files, hands, neighbours, points, registration, reports, synth
from cloudframe.plans import fixtures as fx
from cloudframe.plans.reconstruct import reconstruct
from cloudframe.plans.registration import register_clouds
from cloudframe.sources import scenes, store
from cloudframe.sources.hands import read_hands, write_hands

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VOXEL, GRID, NEAR, TRIM, MIN_PAIRS = 0.05, 0.02, 0.12, 0.9, 30
POSE = make_transform(euler_matrix(0.1, -0.2, 0.3), np.array([0.01, -0.02, 0.03]))


def query(select: str | None = None, more: str = "") -> Callable[[Query], Query]:
    """Register a query under its name; `select` is its SQL after the common tables, `more` further ones."""
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if select is not None:
            SQL[function.__name__] = fx.sql_views().replace("WITH ", "WITH RECURSIVE ", 1) + (",\n" + more if more else "") + "\n" + select
        return function

    return add


def r(expression: str, digits: int = 8) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def xyz(digits: int = 8, prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + c, digits)} AS {prefix}{c}" for c in "xyz")


def rounded_xyz(df: DataFrame, *keys: str, digits: int = 8, extra: tuple = ()) -> DataFrame:
    return df.select(*(F.col(k).cast("bigint").alias(k) for k in keys), *(rounded(c, digits).alias(c) for c in "xyz"), *extra)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


KEYS = "floor(x / {s}::DOUBLE)::BIGINT AS kx, floor(y / {s}::DOUBLE)::BIGINT AS ky, floor(z / {s}::DOUBLE)::BIGINT AS kz"
MEANS = ", ".join(f"(round(avg({c}), 8) + 0.0) AS {c}" for c in "xyz")


@query(f"SELECT kx, ky, kz, {MEANS}, count(*) AS n FROM (SELECT *, {KEYS.format(s=GRID)} FROM world) GROUP BY kx, ky, kz")
def multiview_fuse(spark, sf_dir):
    """The flagship: all views' pixels to world points on one voxel grid."""
    return rounded_xyz(depth.fuse_views(fx.pixels(spark, sf_dir), fx.cameras(spark), GRID), "kx", "ky", "kz", extra=("n",))


@query(f"SELECT point_id, {xyz()} FROM points WHERE point_id % 7 <> 0")
def validate_points(spark, sf_dir):
    broken = F.when(F.col("point_id") % 14 == 0, F.lit(float("nan"))).when(F.col("point_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("y"))
    return rounded_xyz(points.validate_points(fx.points(spark, sf_dir).withColumn("y", broken)), "point_id")


@query(f"SELECT view_idx, u, v, {r('xc', 11)} AS x, {r('yc', 11)} AS y, {r('zc', 11)} AS z FROM camera_points")
def depth_backproject(spark, sf_dir):
    return rounded_xyz(depth.backproject(fx.pixels(spark, sf_dir), fx.cameras(spark)), "view_idx", "u", "v", digits=11)


@query(f"SELECT view_idx, u, v, label, {r('xc', 11)} AS x, {r('yc', 11)} AS y, {r('zc', 11)} AS z FROM camera_points WHERE label IN (1, 2)")
def depth_backproject_labels(spark, sf_dir):
    return rounded_xyz(depth.backproject(fx.pixels(spark, sf_dir), fx.cameras(spark), [1, 2]), "view_idx", "u", "v", "label", digits=11)


@query(f"SELECT view_idx, {r('count(*) FILTER (WHERE depth > 0) / 12288.0')} AS depth_valid_ratio FROM pixels GROUP BY view_idx")
def depth_valid_ratio(spark, sf_dir):
    return depth.depth_valid_ratio(fx.pixels(spark, sf_dir), fx.cameras(spark)).select(F.col("view_idx").cast("bigint").alias("view_idx"), rounded("depth_valid_ratio").alias("depth_valid_ratio"))


@query(f"SELECT view_idx, u, v, {xyz()} FROM world")
def camera_to_world(spark, sf_dir):
    return rounded_xyz(depth.world_points(fx.pixels(spark, sf_dir), fx.cameras(spark)), "view_idx", "u", "v")


@query(f"SELECT kx, ky, kz, label, {MEANS}, count(*) AS n, grouping(label)::BIGINT AS all_labels FROM (SELECT *, {KEYS.format(s=GRID)} FROM world) GROUP BY GROUPING SETS ((kx, ky, kz), (kx, ky, kz, label))")
def fuse_by_label_grouping_sets(spark, sf_dir):
    voxels = points.voxels_by_label(depth.world_points(fx.pixels(spark, sf_dir), fx.cameras(spark)), GRID)
    return rounded_xyz(longs(voxels, "all_labels"), "kx", "ky", "kz", "label", extra=("n", "all_labels"))


@query(f"SELECT view_idx, {r('count(*) FILTER (WHERE depth > 0) / 12288.0')} AS depth_valid_ratio, count(*) FILTER (WHERE depth > 0) AS valid_depth_point_count, count(*) FILTER (WHERE depth > 0 AND label = 1) AS selected_point_count FROM pixels GROUP BY view_idx")
def per_view_stats(spark, sf_dir):
    stats = depth.per_view_stats(fx.pixels(spark, sf_dir), fx.cameras(spark), 1)
    return longs(stats, "view_idx").withColumn("depth_valid_ratio", rounded("depth_valid_ratio"))


@query(f"SELECT kx, ky, kz, {MEANS}, count(*) AS n FROM (SELECT *, {KEYS.format(s=VOXEL)} FROM points) GROUP BY kx, ky, kz")
def voxel_downsample(spark, sf_dir):
    return rounded_xyz(points.voxel_downsample(fx.points(spark, sf_dir).drop("r", "g", "b"), VOXEL), "kx", "ky", "kz", extra=("n",))


@query(f"SELECT kx, ky, kz, {MEANS}, trunc(avg(r))::BIGINT AS r, trunc(avg(g))::BIGINT AS g, trunc(avg(b))::BIGINT AS b, count(*) AS n FROM (SELECT *, {KEYS.format(s=VOXEL)} FROM points) GROUP BY kx, ky, kz")
def voxel_downsample_color(spark, sf_dir):
    return rounded_xyz(longs(points.voxel_downsample(fx.points(spark, sf_dir), VOXEL), "r", "g", "b"), "kx", "ky", "kz", extra=("r", "g", "b", "n"))


BOX = ", ".join(f"{r(f'min({c})')} AS min_{c}, {r(f'max({c})')} AS max_{c}, {r(f'avg({c})')} AS centre_{c}, {r(f'max({c}) - min({c})')} AS extent_{c}" for c in "xyz")


@query(f"SELECT label, count(*) AS point_count, {BOX} FROM points GROUP BY label")
def bbox_extent(spark, sf_dir):
    names = [f"{p}_{c}" for c in "xyz" for p in ("min", "max", "centre", "extent")]
    return longs(points.bounding_box(fx.points(spark, sf_dir), ("label",)), "label").withColumns({n: rounded(n) for n in names})


CONFIDENCE = "(round(least(0.95, greatest(0.05, count(*) / 900.0)), 6) + 0.0)"


@query(f"SELECT 'hand_0' AS id, 'ok' AS status, count(*) AS point_count, {CONFIDENCE} AS confidence, " + ", ".join(f"{r(f'avg({c})')} AS centre_{c}, {r(f'min({c})')} AS min_{c}, {r(f'max({c})')} AS max_{c}" for c in "xyz") + " FROM points WHERE label = 1")
def pose_estimate(spark, sf_dir):
    p = reports.pose(fx.points(spark, sf_dir).where("label = 1"), "hand", "hand_0")
    flat = [(f"translation_m[{k}]", f"centre_{c}") for k, c in enumerate("xyz")] + [(f"bbox_3d_m.{m}[{k}]", f"{m}_{c}") for m in ("min", "max") for k, c in enumerate("xyz")]
    return p.select("id", "status", "point_count", "confidence", *(F.expr(e).alias(n) for e, n in flat))


@query(f"SELECT 'ok' AS status, 'world' AS coordinate_frame, h.c AS hand_confidence, o.c AS object_confidence, {r('(h.c + o.c) / 2', 6)} AS mean_confidence FROM (SELECT {CONFIDENCE} AS c FROM points WHERE label = 1) h, (SELECT {CONFIDENCE} AS c FROM points WHERE label = 2) o")
def pose_output(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    out = reports.pose_output(p.where("label = 1"), p.where("label = 2"))
    hand, other = F.col("hands")[0]["confidence"], F.col("objects")[0]["confidence"]
    return out.select("status", "coordinate_frame", hand.alias("hand_confidence"), other.alias("object_confidence"), rounded((hand + other) / 2, 6).alias("mean_confidence"))


@query(
    f"""SELECT 'ok' AS status, 7::BIGINT AS view_count, true AS passed, 0::BIGINT AS n_warnings, {r('avg(ratio)', 6)} AS depth_valid_ratio_mean, (SELECT count(*) FROM v WHERE label = 1) AS hand_point_count,
  (SELECT count(*) FROM v WHERE label = 2) AS object_point_count, (SELECT count(*) FROM world) AS raw_point_count, (SELECT count(*) FROM v WHERE label IS NULL) AS fused_point_count,
  count(*) FILTER (WHERE ratio >= 0.01) AS views_with_valid_depth, (SELECT {r('max(x) - min(x)')} FROM v WHERE label IS NULL) AS extent_x,
  {r('count(*) FILTER (WHERE ratio >= 0.01) / 7.0', 6)} AS coverage_score FROM (SELECT view_idx, count(*) FILTER (WHERE depth > 0) / 12288.0 AS ratio FROM pixels GROUP BY view_idx)""",
    f"v AS (SELECT kx, ky, kz, label, avg(x) AS x FROM (SELECT *, {KEYS.format(s=GRID)} FROM world) GROUP BY GROUPING SETS ((kx, ky, kz), (kx, ky, kz, label)))",
)
def quality_report(spark, sf_dir):
    q = reconstruct(fx.pixels(spark, sf_dir), fx.cameras(spark), GRID).quality
    names = ("depth_valid_ratio_mean", "hand_point_count", "object_point_count", "raw_point_count", "fused_point_count", "views_with_valid_depth", "coverage_score")
    return q.select("status", "view_count", "passed", F.size("warnings").cast("bigint").alias("n_warnings"), *(f"metrics.{n}" for n in names), F.expr("metrics.bbox_extent_m[0]").alias("extent_x"))


@query(f"SELECT {r('sqrt((b.tx - a.tx) ** 2 + (b.ty - a.ty) ** 2 + (b.tz - a.tz) ** 2)')} AS baseline_m FROM cameras a, cameras b WHERE a.view_idx = 0 AND b.view_idx = 1 AND (SELECT count(DISTINCT view_idx) FROM pixels WHERE view_idx < 2) = 2")
def baseline(spark, sf_dir):
    """The distance of the first two views, of those that the table has pixels of."""
    seen = fx.cameras(spark).join(fx.pixels(spark, sf_dir).select("view_idx").distinct(), "view_idx", "left_semi")
    return depth.baseline(seen).select(rounded("baseline_m").alias("baseline_m"))


@query("SELECT s_suppkey AS camera, 100.0 + s_suppkey % 50 AS k00, 0.0 AS k01, 60.0 + s_suppkey % 7 AS k02, 100.0 + s_suppkey % 40 AS k11, 45.0 + s_suppkey % 5 AS k12, 1.0 AS k22 FROM supplier")
def intrinsics_matrix(spark, sf_dir):
    """The matrix of each of many cameras, a supplier each."""
    key = F.col("s_suppkey")
    lenses = fx.table(spark, sf_dir, "supplier").select(key.alias("camera"), *((low + key % n).alias(c) for c, low, n in (("fx", 100.0, 50), ("fy", 100.0, 40), ("cx", 60.0, 7), ("cy", 45.0, 5))))
    k = hands.intrinsics()
    return lenses.select("camera", *(k[i][j].alias(f"k{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))))


@query(f"SELECT point_id, {r('x * 0.001::DOUBLE', 12)} AS x, {r('y * 0.001::DOUBLE', 12)} AS y, {r('z * 0.001::DOUBLE', 12)} AS z FROM points")
def scale_cloud(spark, sf_dir):
    return rounded_xyz(points.scale_cloud(fx.points(spark, sf_dir), 0.001), "point_id", digits=12)


def _moved(k: int) -> str:
    return " + ".join(f"({float(POSE[k][j])!r})::DOUBLE * {c}" for j, c in enumerate("xyz")) + f" + ({float(POSE[k][3])!r})::DOUBLE"


@query("SELECT point_id, " + ", ".join(f"{r(_moved(k))} AS {c}" for k, c in enumerate("xyz")) + " FROM points")
def apply_transform(spark, sf_dir):
    return rounded_xyz(points.apply_transform(fx.points(spark, sf_dir), POSE), "point_id")


EULER = [["cos(z) * cos(y)", "cos(z) * sin(y) * sin(x) - sin(z) * cos(x)", "cos(z) * sin(y) * cos(x) + sin(z) * sin(x)"], ["sin(z) * cos(y)", "sin(z) * sin(y) * sin(x) + cos(z) * cos(x)", "sin(z) * sin(y) * cos(x) - cos(z) * sin(x)"], ["-sin(y)", "cos(y) * sin(x)", "cos(y) * cos(x)"]]


@query("SELECT point_id, " + ", ".join(f"{r(EULER[i][j])} AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM points")
def euler_rotate(spark, sf_dir):
    m = euler_rotation(F.col("x"), F.col("y"), F.col("z"))
    return fx.points(spark, sf_dir).select("point_id", *(rounded(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


@query(f"SELECT point_id, {r(f'acos(greatest(-1.0, least(1.0, ({EULER[0][0]} + {EULER[1][1]} + {EULER[2][2]} - 1.0) / 2.0)))', 6)} AS angle FROM points")
def rotation_angles(spark, sf_dir):
    return fx.points(spark, sf_dir).select("point_id", rounded(rotation_angle(euler_rotation(F.col("x"), F.col("y"), F.col("z"))), 6).alias("angle"))


@query(f"SELECT cloud_id, point_id, {xyz()} FROM (SELECT 'a' AS cloud_id, * FROM source UNION ALL SELECT 'b', * FROM target)")
def concat_clouds(spark, sf_dir):
    a, b = (fx.cloud(spark, sf_dir, k).withColumn("cloud_id", F.lit(name)) for k, name in ((0, "a"), (1, "b")))
    return points.concat_clouds([a, b.drop("r", "g", "b")]).select("cloud_id", "point_id", *(rounded(c).alias(c) for c in "xyz"))


@query(f"SELECT point_id, {xyz()} FROM points ORDER BY md5('20260702:' || point_id), point_id LIMIT 100")
def hash_sample_k(spark, sf_dir):
    return rounded_xyz(points.sample_points(fx.points(spark, sf_dir), 100), "point_id")


@query(f"SELECT {xyz()} FROM v ORDER BY kx, ky, kz", f"v AS (SELECT kx, ky, kz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT *, {KEYS.format(s=VOXEL)} FROM points) GROUP BY kx, ky, kz)")
def prepare_working_points(spark, sf_dir):
    """Voxel means under a cap that doesn't bind."""
    return points.working_points(fx.points(spark, sf_dir), VOXEL, 10**9, 11).select(*(rounded(c).alias(c) for c in "xyz"))


@query(f"SELECT point_id, target_id, {r('distance')} AS distance FROM pairs")
def nn_bruteforce(spark, sf_dir):
    found = neighbours.nearest_any(fx.broken_cloud(spark, sf_dir, 0), fx.broken_cloud(spark, sf_dir, 1))
    return found.select("point_id", "target_id", rounded("distance").alias("distance"))


@query(f"SELECT point_id, target_id, {r('distance')} AS distance FROM pairs WHERE distance <= {NEAR}")
def nn_within_threshold(spark, sf_dir):
    found = neighbours.nearest_within(fx.broken_cloud(spark, sf_dir, 0), fx.broken_cloud(spark, sf_dir, 1), NEAR)
    return found.select("point_id", "target_id", rounded("distance").alias("distance"))


TRIMMED = f"""kept AS (SELECT *, row_number() OVER (ORDER BY distance) AS rn, count(*) OVER () AS n FROM pairs),
trimmed AS (SELECT * FROM kept WHERE distance <= (SELECT max(distance) FROM kept WHERE rn = least(n, greatest({MIN_PAIRS}, ceil(n * {TRIM}::DOUBLE)))))"""


def _pairs(spark, sf_dir) -> DataFrame:
    found = neighbours.nearest_any(fx.broken_cloud(spark, sf_dir, 0), fx.broken_cloud(spark, sf_dir, 1)).withColumn("source_id", F.lit(0))
    return registration.trim_pairs(found, TRIM, MIN_PAIRS)


@query(f"SELECT count(*) AS pair_count, {r('avg(distance)')} AS mean_error, {r('sqrt(avg(distance * distance))')} AS rmse FROM trimmed", TRIMMED)
def trimmed_pair_stats(spark, sf_dir):
    return registration.pair_statistics(_pairs(spark, sf_dir)).select("pair_count", rounded("mean_error").alias("mean_error"), rounded("rmse").alias("rmse"))


@query("SELECT (SELECT n FROM c) AS pair_count, " + ", ".join(r(f"sum(({a} - c.p{a}) * (t{b} - c.q{b}))", 6) + f" AS h{a}{b}" for a in "xyz" for b in "xyz") + " FROM trimmed, c", TRIMMED + ",\nc AS (SELECT count(*) AS n, avg(x) AS px, avg(y) AS py, avg(z) AS pz, avg(tx) AS qx, avg(ty) AS qy, avg(tz) AS qz FROM trimmed)")
def cross_covariance(spark, sf_dir):
    h = registration.cross_covariance(_pairs(spark, sf_dir))
    return h.select("pair_count", *(rounded(f"h{a}{b}", 6).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"))


# The best rotation by another way than the engine's: the unit quaternion that is the first eigenvector of a symmetric
# 4x4 matrix of the covariance, made positive by a shift and squared until only that vector is left.
CENTRED = TRIMMED + """,
c AS (SELECT avg(x) AS px, avg(y) AS py, avg(z) AS pz, avg(tx) AS qx, avg(ty) AS qy, avg(tz) AS qz FROM trimmed),
h AS (SELECT """ + ", ".join(f"sum(({a} - c.p{a}) * (t{b} - c.q{b})) AS {a}{b}" for a in "xyz" for b in "xyz") + """ FROM trimmed, c),
n AS (SELECT xx + yy + zz AS m00, yz - zy AS m01, zx - xz AS m02, xy - yx AS m03, xx - yy - zz AS m11, xy + yx AS m12, zx + xz AS m13, yy - xx - zz AS m22, yz + zy AS m23, zz - xx - yy AS m33,
  2 * sqrt(""" + " + ".join(f"{a}{b} ** 2" for a in "xyz" for b in "xyz") + ") AS s FROM h)"
ENTRIES = [(i, j) for i in range(4) for j in range(i, 4)]


def _entry(i: int, j: int) -> str:
    return f"m{min(i, j)}{max(i, j)}"


SQUARED = ", ".join("(" + " + ".join(f"{_entry(i, k)} * {_entry(k, j)}" for k in range(4)) + f") / (m00 + m11 + m22 + m33) ** 2 AS {_entry(i, j)}" for i, j in ENTRIES)
QUATERNION = f"""{CENTRED},
power AS (SELECT 0 AS step, {', '.join(f'm{i}{j} + s AS m{i}{j}' if i == j else f'm{i}{j}' for i, j in ENTRIES)} FROM n UNION ALL SELECT step + 1, {SQUARED} FROM power WHERE step < 40),
last AS (SELECT *, greatest(m00, m11, m22, m33) AS top FROM power WHERE step = 40),
q AS (SELECT {', '.join("CASE " + " ".join(f"WHEN m{k}{k} = top THEN {_entry(i, k)}" for k in range(4)) + f" END / sqrt(top * (m00 + m11 + m22 + m33)) AS {name}" for i, name in enumerate("wxyz"))} FROM last),
turn AS (SELECT 1 - 2 * (y * y + z * z) AS r00, 2 * (x * y - w * z) AS r01, 2 * (x * z + w * y) AS r02, 2 * (x * y + w * z) AS r10, 1 - 2 * (x * x + z * z) AS r11, 2 * (y * z - w * x) AS r12,
  2 * (x * z - w * y) AS r20, 2 * (y * z + w * x) AS r21, 1 - 2 * (x * x + y * y) AS r22 FROM q)"""


@query(
    " UNION ALL ".join([f"SELECT {i} AS i, {j} AS j, {r(f'r{i}{j}', 6)} AS value FROM turn" for i in range(3) for j in range(3)] + [f"SELECT {i}, 3, {r(f'q{a} - r{i}0 * px - r{i}1 * py - r{i}2 * pz', 6)} FROM turn, c" for i, a in enumerate("xyz")]),
    QUATERNION,
)
def kabsch_fit(spark, sf_dir):
    """The best rotation and shift of the trimmed pairs, entry by entry."""
    row = registration.pair_moments(_pairs(spark, sf_dir), (0.0, 0.0, 0.0)).first()
    fitted = registration.fit_row(row, np.zeros(3))
    return spark.createDataFrame([(i, j, float(np.round(fitted[i, j], 6)) + 0.0) for i in range(3) for j in range(4)], "i int, j int, value double")


def _sources(spark, sf_dir) -> DataFrame:
    return fx.cloud(spark, sf_dir, 0).withColumn("source_id", F.col("label").cast("int"))


@query()
def icp_register(spark, sf_dir):
    results = registration.register(fx.cloud(spark, sf_dir, 0).withColumn("source_id", F.lit(0)), fx.cloud(spark, sf_dir, 1))
    return registration.report(spark, results)


@query()
def icp_multi_source(spark, sf_dir):
    return registration.report(spark, registration.register(_sources(spark, sf_dir), fx.cloud(spark, sf_dir, 1)))


@query()
def icp_merge(spark, sf_dir):
    target = fx.cloud(spark, sf_dir, 0).withColumn("cloud_id", F.lit("target"))
    sources = fx.cloud(spark, sf_dir, 1).withColumns({"cloud_id": F.lit("source"), "source_id": F.lit(0)})
    return register_clouds(target, sources, voxel_size=VOXEL, threshold=0.3)[2]


MOTIONS = [make_transform(euler_matrix(0.02 * (k - 1), 0.015, -0.01 * k), np.array([0.004, -0.003 * k, 0.002])) for k in range(3)]


@query(f"SELECT k::INT AS \"case\", point_id, {xyz(4)} FROM points, range(3) AS t(k)")
def icp_selftest(spark, sf_dir):
    """Three known motions of a cloud, each undone by registration: the points come back to where they were."""
    cloud = fx.points(spark, sf_dir).select("point_id", "x", "y", "z")
    copies = cloud.withColumn("source_id", F.explode(F.array(*(F.lit(k) for k in range(len(MOTIONS))))))
    moved = registration.with_transforms(copies, dict(enumerate(MOTIONS)))
    found = registration.register(moved, cloud, max_iterations=80, tolerance=1e-12)
    back = registration.with_transforms(moved, {r.source_id: r.transform for r in found})
    return back.select(F.col("source_id").alias("case"), "point_id", *(rounded(c, 4).alias(c) for c in "xyz"))


@query("SELECT row_id, frame_index, hand_side, round(scale * 100)::BIGINT AS percent FROM matched")
def match_rows(spark, sf_dir):
    m = accuracy.match_rows(fx.hands(spark, sf_dir), fx.reference_hands(spark, sf_dir))
    percent = F.round(F.try_divide(F.col("r.joints_3d_left_m")[0][0], F.col("p.joints_3d_left_m")[0][0]) * 100).cast("bigint")
    return m.select("p.row_id", "p.frame_index", "p.hand_side", percent.alias("percent"))


@query("SELECT p.row_id, round(q.scale * 100)::BIGINT AS percent FROM hands p JOIN twice q USING (row_id)")
def match_rows_by_position(spark, sf_dir):
    """Rows matched by their place, where a side lacks a key."""
    m = accuracy.match_rows(fx.hands(spark, sf_dir), fx.reference_hands(spark, sf_dir).drop("frame_index"))
    percent = F.round(F.try_divide(F.col("r.joints_3d_left_m")[0][0], F.col("p.joints_3d_left_m")[0][0]) * 100).cast("bigint")
    return m.select("p.row_id", percent.alias("percent"))


ERRORS = """errors AS (SELECT row_id, j, sqrt((e[3 * j + 1]::DOUBLE * (1 - scale)) ** 2 + (e[3 * j + 2]::DOUBLE * (1 - scale)) ** 2 + (e[3 * j + 3]::DOUBLE * (1 - scale)) ** 2) AS error
  FROM matched, range(21) AS t(j) WHERE abs(e[3 * j + 1]::DOUBLE) < 0.3)"""


def _matched(spark, sf_dir) -> DataFrame:
    return accuracy.match_rows(fx.hands(spark, sf_dir), fx.reference_hands(spark, sf_dir))


@query(f"SELECT row_id, j::BIGINT AS joint, {r('error')} AS error FROM errors", ERRORS)
def joint_error(spark, sf_dir):
    return longs(accuracy.joint_errors(_matched(spark, sf_dir)), "joint").select("row_id", "joint", rounded("error").alias("error"))


@query(f"SELECT {r('avg(error)')} AS mpjpe_m, {r('avg(error) * 1000', 6)} AS mpjpe_mm, {r('quantile_cont(error, 0.95)')} AS joint_error_p95_m FROM errors", ERRORS)
def mpjpe_report(spark, sf_dir):
    j = accuracy.joint_report(_matched(spark, sf_dir))
    return j.select(rounded("mpjpe_m").alias("mpjpe_m"), rounded("mpjpe_mm", 6).alias("mpjpe_mm"), rounded("joint_error_p95_m").alias("joint_error_p95_m"))


@query(f"SELECT count(*) AS matched_rows, {r('sqrt(avg((1 - scale) ** 2 * (e[1]::DOUBLE ** 2 + e[2]::DOUBLE ** 2 + e[3]::DOUBLE ** 2)))')} AS root_translation_rmse_m FROM matched")
def root_rmse(spark, sf_dir):
    return accuracy.root_rmse(_matched(spark, sf_dir)).withColumn("root_translation_rmse_m", rounded("root_translation_rmse_m"))


@query(f"SELECT {r('avg(abs(e[k + 1]::DOUBLE * (1 - scale) * 90.0))')} AS hand_angle_mae_deg FROM matched, range(20) AS t(k)")
def angle_mae(spark, sf_dir):
    return accuracy.angle_mae(_matched(spark, sf_dir)).withColumn("hand_angle_mae_deg", rounded("hand_angle_mae_deg"))


@query(f"SELECT row_id, bone::BIGINT AS bone, {r('length')} AS length FROM bone_rows")
def bone_lengths(spark, sf_dir):
    return longs(accuracy.bone_lengths(fx.hands(spark, sf_dir)), "bone").withColumn("length", rounded("length"))


@query(f"SELECT {r('median(step)')} AS root_step_median_m, {r('quantile_cont(step, 0.95)')} AS root_step_p95_m FROM steps WHERE step IS NOT NULL")
def root_step(spark, sf_dir):
    m = accuracy.root_step_metrics(fx.hands(spark, sf_dir))
    return m.select(*(rounded(c).alias(c) for c in m.columns))


SELF = f"""SELECT (SELECT count(*) FROM hands) AS row_count, (SELECT {r("avg((status = 'ok')::INT)")} FROM hands) AS ok_frame_ratio, (SELECT {r('avg((abs(x) < 0.3)::INT)')} FROM joint_rows) AS valid_joint_ratio,
  (SELECT {r('avg(abs(e[64]::DOUBLE))')} FROM hands) AS frame_confidence_mean, (SELECT {r('min(abs(e[64]::DOUBLE))')} FROM hands) AS frame_confidence_min,
  (SELECT {r('avg(length)')} FROM bone_rows) AS bone_length_mean_m, (SELECT {r('quantile_cont(length, 0.95)')} FROM bone_rows) AS bone_length_p95_m,
  (SELECT {r('median(step)')} FROM steps WHERE step IS NOT NULL) AS root_step_median_m, (SELECT {r('quantile_cont(step, 0.95)')} FROM steps WHERE step IS NOT NULL) AS root_step_p95_m"""  # fmt: skip


@query(SELF)
def self_consistency(spark, sf_dir):
    m = accuracy.self_consistency(fx.hands(spark, sf_dir))
    return m.select("row_count", *(rounded(c).alias(c) for c in m.columns if c != "row_count"))


@query(f"SELECT 'failed' AS status, false AS passed, 19::BIGINT AS n_missing, s.valid_joint_ratio < 0.95 AS low_valid, s.ok_frame_ratio < 0.95 AS low_ok, (SELECT count(*) FROM matched) AS matched_rows FROM s", f"s AS ({SELF})")
def accuracy_verdict(spark, sf_dir):
    v = accuracy.verdict(fx.hands(spark, sf_dir), None, fx.reference_hands(spark, sf_dir))
    has = lambda name: F.array_contains("warnings", name)
    return v.select("status", "passed", F.size("missing_fields").cast("bigint").alias("n_missing"), has("low_valid_joint_ratio").alias("low_valid"), has("low_ok_frame_ratio").alias("low_ok"), "reference_metrics.matched_rows")


def _v(a: str) -> list[str]:
    return [f"{a}.{c}" for c in "xyz"]


def _struct(parts: list[str]) -> str:
    return "{" + ", ".join(f"'{c}': {p}" for c, p in zip("xyz", parts, strict=True)) + "}"


def _minus(a: str, b: str) -> str:
    return _struct([f"{p} - {q}" for p, q in zip(_v(a), _v(b), strict=True)])


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{p} * {q}" for p, q in zip(_v(a), _v(b), strict=True))


def _cross(a: str, b: str) -> str:
    return _struct([f"{a}.{p} * {b}.{q} - {a}.{q} * {b}.{p}" for p, q in ("yz", "zx", "xy")])


def _unit(a: str, fallback: tuple) -> str:
    n = f"sqrt({_dot(a, a)})"
    return f"CASE WHEN {n} < 1e-12 THEN {_struct([f'{x}::DOUBLE' for x in fallback])} ELSE {_struct([f'{p} / {n}' for p in _v(a)])} END"


JOINTS = ", ".join(_struct([f"e[{3 * k + c + 1}]::DOUBLE" for c in range(3)]) + f" AS j{k}" for k in range(21))
PALM = f"""jj AS (SELECT row_id, {JOINTS} FROM hands),
d0 AS (SELECT *, {_minus('j17', 'j5')} AS across, {_minus('j9', 'j0')} AS up FROM jj),
d1 AS (SELECT *, {_unit('across', (1, 0, 0))} AS px, {_unit('up', (0, 1, 0))} AS y0 FROM d0),
d2 AS (SELECT *, {_cross('px', 'y0')} AS zc FROM d1), d3 AS (SELECT *, {_unit('zc', (0, 0, 1))} AS pz FROM d2),
d4 AS (SELECT *, {_cross('pz', 'px')} AS yc FROM d3), palm AS (SELECT *, CASE WHEN sqrt({_dot('yc', 'yc')}) < 1e-12 THEN y0 ELSE {_struct([f"{p} / sqrt({_dot('yc', 'yc')})" for p in _v('yc')])} END AS py FROM d4)"""


@query("SELECT row_id, " + ", ".join(f"{r(f'p{a}.{c}')} AS p{a}_{c}" for a in "xyz" for c in "xyz") + " FROM palm", PALM)
def palm_frame(spark, sf_dir):
    framed = with_palm_frame(fx.hands(spark, sf_dir), "joints_3d_left_m")
    return framed.select("row_id", *(rounded(f"palm_{a}.{c}").alias(f"p{a}_{c}") for a in "xyz" for c in "xyz"))


def _bend(a: int, b: int, c: int) -> str:
    p, q = [f"j{a}.{x} - j{b}.{x}" for x in "xyz"], [f"j{c}.{x} - j{b}.{x}" for x in "xyz"]
    dots = [" + ".join(f"({x}) * ({y})" for x, y in zip(m, n, strict=True)) for m, n in ((p, q), (p, p), (q, q))]
    return f"({math.pi!r} - acos(greatest(-1.0, least(1.0, ({dots[0]}) / (sqrt({dots[1]}) * sqrt({dots[2]}))))))"


def _base(a: int, b: int) -> tuple[str, str]:
    x, y, z = ("(" + " + ".join(f"p{axis}.{c} * (j{b}.{c} - j{a}.{c})" for c in "xyz") + ")" for axis in "xyz")
    return f"atan2({x}, {y})", f"atan2(abs({z}), {y})"


ANGLES = [*_base(1, 2)[::-1], _bend(1, 2, 3), _bend(2, 3, 4)] + [e for k in (5, 9, 13, 17) for e in (*_base(k, k + 1), _bend(k, k + 1, k + 2), _bend(k + 1, k + 2, k + 3))]


@query(f"SELECT row_id, {r(_bend(5, 6, 7), 7)} AS bent, {r(f'{math.pi!r} - {_bend(9, 10, 11)}', 7)} AS angle FROM palm", PALM)
def joint_flexion(spark, sf_dir):
    j = [at("joints_3d_left_m", k) for k in range(21)]
    return fx.hands(spark, sf_dir).select("row_id", rounded(bend(j[5], j[6], j[7]), 7).alias("bent"), rounded(angle_between(minus(j[9], j[10]), minus(j[11], j[10])), 7).alias("angle"))


@query(f"SELECT row_id, unnest(range(20))::BIGINT AS slot, round(unnest(a), 7) + 0.0 AS rad, round(degrees(unnest(a)), 5) + 0.0 AS deg FROM (SELECT row_id, [{', '.join(ANGLES)}] AS a FROM palm)", PALM)
def hand_angles_20dof(spark, sf_dir):
    out = with_hand_angles(fx.hands(spark, sf_dir).drop("hand_angles_20dof_deg"))
    rows = out.select("row_id", F.posexplode(F.arrays_zip("hand_angles_20dof_rad", "hand_angles_20dof_deg")).alias("slot", "a"))
    return rows.select("row_id", F.col("slot").cast("bigint").alias("slot"), rounded("a.hand_angles_20dof_rad", 7).alias("rad"), rounded("a.hand_angles_20dof_deg", 5).alias("deg"))


# Where each joint lies across, along and through the hand's box, as fractions of its sides.
LANDMARKS = """fractions(j, fc, fl, ft) AS (SELECT j, fc::DOUBLE, fl::DOUBLE, ft::DOUBLE FROM (VALUES
  (0, 0.52, 0.13, 0.0), (1, 0.12, 0.34, 0.0), (2, 0.04, 0.44, 0.04), (3, 0.0, 0.56, 0.08), (4, -0.04, 0.68, 0.1),
  (5, 0.25, 0.55, 0.0), (6, 0.25, 0.72, 0.0), (7, 0.25, 0.86, 0.0), (8, 0.25, 0.98, 0.0),
  (9, 0.45, 0.57, 0.0), (10, 0.45, 0.76, 0.0), (11, 0.45, 0.9, 0.0), (12, 0.45, 1.02, 0.0),
  (13, 0.65, 0.55, 0.0), (14, 0.65, 0.72, 0.0), (15, 0.65, 0.86, 0.0), (16, 0.65, 0.98, 0.0),
  (17, 0.84, 0.52, 0.0), (18, 0.84, 0.67, 0.0), (19, 0.84, 0.8, 0.0), (20, 0.84, 0.92, 0.0)) AS t(j, fc, fl, ft))"""

BOXES = ", ".join(f"min({c}) AS lo_{c}, greatest(max({c}) - min({c}), 1e-6) AS ex_{c}, avg({c}) AS ce_{c}" for c in "xyz")
RANKED = "ranked AS (SELECT *, list_sort([" + ", ".join(f"{{'e': ex_{c}, 'k': '{c}'}}" for c in "xyz") + "]) AS ax FROM boxes)"


def _landmark(c: str) -> str:
    return f"CASE WHEN '{c}' = ax[2].k THEN lo_{c} + fc * ex_{c} WHEN '{c}' = ax[3].k THEN lo_{c} + fl * ex_{c} ELSE ce_{c} + ft * ex_{c} END"


@query(
    "SELECT label, j::BIGINT AS joint, " + ", ".join(f"{r(_landmark(c))} AS {c}" for c in "xyz") + " FROM ranked, fractions",
    f"boxes AS (SELECT label, {BOXES} FROM points GROUP BY label),\n{RANKED},\n{LANDMARKS}",
)
def landmarks_21(spark, sf_dir):
    rows = hands.landmarks_of(fx.points(spark, sf_dir), ("label",)).select("label", F.posexplode("joints").alias("joint", "p"))
    return rows.select(F.col("label").cast("bigint").alias("label"), F.col("joint").cast("bigint").alias("joint"), *(rounded(F.col("p")[k]).alias(c) for k, c in enumerate("xyz")))


PLACED = f"""v AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT *, {KEYS.format(s=GRID)} FROM world WHERE label = 1) GROUP BY kx, ky, kz),
boxes AS (SELECT {BOXES} FROM v),
{RANKED},
{LANDMARKS},
placed AS (SELECT j, {', '.join(f'{_landmark(c)} AS {c}' for c in 'xyz')} FROM ranked, fractions)"""
IN_VIEW = ", ".join(f"{r(f'r0{k} * (x - tx) + r1{k} * (y - ty) + r2{k} * (z - tz)', 7)} AS {c}" for k, c in enumerate("xyz"))
BETWEEN = r("(SELECT sqrt((b.tx - a.tx) ** 2 + (b.ty - a.ty) ** 2 + (b.tz - a.tz) ** 2) FROM cameras a, cameras b WHERE a.view_idx = 0 AND b.view_idx = 1)")
PAYLOAD = f"SELECT j::BIGINT AS joint, 'ok' AS frame_status, 1::BIGINT AS hand_side, true AS valid, {IN_VIEW}, {BETWEEN} AS baseline_m FROM placed, cameras WHERE view_idx = 0"


def _joint_rows(rows: DataFrame, meta: DataFrame) -> DataFrame:
    rows = rows.crossJoin(meta.select("baseline_m")).select("frame_status", "hand_side", "baseline_m", F.posexplode(F.arrays_zip("joints_3d_left_m", "valid_joint_mask")).alias("joint", "j"))
    places = [rounded(F.col("j.joints_3d_left_m")[k], 7).alias(c) for k, c in enumerate("xyz")]
    return rows.select(F.col("joint").cast("bigint").alias("joint"), "frame_status", "hand_side", F.col("j.valid_joint_mask").alias("valid"), *places, rounded("baseline_m").alias("baseline_m"))


@query(PAYLOAD, PLACED)
def hand_payload(spark, sf_dir):
    """The normalized hand row and its file-level part, of the label 1 voxels, joint by joint."""
    out = reconstruct(fx.pixels(spark, sf_dir), fx.cameras(spark), GRID)
    return _joint_rows(out.hands, out.meta)


@query(PAYLOAD, PLACED)
def hand_file(spark, sf_dir):
    """The same row written as an NPZ file and read again."""
    out, path = reconstruct(fx.pixels(spark, sf_dir), fx.cameras(spark), GRID), f"{fx.scratch(spark)}/hands.npz"
    write_hands(out.hands, out.meta, path)
    out.release()
    return _joint_rows(*read_hands(spark, path))


@query(
    f"SELECT f AS cloud_id, row_number() OVER (PARTITION BY f ORDER BY kx, ky, kz) - 1 AS point_id, {xyz()}, CASE WHEN f <> 'grid_npy' THEN r END AS r FROM v, (SELECT unnest(['grid_ply', 'grid_npz', 'grid_npy']) AS f)",
    f"v AS (SELECT kx, ky, kz, avg(x) AS x, avg(y) AS y, avg(z) AS z, trunc(avg(r))::BIGINT AS r FROM (SELECT *, {KEYS.format(s=VOXEL)} FROM points) GROUP BY kx, ky, kz)",
)
def cloud_files(spark, sf_dir):
    """Voxel means written as PLY, NPZ and NPY files by the tasks and read again in parts."""
    folder, grid = fx.scratch(spark), points.voxel_downsample(fx.points(spark, sf_dir), VOXEL)
    read = []
    for kind in ("ply", "npz", "npy"):
        store.write_cloud_files(grid.withColumn("cloud_id", F.lit(f"grid_{kind}")), f"{folder}/{kind}", kind, order=("kx", "ky", "kz"))
        read.append(store.read_cloud_files(spark, f"{folder}/{kind}", part="4096"))
    rows = read[0].unionByName(read[1]).unionByName(read[2])
    return longs(rows, "r").select("cloud_id", "point_id", *(rounded(c).alias(c) for c in "xyz"), "r")


@query(f"SELECT view_idx::BIGINT AS view_idx, u, v, {r('depth::FLOAT::DOUBLE', 6)} AS depth, label FROM pixels WHERE depth > 0")
def scene_files(spark, sf_dir):
    """A scene's pixels written as npy files beside cameras.json and read again."""
    folder, black = fx.scratch(spark), {c: F.lit(0).cast("smallint") for c in "rgb"}
    scenes.write_scene(fx.pixels(spark, sf_dir).withColumns(black), fx.cameras(spark), folder)
    pixels, _ = scenes.read_scene(spark, folder)
    return longs(pixels.where("depth > 0"), "view_idx", "u", "v", "label").select("view_idx", "u", "v", rounded(F.col("depth").cast("double"), 6).alias("depth"), "label")


INVERSE = ", ".join(f"r0{k} * (x - tx) + r1{k} * (y - ty) + r2{k} * (z - tz) AS {c}" for k, c in enumerate(("xc", "yc", "zc")))
PROJECTED = f"""inv AS (SELECT c.view_idx::BIGINT AS view_idx, point_id, label, {INVERSE} FROM points, cameras c),
placed AS (SELECT view_idx, point_id, label, zc, round_even(118.0 * xc / zc + 63.5, 0)::BIGINT AS u, round_even(118.0 * yc / zc + 47.5, 0)::BIGINT AS v FROM inv WHERE zc > 0.05),
seen AS (SELECT * FROM placed WHERE u BETWEEN 0 AND 127 AND v BETWEEN 0 AND 95)"""


@query(f"SELECT view_idx, point_id, u, v, {r('zc')} AS depth FROM seen", PROJECTED)
def project_to_pixels(spark, sf_dir):
    return longs(depth.project(fx.points(spark, sf_dir), fx.cameras(spark)), "view_idx").select("view_idx", "point_id", "u", "v", rounded("zc").alias("depth"))


@query(
    f"SELECT view_idx, u, v, {r('min(zc)::FLOAT::DOUBLE', 6)} AS depth, min_by(label, struct_pack(z := zc, i := point_id)) AS label FROM splat WHERE u BETWEEN 0 AND 127 AND v BETWEEN 0 AND 95 GROUP BY view_idx, u, v",
    PROJECTED + ",\nsplat AS (SELECT view_idx, point_id, label, zc, u + du AS u, v + dv AS v FROM seen, range(-1, 2) AS a(du), range(-1, 2) AS b(dv))",
)
def zbuffer(spark, sf_dir):
    seen = depth.render(fx.points(spark, sf_dir).drop("r", "g", "b"), fx.cameras(spark))
    return longs(seen, "view_idx", "u", "v", "label").select("view_idx", "u", "v", rounded(F.col("depth").cast("double"), 6).alias("depth"), "label")


TAU = repr(2 * math.pi)
#: Where the shape of a supplier lies.
PLACES = {"x": (7, 0.1), "y": (5, 0.2), "z": (3, 0.3)}


def _shapes(spark, sf_dir) -> tuple[DataFrame, tuple]:
    """A shape for each supplier, and its centre."""
    shapes = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shape"))
    return shapes, tuple(F.col("shape") % n * step for n, step in PLACES.values())


def _placed(expression: str, c: str) -> str:
    n, step = PLACES[c]
    return f"{r(f'{expression} + s_suppkey % {n} * {step}::DOUBLE')} AS {c}"


@query(f"SELECT s_suppkey AS shape, k AS point_id, {_placed('0.038 * cos(u) * sin(v)', 'x')}, {_placed('0.022 * sin(u) * sin(v)', 'y')}, {_placed('0.052 * cos(v)', 'z')} FROM supplier, (SELECT k, (k % 12) * {TAU} / 12 AS u, {0.08 * math.pi!r} + (k // 12) * {0.84 * math.pi!r} / 5 AS v FROM range(72) AS t(k))")
def ellipsoid_surface(spark, sf_dir):
    shapes, centre = _shapes(spark, sf_dir)
    return rounded_xyz(synth.ellipsoid(spark, centre, (0.038, 0.022, 0.052), 12, 6, shapes), "shape", "point_id")


@query(f"SELECT s_suppkey AS shape, k AS point_id, {_placed('-0.01 * cos(a)', 'x')}, {_placed('-0.01 * sin(a)', 'y')}, {_placed('t * 0.5', 'z')} FROM supplier, (SELECT k, (k % 5) / 4.0 AS t, (k // 5) * {TAU} / 12 AS a FROM range(60) AS t(k))")
def cylinder_surface(spark, sf_dir):
    """Upright cylinders, for which the second helper axis is taken."""
    shapes, base = _shapes(spark, sf_dir)
    return rounded_xyz(synth.cylinder(spark, base, (0.0, 0.0, 0.5), 0.01, 5, 12, shapes), "shape", "point_id")


def _side(k: int, half: float) -> str:
    free = ("c", "CASE WHEN f < 4 AND f >= 2 THEN 0 WHEN f < 2 THEN w ELSE c END", "w")[k]
    low = 4 - 2 * k
    return f"CASE WHEN f = {low} THEN {-half} WHEN f = {low + 1} THEN {half} ELSE {-half} + {free} * {2 * half} / 4 END"


@query("SELECT s_suppkey AS shape, k AS point_id, " + ", ".join(_placed(_side(k, half), c) for k, (c, half) in enumerate({"x": 0.1, "y": 0.2, "z": 0.3}.items())) + " FROM supplier, (SELECT k, k // 25 AS f, k % 25 // 5 AS w, k % 5 AS c FROM range(150) AS t(k))")
def box_surface(spark, sf_dir):
    shapes, centre = _shapes(spark, sf_dir)
    return rounded_xyz(synth.box(spark, centre, (0.2, 0.4, 0.6), 5, shapes), "shape", "point_id")


def scene_points(spark, sf_dir) -> DataFrame:
    """The points as hand and object before the ring of cameras."""
    p = fx.points(spark, sf_dir)
    return p.withColumns({"x": F.col("x") * 0.3, "y": F.col("y") * 0.3, "z": F.col("z") * 0.3 + 0.43, "label": F.col("label").cast("smallint")}).drop("cloud")


@query()
def mock_scene_pixels(spark, sf_dir):
    """The points rendered as a mock scene is, every pixel of every view."""
    return synth.mock_scene(spark, points=scene_points(spark, sf_dir))[0]


@query("SELECT o_custkey AS capture, count(*) AS frame_count FROM orders GROUP BY o_custkey ORDER BY frame_count, capture LIMIT 1")
def argmin_capture(spark, sf_dir):
    counts = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("capture")).agg(F.count("*").alias("frame_count"))
    return files.smallest_capture(counts)


@query("SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS verified, md5(text) AS actual_md5 FROM documents")
def checksum_verify(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    half = docs.where(F.col("path").cast("bigint") % 2 == 0)
    lines = half.select("path", F.posexplode(F.array(F.lit("an earlier line"), F.when(F.col("path").cast("bigint") % 4 == 0, F.md5("content")).otherwise("0"))).alias("n", "sum"))
    sums = lines.select("n", F.concat_ws("  ", "path", F.regexp_replace("sum", " ", "-")).alias("value"))
    return files.verify_files(docs, files.parse_checksums(sums, order="n")).select(F.col("path").cast("bigint").alias("path"), "verified", "actual_md5")
