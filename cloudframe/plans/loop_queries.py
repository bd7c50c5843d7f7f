"""Queries of the closed loop (reprojection, depth residuals, distances between clouds, volumes and surfaces) and of many scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.vectors import rounded
from cloudframe.operators import closed_loop, tiles, tracking, tsdf
from cloudframe.operators.neighbours import nearest_any
from cloudframe.plans import fixtures as fx
from cloudframe.plans import scenes
from cloudframe.plans.queries import KEYS, VOXEL, longs, query, r

#: The stereo pair's baseline, and the voxels and truncation of the volume.
BASELINE, CELL, BAND = 0.06, 0.02, 0.05


def figures(df: DataFrame, *keys: str) -> DataFrame:
    return longs(df, *keys).select(*keys, "count", *(rounded(c, 6).alias(c) for c in ("mean", "median", "p95")), *(c for c in ("passed",) if c in df.columns))


FIGURES = f"count(*) AS count, {r('avg(error)', 6)} AS mean, {r('median(error)', 6)} AS median, {r('quantile_cont(error, 0.95)', 6)} AS p95"


def _observed(joints: DataFrame) -> DataFrame:
    """What a detector of other intrinsics might have seen; every ninth joint not at all."""
    x, y, z = (F.col(c) for c in "xyz")
    kept = (F.col("row_id") + F.col("joint")) % 9 != 0
    sides: list[Column] = [F.struct(F.lit(s).alias("side"), F.when(kept, 116.0 * (x - b) / z + 63.0).alias("u"), (117.0 * y / z + 48.0).alias("v")) for s, b in (("left", 0.0), ("right", 0.0595))]
    return joints.select("row_id", "joint", F.inline(F.array(*sides)))


def _reprojected(spark, sf_dir) -> DataFrame:
    joints = closed_loop.joint_rows(fx.hands(spark, sf_dir), "row_id").where("z > 0.02")
    projected = closed_loop.reproject_stereo(joints, 118.0, 118.0, 63.5, 47.5, BASELINE)
    return closed_loop.reprojection_errors(projected, _observed(joints), "row_id")


REPROJECTED = f"""reprojected AS (SELECT row_id, j AS joint, side, sqrt((118.0 * (x - b) / z + 63.5 - (116.0 * (x - o) / z + 63.0)) ** 2 + (118.0 * y / z + 47.5 - (117.0 * y / z + 48.0)) ** 2) AS error
  FROM joint_rows, (VALUES ('left', 0.0::DOUBLE, 0.0::DOUBLE), ('right', {BASELINE}::DOUBLE, 0.0595::DOUBLE)) AS s(side, b, o) WHERE abs(x) < 0.3 AND z > 0.02 AND (row_id + j) % 9 <> 0)"""


@query(f"SELECT joint::BIGINT AS joint, side, {FIGURES} FROM reprojected GROUP BY joint, side", REPROJECTED)
def reprojection_by_joint(spark, sf_dir):
    """Errors in pixels of each joint in either image."""
    found = closed_loop.grouped_errors(_reprojected(spark, sf_dir), "joint", "side")
    return longs(found, "joint").select("joint", "side", "count", *(rounded(c, 6).alias(c) for c in ("mean", "median", "p95")))


@query(f"SELECT row_id, {FIGURES}, avg(error) < 5.0 AND quantile_cont(error, 0.95) < 15.0 AS passed FROM reprojected GROUP BY row_id", REPROJECTED)
def reprojection_frames(spark, sf_dir):
    """Which rows explain what both images show."""
    return figures(closed_loop.frames_passed(_reprojected(spark, sf_dir), "row_id"), "row_id")


@query(f"SELECT {FIGURES} FROM reprojected", REPROJECTED)
def reprojection_overall(spark, sf_dir):
    found = closed_loop.overall_errors(_reprojected(spark, sf_dir))
    return found.select("count", *(rounded(c, 6).alias(c) for c in ("mean", "median", "p95")))


LOOKING = """looking AS (SELECT point_id, point_id % 7 AS view_idx, x * 0.5 AS x, y * 0.5 AS y, abs(z) + 0.2 AS z FROM points),
aimed AS (SELECT *, x * 118.0 / z + 63.5 AS pu, y * 118.0 / z + 47.5 AS pv FROM looking),
met AS (SELECT point_id, count(*) AS n, sum((CASE WHEN a = 1 THEN pu - floor(pu) ELSE floor(pu) + 1 - pu END) * (CASE WHEN b = 1 THEN pv - floor(pv) ELSE floor(pv) + 1 - pv END) * depth) AS surface
  FROM aimed, range(2) AS s(a), range(2) AS t(b), pixels p WHERE p.view_idx = aimed.view_idx AND p.u = floor(pu) + a AND p.v = floor(pv) + b AND p.depth > 0 GROUP BY point_id),
residuals AS (SELECT view_idx, point_id, surface, z - surface > 0.05 AS occluded, CASE WHEN z - surface <= 0.05 THEN abs(z - surface) END AS error FROM met JOIN aimed USING (point_id) WHERE n = 4)"""


def _residuals(spark, sf_dir) -> DataFrame:
    places = {"x": F.col("x") * 0.5, "y": F.col("y") * 0.5, "z": F.abs("z") + 0.2}
    looking = fx.points(spark, sf_dir).select("point_id", (F.col("point_id") % 7).alias("view_idx"), *(e.alias(c) for c, e in places.items()))
    return closed_loop.depth_residuals(looking, fx.pixels(spark, sf_dir), fx.cameras(spark))


@query(f"SELECT view_idx, point_id, {r('surface')} AS surface, occluded, {r('error')} AS residual FROM residuals", LOOKING)
def depth_residual(spark, sf_dir):
    """How far points lie from the surface that their view's depth shows."""
    return longs(_residuals(spark, sf_dir), "view_idx").select("view_idx", "point_id", rounded("surface").alias("surface"), "occluded", rounded("residual").alias("residual"))


@query(f"SELECT view_idx, {FIGURES}, avg(error) < 0.01 AS passed FROM residuals WHERE error IS NOT NULL GROUP BY view_idx", LOOKING)
def depth_residual_views(spark, sf_dir):
    errors = _residuals(spark, sf_dir).where("residual IS NOT NULL").withColumnRenamed("residual", "error")
    return figures(closed_loop.frames_passed(errors, "view_idx", mean=closed_loop.MEAN_M, p95=None), "view_idx")


BACK = """back AS (SELECT t.point_id, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS distance FROM source s, target t WHERE s.point_id % 23 <> 4 AND t.point_id % 23 <> 4 GROUP BY t.point_id)"""


@query(
    f"""SELECT a.n AS count_ab, b.n AS count_ba, {r('a.m')} AS mean_ab_m, {r('b.m')} AS mean_ba_m, {r('(sqrt(a.q) + sqrt(b.q)) / 2')} AS chamfer_l2_m
  FROM (SELECT count(*) AS n, avg(distance) AS m, avg(distance * distance) AS q FROM pairs) a, (SELECT count(*) AS n, avg(distance) AS m, avg(distance * distance) AS q FROM back) b""",
    BACK,
)
def chamfer_distance(spark, sf_dir):
    c = closed_loop.chamfer(fx.broken_cloud(spark, sf_dir, 0), fx.broken_cloud(spark, sf_dir, 1))
    return c.select("count_ab", "count_ba", *(rounded(n).alias(n) for n in ("mean_ab_m", "mean_ba_m", "chamfer_l2_m")))


@query()
def point_to_plane(spark, sf_dir):
    """Each point's distance from the plane through its nearest target; normals of 27 cells by eigenvectors."""
    target = fx.broken_cloud(spark, sf_dir, 1)
    pairs = nearest_any(fx.broken_cloud(spark, sf_dir, 0).select("point_id", *"xyz"), target)
    return closed_loop.point_to_plane(pairs, target, 2 * VOXEL).select("point_id", "target_id", rounded("plane_distance").alias("plane_distance"))


STEPS = round(2 * BAND / CELL)
VOLUME = f"""walls AS (SELECT view_idx, u // 4 AS u, v // 4 AS v, 0.3 + min(depth) * 0.1 AS depth FROM pixels WHERE depth > 0 GROUP BY ALL),
steps_along AS (SELECT view_idx, u, v, depth + s * ({CELL}::DOUBLE / 2) AS z FROM walls, range(-{STEPS}, {STEPS + 1}) AS t(s)),
ends AS (SELECT view_idx, (u - 15.5) * z / 29.5 AS xc, (v - 11.5) * z / 29.5 AS yc, z AS zc FROM steps_along WHERE z > 0),
touched AS (SELECT DISTINCT view_idx, floor((r00 * xc + r01 * yc + r02 * zc + tx) / {CELL}::DOUBLE)::BIGINT AS kx, floor((r10 * xc + r11 * yc + r12 * zc + ty) / {CELL}::DOUBLE)::BIGINT AS ky,
  floor((r20 * xc + r21 * yc + r22 * zc + tz) / {CELL}::DOUBLE)::BIGINT AS kz FROM ends JOIN cameras USING (view_idx)),
centred AS (SELECT *, (kx + 0.5) * {CELL}::DOUBLE - tx AS dx, (ky + 0.5) * {CELL}::DOUBLE - ty AS dy, (kz + 0.5) * {CELL}::DOUBLE - tz AS dz FROM touched JOIN cameras USING (view_idx)),
turned AS (SELECT view_idx, kx, ky, kz, r00 * dx + r10 * dy + r20 * dz AS xc, r01 * dx + r11 * dy + r21 * dz AS yc, r02 * dx + r12 * dy + r22 * dz AS zc FROM centred),
found AS (SELECT kx, ky, kz, (p.depth - zc) / {BAND}::DOUBLE AS t FROM turned q JOIN walls p ON p.view_idx = q.view_idx AND p.u = round_even(29.5 * xc / zc + 15.5, 0)::BIGINT AND p.v = round_even(29.5 * yc / zc + 11.5, 0)::BIGINT WHERE zc > 0)"""


def walls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The pixels as images of a fourth of the size that show rough walls, so that neighbouring ones meet the same voxels; and their cameras."""
    pixels = fx.pixels(spark, sf_dir).where("depth > 0").groupBy("view_idx", F.expr("u div 4").alias("u"), F.expr("v div 4").alias("v"))
    smaller = {"fx": 29.5, "fy": 29.5, "cx": 15.5, "cy": 11.5}
    return pixels.agg((0.3 + F.min("depth") * 0.1).alias("depth")), fx.cameras(spark).withColumns({k: F.lit(v) for k, v in smaller.items()})


@query(
    f"SELECT floor(kx / 8.0)::BIGINT AS bx, floor(ky / 8.0)::BIGINT AS by, floor(kz / 8.0)::BIGINT AS bz, kx, ky, kz, {r('avg(least(t, 1.0))', 6)} AS tsdf, count(*) AS weight FROM found WHERE t >= -1 GROUP BY kx, ky, kz",
    VOLUME,
)
def tsdf_volume(spark, sf_dir):
    """The signed distances of all views' pixels on one sparse grid."""
    return tsdf.integrate(*walls(spark, sf_dir), CELL, BAND).withColumn("tsdf", rounded("tsdf", 6))


@query()
def tsdf_surface(spark, sf_dir):
    """The volume's surface: a row a triangle."""
    found = tsdf.surface(tsdf.integrate(*walls(spark, sf_dir), CELL, BAND), CELL)
    return found.select(*tsdf.KEYS, *(rounded(F.col("triangle")[k][j], 6).alias(f"{c}{k}") for k in range(3) for j, c in enumerate("xyz")))


def several_scenes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Four scenes of the order lines by their suppliers, one of them without an object, and a fifth of cameras alone."""
    lines = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("string").alias("scene_id"), (F.col("l_linenumber") - 1).cast("int").alias("view_idx"), (F.col("l_partkey") % fx.WIDTH).cast("int").alias("u"), (F.col("l_orderkey") % fx.HEIGHT).cast("int").alias("v"),
        (F.col("l_extendedprice") / 100000.0).alias("d"), F.when(F.col("l_returnflag") == "R", 0).when((F.col("l_returnflag") == "A") | (F.col("l_suppkey") % 4 == 3), 1).otherwise(2).alias("lab"),
    )
    nearest = lines.groupBy("scene_id", "view_idx", "u", "v").agg(F.min(F.struct("d", "lab")).alias("m"))
    pixels = nearest.select("scene_id", "view_idx", "u", "v", F.col("m.d").cast("float").alias("depth"), F.col("m.lab").cast("smallint").alias("label"), *(F.lit(0).cast("smallint").alias(c) for c in "rgb"))
    ids = F.explode(F.array(*(F.lit(str(k)) for k in range(5))))
    return pixels, fx.cameras(spark).drop("scene_id").withColumn("scene_id", ids)


SCENES = f"""scene_lines AS (SELECT l_suppkey % 4 AS scene, (l_linenumber - 1)::BIGINT AS view_idx, (l_partkey % 128)::BIGINT AS u, (l_orderkey % 96)::BIGINT AS v, l_extendedprice / 100000.0 AS d,
  CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' OR l_suppkey % 4 = 3 THEN 1 ELSE 2 END AS lab FROM lineitem),
scene_pixels AS (SELECT scene, view_idx, u, v, min(d)::FLOAT::DOUBLE AS depth, min_by(lab, struct_pack(d := d, lab := lab)) AS label FROM scene_lines GROUP BY scene, view_idx, u, v),
scene_ends AS (SELECT scene, view_idx, label, (u - 63.5) * depth / 118.0 AS xc, (v - 47.5) * depth / 118.0 AS yc, depth AS zc FROM scene_pixels WHERE depth > 0),
scene_points AS (SELECT scene, label, r00 * xc + r01 * yc + r02 * zc + tx AS x, r10 * xc + r11 * yc + r12 * zc + ty AS y, r20 * xc + r21 * yc + r22 * zc + tz AS z FROM scene_ends JOIN cameras USING (view_idx)),
scene_voxels AS (SELECT scene, label, grouping(label) AS everything, kx, ky, kz, avg(x) AS x, count(*) AS n FROM (SELECT *, {KEYS.format(s=CELL)} FROM scene_points) GROUP BY GROUPING SETS ((scene, kx, ky, kz), (scene, kx, ky, kz, label))),
scene_views AS (SELECT scene, view_idx, count(*) FILTER (WHERE depth > 0) / 12288.0 AS ratio FROM scene_pixels GROUP BY scene, view_idx),
scene_counts AS (SELECT scene, count(*) FILTER (WHERE everything = 1) AS n_fused, count(*) FILTER (WHERE label = 1) AS n_hand, count(*) FILTER (WHERE label = 2) AS n_object,
  coalesce(sum(n) FILTER (WHERE everything = 1), 0)::BIGINT AS n_raw, max(x) FILTER (WHERE everything = 1) - min(x) FILTER (WHERE everything = 1) AS extent FROM scene_voxels GROUP BY scene)"""


@query(
    f"""SELECT s.id::VARCHAR AS scene_id, 7::BIGINT AS view_count, coalesce(n_raw, 0) AS raw_point_count, coalesce(n_fused, 0) AS fused_point_count, coalesce(n_hand, 0) AS hand_point_count, coalesce(n_object, 0) AS object_point_count,
  coalesce(good, 0) AS views_with_valid_depth, {r('coalesce(extent, 0)')} AS extent_x, {r('coalesce(total, 0) / 7', 6)} AS depth_valid_ratio_mean,
  coalesce(good, 0) = 7 AND coalesce(n_fused, 0) >= 100 AND coalesce(n_hand, 0) > 0 AND coalesce(n_object, 0) > 0 AS passed,
  {r("(CASE WHEN coalesce(n_hand, 0) = 0 THEN 0 ELSE least(0.95, greatest(0.05, n_hand / 900.0)) END).round(6) / 2 + (CASE WHEN coalesce(n_object, 0) = 0 THEN 0 ELSE least(0.95, greatest(0.05, n_object / 900.0)) END).round(6) / 2", 6)} AS pose_confidence_mean
  FROM range(5) AS s(id) LEFT JOIN scene_counts c ON c.scene = s.id LEFT JOIN (SELECT scene, count(*) FILTER (WHERE ratio >= 0.01) AS good, sum(ratio) AS total FROM scene_views GROUP BY scene) w ON w.scene = s.id""",
    SCENES,
)
def scene_reports(spark, sf_dir):
    """The quality reports of several scenes from one job."""
    q = scenes.reconstruct_scenes(*several_scenes(spark, sf_dir), CELL).quality
    names = ("raw_point_count", "fused_point_count", "hand_point_count", "object_point_count", "views_with_valid_depth", "depth_valid_ratio_mean", "pose_confidence_mean")
    return q.select("scene_id", "view_count", "passed", *(f"metrics.{n}" for n in names), F.expr("metrics.bbox_extent_m[0]").alias("extent_x"))


@query(f"SELECT scene::VARCHAR AS scene_id, view_idx, u, v, {r('CASE WHEN scene = 2 THEN depth / 2 ELSE depth END', 6)} AS depth FROM scene_pixels WHERE scene IN (1, 2)", SCENES)
def scene_tables(spark, sf_dir):
    """Scenes stored as tables; one of them replaced in place, two read again."""
    folder, (pixels, cameras) = fx.scratch(spark), several_scenes(spark, sf_dir)
    scenes.write_scene_tables(pixels, cameras, folder)
    nearer = pixels.where("scene_id = '2'").withColumn("depth", (F.col("depth").cast("double") / 2).cast("float"))
    scenes.write_scene_tables(nearer, cameras.where("scene_id = '2'"), folder, "replace")
    read, _ = scenes.read_scene_tables(spark, folder)
    kept = read.where("scene_id IN ('1', '2')")
    return longs(kept, "view_idx", "u", "v").select("scene_id", "view_idx", "u", "v", rounded(F.col("depth").cast("double"), 6).alias("depth"))


#: How far a hand may move between frames, and the filter's share of what is new.
GATE, ALPHA = 0.6, 0.4


def clips(spark, sf_dir) -> DataFrame:
    """The hand rows as two clips of two hands a frame."""
    rows = fx.hands(spark, sf_dir).drop("frame_index", "hand_side")
    return rows.withColumns({"clip": F.col("row_id") % 2, "frame_index": F.expr("row_id div 8"), "hand_side": F.expr("row_id div 2 % 2")})


CLIPS = f"""clip_rows AS (SELECT row_id, row_id % 2 AS clip, row_id // 8 AS frame, row_id // 2 % 2 AS side, status, e[1]::DOUBLE AS x, e[2]::DOUBLE AS y, e[3]::DOUBLE AS z FROM hands),
near AS (SELECT p.row_id AS before, n.row_id AS after, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.z - n.z) * (p.z - n.z)) AS d
  FROM clip_rows p JOIN clip_rows n ON n.clip = p.clip AND n.side = p.side AND n.frame = p.frame + 1 WHERE p.status = 'ok' AND n.status = 'ok'),
links AS (SELECT before, after FROM near WHERE d <= {GATE} QUALIFY row_number() OVER (PARTITION BY before ORDER BY d, after) = 1 AND row_number() OVER (PARTITION BY after ORDER BY d, before) = 1),
walk AS (SELECT row_id, row_id AS track_id, 0::BIGINT AS track_at, CASE WHEN status = 'ok' THEN x END AS sx, CASE WHEN status = 'ok' THEN y END AS sy, CASE WHEN status = 'ok' THEN z END AS sz FROM clip_rows WHERE row_id NOT IN (SELECT after FROM links)
  UNION ALL SELECT n.row_id, w.track_id, w.track_at + 1, {ALPHA}::DOUBLE * n.x + (1 - {ALPHA}::DOUBLE) * w.sx, {ALPHA}::DOUBLE * n.y + (1 - {ALPHA}::DOUBLE) * w.sy, {ALPHA}::DOUBLE * n.z + (1 - {ALPHA}::DOUBLE) * w.sz
  FROM walk w JOIN links l ON l.before = w.row_id JOIN clip_rows n ON n.row_id = l.after)"""


@query(f"SELECT row_id, track_id, track_at, {r('sx')} AS x, {r('sy')} AS y, {r('sz')} AS z FROM walk", CLIPS)
def smooth_tracks(spark, sf_dir):
    """Tracks of hands, and their joints smoothed along them: the root joint of each row."""
    tracked = tracking.with_tracks(clips(spark, sf_dir), GATE)
    joints = tracking.smooth(tracked, ALPHA, ("joints_3d_left_m", "hand_angles_20dof_deg"))
    return joints.select("row_id", "track_id", "track_at", *(rounded(F.col("joints_3d_left_m_smooth")[0][k]).alias(c) for k, c in enumerate("xyz")))


#: The cube of the tiles, and the points of one.
CUBE, TILE = 4.0, 20
TILES = f"""cells AS (SELECT point_id % 5 AS frame, point_id, {", ".join(f"least(greatest(floor(({c} + 2.0) / {CUBE}::DOUBLE * 4096), 0), 4095)::BIGINT AS i{c}" for c in "xyz")} FROM points),
levels AS (SELECT frame, point_id, level::INT AS level, ix >> (12 - level)::INT AS kx, iy >> (12 - level)::INT AS ky, iz >> (12 - level)::INT AS kz FROM cells, range(13) AS t(level)),
sized AS (SELECT *, count(*) OVER (PARTITION BY frame, level, kx, ky, kz) AS n FROM levels),
leaves AS (SELECT * FROM sized WHERE n <= {TILE} OR level = 12 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY level) = 1)"""


@query("SELECT frame, level, kx, ky, kz, count(*) AS points, min(point_id) AS first_point FROM leaves GROUP BY ALL", TILES)
def frame_tiles(spark, sf_dir):
    """The leaves of five frames' octrees."""
    tiled = tiles.tile_points(fx.points(spark, sf_dir).withColumn("frame", F.col("point_id") % 5), (-CUBE / 2,) * 3, CUBE, TILE)
    return tiled.where("is_leaf").groupBy("frame", "level", *tiles.PLACE).agg(F.count("*").alias("points"), F.min("point_id").alias("first_point"))
