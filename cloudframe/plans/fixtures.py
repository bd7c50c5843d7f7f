"""Point clouds, pixels and hand rows derived from the driver's tables, for Spark and as SQL.

The tables hold no clouds, so vectors give points and hands, and order lines give pixels.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.operators.synth import ring_cameras

VIEWS = 7
WIDTH, HEIGHT = 128, 96


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads: in spark.checkpoint.dir, or without that setting, as in tests, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = re.sub("^file:/+", "/", shared) or tempfile.gettempdir()
    if not place.startswith("/"):
        raise ValueError("files are written to a mounted folder; spark.checkpoint.dir names another store")
    os.makedirs(place, exist_ok=True)
    return tempfile.mkdtemp(prefix="files-", dir=place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, label 0..2, r, g, b, cloud 0..1 from the vectors' first components."""
    e, i = F.col("embedding"), F.col("vec_id")
    colors = {c: (i * k % 256).cast("smallint") for c, k in (("r", 37), ("g", 59), ("b", 83))}
    places = {c: e[k].cast("double") for k, c in enumerate("xyz")}
    return table(spark, sf_dir, "embeddings").select(i.alias("point_id"), *(v.alias(c) for c, v in places.items()), (F.col("label") % 3).alias("label"), *(v.alias(c) for c, v in colors.items()), (F.col("label") % 2).alias("cloud"))


def cloud(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return points(spark, sf_dir).where(F.col("cloud") == k)


def broken_cloud(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """A cloud of which every 23rd point or so isn't finite."""
    odd = {c: F.when(F.col("point_id") % 23 == 4, F.when(F.col("point_id") % 2 == 0, v).otherwise(F.col(c))).otherwise(F.col(c)) for c, v in (("x", F.lit(float("nan"))), ("y", F.lit(float("-inf"))))}
    odd["z"] = F.when((F.col("point_id") % 23 == 4) & (F.col("point_id") % 2 == 1), F.lit(None)).otherwise(F.col("z"))
    return cloud(spark, sf_dir, k).withColumns(odd)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_idx, u, v, depth, label: the cheapest order line of each pixel; some depths are made invalid."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") - 1).alias("view_idx"), (F.col("l_partkey") % WIDTH).cast("int").alias("u"), (F.col("l_orderkey") % HEIGHT).cast("int").alias("v"),
        (F.col("l_extendedprice") / 100000.0).alias("d"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("lab"),
    )
    nearest = lines.groupBy("view_idx", "u", "v").agg(F.min(F.struct("d", "lab")).alias("m"))
    return nearest.select("view_idx", "u", "v", F.when((F.col("u") + F.col("v")) % 11 == 0, 0.0).otherwise(F.col("m.d")).alias("depth"), F.col("m.lab").alias("label"))


def cameras(spark: SparkSession) -> DataFrame:
    return ring_cameras(spark, VIEWS, WIDTH, HEIGHT)


def _hands(rows: DataFrame, scale: Column) -> DataFrame:
    e = F.col("embedding")
    joints = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.array(*(e[j * 3 + c].cast("double") * scale for c in range(3))))
    mask = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.abs(e[j * 3].cast("double")) < 0.3)
    degrees = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: e[k].cast("double") * scale * 90.0)
    return rows.select(
        "row_id", F.col("vec_id").alias("frame_index"), F.when(F.col("vec_id") % 17 != 5, F.col("label") % 2).cast("bigint").alias("hand_side"), joints.alias("joints_3d_left_m"), joints[0].alias("root_translation_m"), mask.alias("valid_joint_mask"),
        degrees.alias("hand_angles_20dof_deg"), F.abs(e[63].cast("double")).alias("frame_confidence"), F.when(F.col("vec_id") % 20 == 0, "invalid").otherwise("ok").alias("frame_status"),
    )


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted rows: 21 joints from 63 components; every 17th has no side."""
    return _hands(table(spark, sf_dir, "embeddings").withColumn("row_id", F.col("vec_id")), F.lit(1.0))


def reference_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows, a little larger; some are left out and some come twice with different values."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 10 <> 3").withColumn("row_id", F.col("vec_id"))
    again = rows.where("vec_id % 50 = 7").withColumn("row_id", F.col("vec_id") + 1_000_000)
    return _hands(rows, F.lit(1.01)).unionByName(_hands(again, F.lit(1.02)))


CAMERAS_SQL = f"""eyes AS (SELECT k AS view_idx, 0.64::DOUBLE * cos(2 * pi() * k / {VIEWS} + pi() / 4) AS tx, 0.64::DOUBLE * sin(2 * pi() * k / {VIEWS} + pi() / 4) AS ty, 0.46::DOUBLE AS tz FROM range({VIEWS}) AS t(k)),
ahead AS (SELECT *, -tx / d AS fx, -ty / d AS fy, (0.43 - 0.46) / d AS fz FROM (SELECT *, sqrt(tx ** 2 + ty ** 2 + (0.43 - 0.46) ** 2) AS d FROM eyes)),
aside AS (SELECT *, fy / sqrt(fx ** 2 + fy ** 2) AS rx, -fx / sqrt(fx ** 2 + fy ** 2) AS ry FROM ahead),
cameras AS (SELECT view_idx, rx AS r00, -fz * ry AS r01, fx AS r02, ry AS r10, fz * rx AS r11, fy AS r12, 0.0::DOUBLE AS r20, fx * ry - fy * rx AS r21, fz AS r22, tx, ty, tz FROM aside)"""


def sql_views() -> str:
    """The same tables as common table expressions for DuckDB."""
    hand = """SELECT {row_id} AS row_id, vec_id AS frame_index, CASE WHEN vec_id % 17 <> 5 THEN (label % 2)::BIGINT END AS hand_side, {scale}::DOUBLE AS scale, embedding AS e,
  CASE WHEN vec_id % 20 = 0 THEN 'invalid' ELSE 'ok' END AS status FROM embeddings"""
    return f"""WITH points AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (label % 3)::BIGINT AS label,
  vec_id * 37 % 256 AS r, vec_id * 59 % 256 AS g, vec_id * 83 % 256 AS b, (label % 2)::BIGINT AS cloud FROM embeddings),
lines AS (SELECT (l_linenumber - 1)::BIGINT AS view_idx, (l_partkey % {WIDTH})::BIGINT AS u, (l_orderkey % {HEIGHT})::BIGINT AS v, l_extendedprice / 100000.0 AS d,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS lab FROM lineitem),
nearest AS (SELECT view_idx, u, v, min(d) AS d, min_by(lab, struct_pack(d := d, lab := lab)) AS lab FROM lines GROUP BY ALL),
pixels AS (SELECT view_idx, u, v, CASE WHEN (u + v) % 11 = 0 THEN 0.0 ELSE d END AS depth, lab::BIGINT AS label FROM nearest),
{CAMERAS_SQL},
camera_points AS (SELECT view_idx, u, v, label, (u - 63.5) * depth / 118.0 AS xc, (v - 47.5) * depth / 118.0 AS yc, depth AS zc FROM pixels WHERE depth > 0),
world AS (SELECT view_idx, u, v, label, r00 * xc + r01 * yc + r02 * zc + tx AS x, r10 * xc + r11 * yc + r12 * zc + ty AS y, r20 * xc + r21 * yc + r22 * zc + tz AS z
  FROM camera_points JOIN cameras USING (view_idx)),
hands AS ({hand.format(row_id="vec_id", scale="1.0")}),
twice AS ({hand.format(row_id="vec_id", scale="1.01")} WHERE vec_id % 10 <> 3 UNION ALL {hand.format(row_id="vec_id + 1000000", scale="1.02")} WHERE vec_id % 50 = 7),
reference AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY frame_index, hand_side ORDER BY row_id DESC) = 1),
matched AS (SELECT p.row_id, p.frame_index, p.hand_side, p.e, q.scale FROM hands p JOIN reference q USING (frame_index, hand_side)),
joint_rows AS (SELECT row_id, frame_index, hand_side, status, j, e[3 * j + 1]::DOUBLE AS x, e[3 * j + 2]::DOUBLE AS y, e[3 * j + 3]::DOUBLE AS z FROM hands, range(21) AS t(j)),
bones(bone, a, b) AS (VALUES (0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 0, 5), (5, 5, 6), (6, 6, 7), (7, 7, 8), (8, 0, 9), (9, 9, 10), (10, 10, 11), (11, 11, 12),
  (12, 0, 13), (13, 13, 14), (14, 14, 15), (15, 15, 16), (16, 0, 17), (17, 17, 18), (18, 18, 19), (19, 19, 20)),
bone_rows AS (SELECT p.row_id, bone, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS length FROM bones JOIN joint_rows p ON p.j = a JOIN joint_rows q ON q.j = b AND q.row_id = p.row_id),
steps AS (SELECT hand_side, frame_index, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM joint_rows WHERE j = 0
  WINDOW w AS (PARTITION BY hand_side ORDER BY frame_index, row_id)),
source AS (SELECT * FROM points WHERE cloud = 0),
target AS (SELECT * FROM points WHERE cloud = 1),
pairs AS (SELECT s.point_id, s.x, s.y, s.z, t.point_id AS target_id, t.x AS tx, t.y AS ty, t.z AS tz, sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2) AS distance
  FROM source s, target t WHERE s.point_id % 23 <> 4 AND t.point_id % 23 <> 4 QUALIFY row_number() OVER (PARTITION BY s.point_id ORDER BY distance, t.point_id) = 1)"""  # fmt: skip
