"""Checks of data sets: counts, checksums, smallest capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_counts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and count of the lines that aren't blank, for each file; 0 for an empty file, null for one that isn't there."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    there = {p: qualified(spark, p) for p in wanted if path_exists(spark, p)}
    asked = spark.createDataFrame([(p, there.get(p)) for p in wanted], "path string, file string")
    if not there:
        return asked.select("path", F.lit(None).cast("bigint").alias("frame_count"))
    place = lambda c: F.regexp_replace(c, ":/+", ":/")  # noqa: E731  file:/x and file:///x are one file
    lines = spark.read.text(list(there)).select(place(F.col("_metadata.file_path")).alias("place"), "value")
    counts = lines.groupBy("place").agg(F.count_if(F.trim("value") != "").alias("n"))
    met = asked.withColumn("place", place(F.col("file"))).join(counts, "place", "left")
    return met.select("path", F.when(F.col("file").isNotNull(), F.coalesce("n", F.lit(0))).cast("bigint").alias("frame_count"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's scheme, as Spark names a file's place."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def parse_checksums(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """path and expected_md5 of the lines of exactly two words; of a repeated path the last line's.

    order names a column with a line's number; without it lines count as they are read.
    """
    numbered = lines.withColumn("_line", F.col(order) if order else F.monotonically_increasing_id())
    words = F.split(F.trim(column), r"\s+")
    parsed = numbered.where(F.size(words) == 2).select(words[0].alias("path"), words[1].alias("expected_md5"), "_line")
    return parsed.groupBy("path").agg(F.max_by("expected_md5", "_line").alias("expected_md5"))


def verify_files(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """path, verified (null without a checksum), expected_md5, actual_md5 of files (path, content)."""
    joined = files.select("path", F.md5("content").alias("actual_md5")).join(checksums, "path", "left")
    return joined.select("path", (F.col("actual_md5") == F.col("expected_md5")).alias("verified"), "expected_md5", "actual_md5")


def smallest_capture(counts: DataFrame) -> DataFrame:
    """The capture of the least (frame_count, capture)."""
    return counts.where("frame_count is not null").agg(F.min(F.struct("frame_count", "capture")).alias("m")).where("m is not null").select("m.capture", "m.frame_count")


def capture_summary(spark: SparkSession, folder: str) -> DataFrame:
    """capture, mano_mesh_count, mano_param_count and has_mugsy_cam_params from the names of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    has = F.col("path").rlike
    return files.agg(
        F.lit(folder.rstrip("/").rsplit("/", 1)[-1]).alias("capture"), F.count_if(has(r"/mano_fits/meshes/[^/]+\.ply$")).alias("mano_mesh_count"),
        F.count_if(has(r"/mano_fits/params/[^/]+\.json$")).alias("mano_param_count"), (F.count_if(has("/Mugsy_cameras/cam_params.json$")) > 0).alias("has_mugsy_cam_params"),
    )


def present_captures(spark: SparkSession, data_root: str) -> list[str]:
    """Names of the folders in data_root, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(data_root)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(root) if x.isDirectory()) if store.exists(root) else []


def capture_counts(spark: SparkSession, data_root: str) -> DataFrame:
    """capture and frame_count (null without a frame list) of every capture's folder in data_root."""
    names = present_captures(spark, data_root)
    if not names:
        return spark.createDataFrame([], "capture string, frame_count bigint")
    counts = frame_counts(spark, [f"{data_root}/{name}/frame_list.txt" for name in names])
    return counts.select(F.element_at(F.split("path", "/"), -2).alias("capture"), "frame_count")
