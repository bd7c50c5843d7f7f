"""Many scenes at once are each scene alone; tables of scenes are written in three ways and read in part."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from cloudframe.plans import loop_queries, scenes
from cloudframe.plans.reconstruct import reconstruct

DATA = "/root/testdata/sf0.001"
SIZE = 0.05


@pytest.fixture(scope="module")
def several(spark):
    pixels, cameras = loop_queries.several_scenes(spark, DATA)
    return pixels.persist(), cameras


def plain(value):
    """A row as dicts and lists; the last bits of a sum may differ, and acos near 1 makes them more."""
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, str) and value.startswith("{"):
        return plain(json.loads(value))
    return [plain(v) for v in value] if isinstance(value, list) else value


def test_each_scene_as_alone(spark, several):
    pixels, cameras = several
    out = scenes.reconstruct_scenes(pixels, cameras, SIZE, is_right=False, frame_index=3)
    tables = {name: {r.scene_id: plain(r.asDict(recursive=True)) for r in getattr(out, name).collect()} for name in ("poses", "quality", "hands", "meta")}
    voxels = out.voxels.groupBy("scene_id").count().collect()
    assert all(sorted(t) == ["0", "1", "2", "3", "4"] for t in tables.values()) and sorted(r.scene_id for r in voxels) == ["0", "1", "2", "3"]
    assert out.stats.count() == 35
    for scene in ("1", "3", "4"):
        one = reconstruct(pixels.where(F.col("scene_id") == scene), cameras.where(F.col("scene_id") == scene), SIZE, scene, False, 3)
        for name, want in (("poses", one.pose), ("quality", one.quality), ("hands", one.hands), ("meta", one.meta)):
            row = plain(want.first().asDict(recursive=True))
            got = {k: v for k, v in tables[name][scene].items() if k in row}
            assert got == row, (scene, name)
        one.release()
    assert tables["quality"]["3"]["warnings"] == ["no_object_points"] or "no_object_points" in tables["quality"]["3"]["warnings"]
    assert tables["hands"]["4"]["frame_status"] == "invalid" and tables["poses"]["4"]["status"] == "partial"
    out.release()


def rows(df):
    return sorted((r.scene_id, r.view_idx, r.u, r.v, r.depth, r.label) for r in df.select("scene_id", "view_idx", "u", "v", "depth", "label").collect())


def test_tables_of_scenes(spark, several, tmp_path):
    pixels, cameras = several
    folder = str(tmp_path / "tables")
    scenes.write_scene_tables(pixels, cameras, folder)
    read, views = scenes.read_scene_tables(spark, folder)
    assert rows(read) == rows(pixels) and views.count() == 35
    plan = read.where("scene_id = '2' AND view_idx = 1 AND depth > 0.5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scene_id" in plan and "GreaterThan(depth,0.5)" in plan
    with pytest.raises(Exception, match="already exists"):
        scenes.write_scene_tables(pixels, cameras, folder)
    with pytest.raises(ValueError):
        scenes.write_scene_tables(pixels, cameras, folder, "other")
    one = pixels.where("scene_id = '2' AND view_idx = 1").withColumn("depth", F.lit(0.25).cast("float"))
    files = set(glob.glob(f"{folder}/pixels/scene_id=1/**/*.parquet", recursive=True))
    scenes.write_scene_tables(one, cameras.where("scene_id = '2'"), folder, "replace")
    read, views = scenes.read_scene_tables(spark, folder)
    assert rows(read) == rows(pixels.where("NOT (scene_id = '2' AND view_idx = 1)").unionByName(one)) and views.count() == 35
    assert set(glob.glob(f"{folder}/pixels/scene_id=1/**/*.parquet", recursive=True)) == files
    scenes.write_scene_tables(pixels.where("scene_id = '0'").withColumn("scene_id", F.lit("9")), cameras.where("scene_id = '4'").withColumn("scene_id", F.lit("9")), folder, "append")
    read, views = scenes.read_scene_tables(spark, folder)
    assert read.where("scene_id = '9'").count() == pixels.where("scene_id = '0'").count() and views.count() == 42
    scenes.write_scene_tables(one, cameras.where("scene_id = '2'"), folder, "overwrite")
    read, views = scenes.read_scene_tables(spark, folder)
    assert rows(read) == rows(one) and views.count() == 7


def test_job(spark, several, tmp_path):
    pixels, cameras = several
    scenes.write_scene_tables(pixels, cameras, str(tmp_path / "in"))
    failed = scenes.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), SIZE)
    assert failed == spark.read.parquet(str(tmp_path / "out/quality")).where("NOT passed").count() > 0
    assert spark.read.parquet(str(tmp_path / "out/hands")).count() == 5


def test_tiles_hold_every_point_once(spark, tmp_path):
    import numpy as np

    from cloudframe.operators import tiles

    rng = np.random.default_rng(5)
    places = np.vstack([rng.normal(0, 0.05, (3000, 3)), rng.uniform(-1, 1, (500, 3)), np.full((70, 3), 0.3), [[9.0, -9.0, 0.0]]])
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(places)] + [(0, 10**6, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame int, point_id bigint, x double, y double, z double").repartition(4)
    tiled = tiles.tile_points(df, (-1.0, -1.0, -1.0), 2.0, 30).persist()
    leaves = tiled.where("is_leaf")
    assert sorted(r.point_id for r in leaves.collect()) == list(range(len(places)))
    sizes = tiled.groupBy("frame", "level", *tiles.PLACE, "is_leaf").count().collect()
    assert all(r["count"] <= 30 or r.is_leaf and r.level == tiles.DEPTH for r in sizes) and max(r.level for r in sizes) > 3
    inner = [r for r in sizes if not r.is_leaf]
    assert sum(r["count"] == 30 for r in inner) > 0.9 * len(inner)  # a cut by the hash hardly ever leaves fewer
    for r in leaves.where(f"level < {tiles.DEPTH}").limit(200).collect():
        for c, k in zip("xyz", tiles.PLACE, strict=True):
            place = min(max(int(np.floor((r[c] + 1) / 2 * 4096)), 0), 4095)
            assert r[k] == place >> (tiles.DEPTH - r.level)
    by_level = {}
    for r in tiled.collect():
        by_level.setdefault((r.frame, r.point_id), set()).add(r.level)
    # Once seen, a point stays: it is in every node on the way down to its leaf.
    assert all(found == set(range(min(found), max(found) + 1)) for found in by_level.values())
    tiles.write_tiles(tiled, str(tmp_path / "tiles"))
    read = spark.read.parquet(str(tmp_path / "tiles"))
    assert read.where("frame = 1 AND level <= 1").count() == tiled.where("frame = 1 AND level <= 1").count() and read.count() == tiled.count()
