"""Data sources: large files in parts, many files in one job, all or nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.schemas import HANDS, HANDS_META
from cloudframe.sources import clouds, store
from cloudframe.sources.hands import clip_files, read_hands

NAMES = ("cloud_id", "point_id", "x", "y", "z", "r", "g", "b")


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(1)
    rows = [(c, k, *map(float, rng.normal(size=3)), *(int(v) for v in rng.integers(0, 256, 3))) for c, n in (("a", 900), ("b b", 1), ("c", 37)) for k in range(n)]
    return spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, r int, g int, b int").repartition(5), rows


def got(df):
    return sorted((r.cloud_id, r.point_id, r.x, r.y, r.z, r.r, r.g, r.b) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("kind", ["ply", "npy", "npz"])
def test_clouds_come_back(spark, three, kind, tmp_path):
    points, rows = three
    folder = str(tmp_path / "out")
    store.write_cloud_files(points, folder, kind)
    assert sorted(os.listdir(folder)) == [f"a.{kind}", f"b b.{kind}", f"c.{kind}"]
    want = sorted(rows) if kind != "npy" else sorted((*r[:5], None, None, None) for r in rows)
    for part in (None, "1000"):
        read = store.read_cloud_files(spark, folder, **({"part": part} if part else {}))
        assert got(read) == want
        many = read.rdd.getNumPartitions()
        assert many == 1 if part is None else many > 10 if kind != "npz" else many == 3
    assert got(clouds.read_clouds(spark, folder)) == want  # the other reader, of whole files
    two = store.read_cloud_files(spark, f"{folder}/a.{kind}", "x double, cloud_id string", part="500")
    assert two.columns == ["x", "cloud_id"] and sorted(r.x for r in two.collect()) == sorted(r[2] for r in rows if r[0] == "a")
    other = points.where("cloud_id = 'c'").withColumn("x", F.lit(1.0))
    store.write_cloud_files(other, folder, kind)
    assert len(os.listdir(folder)) == 3 and store.read_cloud_files(spark, folder).where("x = 1").count() == 37
    store.write_cloud_files(other, folder, kind, overwrite=True)
    assert os.listdir(folder) == [f"c.{kind}"]


def test_files_of_odd_kinds(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.arange(12.0).reshape(4, 3)))
    np.save(tmp_path / "wide.npy", np.array([[1, 2, 3, 9], [4, 5, 6, 9]], np.int32))
    bad = np.arange(300.0).reshape(100, 3)
    bad[7, 1] = np.nan
    np.save(tmp_path / "nan.npy", bad)
    read = store.read_cloud_files(spark, str(tmp_path), part="200")
    assert {r.cloud_id: r["count"] for r in read.groupBy("cloud_id").count().collect()} == {"f": 4, "wide": 2, "nan": 99}
    assert read.where("cloud_id = 'nan'").agg(F.max("point_id")).first()[0] == 99
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 50\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "short.ply").write_bytes(head + np.zeros(90, "<f4").tobytes())
    with pytest.raises(Exception, match="ends before"):
        store.read_cloud_files(spark, str(tmp_path / "short.ply"), part="200").count()


def test_a_failed_write_leaves_nothing(spark, three, tmp_path):
    points, _ = three
    folder = tmp_path / "out"
    store.write_cloud_files(points.where("cloud_id = 'c'"), str(folder))
    before = (folder / "c.ply").read_bytes()
    broken = points.withColumn("x", F.when(F.col("cloud_id") == "b b", F.raise_error(F.lit("stop")).cast("double")).otherwise(2.0))
    with pytest.raises(Exception, match="stop"):
        store.write_cloud_files(broken, str(folder), overwrite=True)
    assert os.listdir(folder) == ["c.ply"] and (folder / "c.ply").read_bytes() == before
    rows = spark.createDataFrame([("x/y.bin", b"1"), ("x/y.bin", b"2")], "path string, content binary").repartition(2, "content")
    with pytest.raises(Exception, match="several tasks"):
        store.write_contents(rows, str(tmp_path / "twice"))
    assert not os.path.exists(tmp_path / "twice/x")
    with pytest.raises(Exception, match="unsupported"):
        store.write_cloud_files(points, str(folder), "xyz")


def test_many_clips_in_one_write(spark, tmp_path):
    clips = spark.range(300).withColumnRenamed("id", "clip")
    value = {"left_row": "0L", "right_row": "-1L", "frame_index": "row_id"}
    sizes = {"array<double>": "array(1D, 2D, 3D)", "array<boolean>": "array(true, false)", "array<array<double>>": "array(array(1D, 2D), array(3D, 4D))", "array<string>": "array('a', 'b')", "string": "concat('clip ', clip)", "boolean": "true"}

    def column(f):
        return F.expr(value.get(f.name, sizes.get(f.dataType.simpleString(), "1"))).cast(f.dataType).alias(f.name)

    hands = clips.select("clip", F.explode(F.sequence(F.lit(0), F.col("clip") % 3)).alias("row_id"))
    hands = hands.select("clip", "row_id", *(column(f) for f in HANDS.fields if f.name != "row_id")).repartition(6)
    meta = clips.select("clip", *(column(f) for f in HANDS_META.fields))
    store.write_contents(clip_files(hands, meta), str(tmp_path / "clips"))
    assert len(os.listdir(tmp_path / "clips")) == 300
    rows, once = read_hands(spark, str(tmp_path / "clips"))
    assert rows.count() == 600 and once.count() == 300
    assert rows.where("frame_index <> row_id OR frame_status <> concat('clip ', regexp_extract(path, '([0-9]+).npz', 1))").count() == 0
