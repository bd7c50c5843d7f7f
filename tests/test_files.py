import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import files, synth
from cloudframe.plans import accuracy, dataset, reconstruct, registration
from cloudframe.sources import clouds, scenes
from cloudframe.sources.hands import read_hands


def binary_ply(points, colors):
    kind = np.dtype([(c, "<f4") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")])
    table = np.zeros(len(points), kind)
    for k, c in enumerate("xyz"):
        table[c] = points[:, k]
    for k, c in enumerate(("red", "green", "blue")):
        table[c] = colors[:, k]
    head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n" % len(points) + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    return (head + "end_header\n").encode() + table.tobytes()


def test_ply_both_ways(spark, tmp_path):
    pts, rgb = np.arange(12.0).reshape(4, 3), np.arange(12).reshape(4, 3)
    (tmp_path / "b.ply").write_bytes(binary_ply(pts, rgb))
    read = clouds.read_clouds(spark, str(tmp_path / "b.ply"))
    assert [(r.x, r.y, r.z, r.r, r.g, r.b) for r in read.orderBy("point_id").collect()] == [(*map(float, p), *map(int, c)) for p, c in zip(pts, rgb, strict=True)]
    assert clouds.write_ply(read, str(tmp_path / "c.ply")) == 4
    text = (tmp_path / "c.ply").read_text().splitlines()
    assert text[2] == "element vertex 4" and text[-1] == "9.00000000 10.00000000 11.00000000 9 10 11"
    again = clouds.read_clouds(spark, str(tmp_path / "c.ply"))
    assert again.select("x", "y", "z", "r").collect() == read.select("x", "y", "z", "r").collect()
    clouds.write_ply(read.drop("r"), str(tmp_path / "d.ply"))
    assert clouds.read_clouds(spark, str(tmp_path / "d.ply")).where("r is null").count() == 4


@pytest.mark.parametrize("head", ["format binary_big_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\n", "format ascii 1.0\nelement vertex 1\nproperty list uchar int x\n", "format ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\n"])
def test_ply_errors(head):
    with pytest.raises(ValueError):
        clouds.parse_ply(f"ply\n{head}end_header\n1 2 3\n".encode())


def test_npz_and_npy(spark, tmp_path):
    pts = np.array([[0.0, 1, 2, 9], [np.nan, 0, 0, 9], [3, 4, 5, 9]])
    np.savez(tmp_path / "a.npz", other=np.zeros((2, 3)), raw_points=pts, raw_colors=np.array([[1, 2, 3], [4, 5, 6], [7, 8, 900]]))
    rows = clouds.read_clouds(spark, str(tmp_path / "a.npz")).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.r, r.b) for r in rows] == [(0, 0.0, 1, 3), (2, 3.0, 7, 255)]
    assert clouds.read_clouds(spark, str(tmp_path / "a.npz"), "other").count() == 2
    np.savez(tmp_path / "b.npz", text=np.array(["x"]), some=np.ones((1, 3)))
    assert clouds.read_clouds(spark, str(tmp_path / "b.npz")).first().x == 1.0
    np.save(tmp_path / "c.npy", pts)
    assert clouds.read_clouds(spark, str(tmp_path / "c.npy")).first().cloud_id == "c"
    (tmp_path / "d.xyz").write_text("1 2 3")
    with pytest.raises(Exception, match="unsupported"):
        clouds.read_clouds(spark, str(tmp_path / "d.xyz")).count()


def test_scene_round_trip(spark, tmp_path):
    pixels, cameras = synth.mock_scene(spark, 2, width=32, height=24, focal=30.0)
    scenes.write_scene(pixels, cameras, str(tmp_path / "s"))
    back, cams = scenes.read_scene(spark, str(tmp_path / "s"))
    names = ["view_idx", "v", "u", "depth", "label", "r", "g", "b"]
    assert back.select(names).exceptAll(pixels.select(names)).count() == 0 and back.count() == pixels.count()
    assert np.allclose([r.tx for r in cams.orderBy("view_idx").collect()], [r.tx for r in cameras.orderBy("view_idx").collect()])
    before = (tmp_path / "s" / "cameras.json").read_text()
    scenes.write_scene(pixels, cameras.limit(1), str(tmp_path / "s"))
    assert (tmp_path / "s" / "cameras.json").read_text() == before
    np.save(tmp_path / "s/frames/view_00/mask.npy", np.zeros((3, 3), np.uint8))
    with pytest.raises(Exception, match="size"):
        scenes.read_scene(spark, str(tmp_path / "s"))[0].count()


def test_demo_and_accuracy_of_its_hand_file(spark, tmp_path):
    summary = reconstruct.run(spark, str(tmp_path / "scene"), str(tmp_path / "out"))
    assert summary["passed"] and summary["point_counts"]["hand"] > 100 and summary["parameters"] == {"voxel_size_m": 0.003, "hand_side": "right"}
    assert len(summary["per_view_stats"]) == 4 and all(v["depth_valid_ratio"] > 0 for v in summary["per_view_stats"])
    assert all(os.path.exists(p) for p in summary["outputs"].values())
    hands, meta = read_hands(spark, str(tmp_path / "out/hands.npz"))
    row = hands.first()
    assert row.frame_status == "ok" and row.is_right and len(row.joints_3d_left_m) == 21 and json.loads(row.summary_json)["hand_side"] == 1
    assert len(meta.first().K) == 3
    found = accuracy.evaluate(spark, str(tmp_path / "out/hands.npz"), str(tmp_path / "out/hands.npz"))
    assert found["passed"] and found["missing_fields"] == [] and found["reference_metrics"]["mpjpe_m"] == 0.0
    assert json.loads((tmp_path / "out/quality.json").read_text())["passed"]


def test_registration_job(spark, tmp_path):
    hand = synth.registration_hand(spark).persist()
    clouds.write_ply(hand, str(tmp_path / "t.ply"))
    clouds.write_ply(hand.withColumn("x", F.col("x") + 0.004), str(tmp_path / "s.ply"))
    (tmp_path / "more").mkdir()
    clouds.write_ply(hand.withColumn("x", F.col("x") - 0.003), str(tmp_path / "more/s.ply"))
    (tmp_path / "init.json").write_text(json.dumps({"s": np.eye(4).tolist()}))
    init = registration.load_transforms(str(tmp_path / "init.json"))
    summary = registration.run(spark, str(tmp_path / "t.ply"), [str(tmp_path / "s.ply"), str(tmp_path / "more/s.ply")], str(tmp_path / "o"), transforms=init, max_points=1500, max_iterations=30)
    source, other = summary["sources"]
    assert other["output_ply"].endswith("aligned_02_s.ply") and source["output_ply"].endswith("aligned_01_s.ply") and os.path.exists(summary["target_ply"])
    assert abs(other["transform"][0][3] - 0.003) < 0.002 and summary["method"] == "point_to_point_icp" and summary["parameters"]["max_points"] == 1500 and summary["parameters"]["trim"] == 0.9
    assert source["used_initial_transform"] and source["status"] in ("converged", "max_iterations") and source["mean_error"] < 0.002
    assert abs(source["transform"][0][3] + 0.004) < 0.002 and summary["merged_point_count"] > 100
    (tmp_path / "bad.json").write_text(json.dumps({"s": [[1]]}))
    with pytest.raises(ValueError):
        registration.load_transforms(str(tmp_path / "bad.json"))


def test_data_set_checks(spark, tmp_path):
    (tmp_path / "frame_list.txt").write_text("a\n\n b \n")
    (tmp_path / "empty.txt").write_text("")
    asked = [str(tmp_path / name) for name in ("frame_list.txt", "empty.txt", "none.txt")]
    assert {r.path: r.frame_count for r in files.frame_counts(spark, asked).collect()} == dict(zip(asked, (2, 0, None), strict=True))
    assert files.frame_counts(spark, asked[2]).first().frame_count is None
    twice = spark.createDataFrame([(1, "a  ff"), (2, "a  00"), (3, "a b c")], "n int, value string")
    assert [tuple(r) for r in files.parse_checksums(twice, order="n").collect()] == [("a", "00")]
    lines = spark.createDataFrame([("a  900150983cd24fb0d6963f7d28e17f72",), ("b x y",), ("",), ("c 0",)], "value string")
    content = spark.createDataFrame([("a", b"abc"), ("b", b""), ("c", b"c")], "path string, content binary")
    got = {r.path: r.verified for r in files.verify_files(content, files.parse_checksums(lines)).collect()}
    assert got == {"a": True, "b": None, "c": False}
    counts = spark.createDataFrame([("x", 3), ("b", 2), ("a", 2), ("n", None)], "capture string, frame_count int")
    assert files.smallest_capture(counts).first().capture == "a" and files.smallest_capture(counts.limit(0)).count() == 0
    (tmp_path / "cap/mano_fits/meshes").mkdir(parents=True)
    (tmp_path / "cap/mano_fits/meshes/1.ply").write_text("ply")
    summary = files.capture_summary(spark, str(tmp_path / "cap")).first()
    assert (summary.capture, summary.mano_mesh_count, summary.has_mugsy_cam_params) == ("cap", 1, False)


def test_data_set_job(spark, tmp_path):
    for name, frames, sums in (("b", "1\n2\n", "mano_fits/mano_fits.tar.gzaa 0\nmano_fits/mano_fits.tar.gzaa 900150983cd24fb0d6963f7d28e17f72\n"), ("a", "1\n2\n3\n", ""), ("c", None, None)):
        (tmp_path / name / "mano_fits/meshes").mkdir(parents=True)
        if frames is not None:
            (tmp_path / name / "frame_list.txt").write_text(frames)
        if sums:
            (tmp_path / name / "CHECKSUM").write_text(sums)
        (tmp_path / name / "mano_fits/mano_fits.tar.gzaa").write_text("abc")
        (tmp_path / name / "mano_fits/meshes/1.ply").write_text("ply")
    out = dataset.prepare(spark, str(tmp_path))
    assert (out["selected_capture"], out["capture_frame_counts"]) == ("b", {"a": 3, "b": 2, "c": None})
    assert out["selected_capture_summary"] == {"capture": "b", "mano_mesh_count": 1, "mano_param_count": 0, "has_mugsy_cam_params": False, "frame_count": 2}
    reports = {r["path"].rsplit("/", 1)[-1]: r for r in out["selected_reports"]}
    assert reports["mano_fits.tar.gzaa"]["verified"] is True and reports["cam_params.json"]["status"] == "missing"
    given = dataset.prepare(spark, str(tmp_path), "a")
    assert [r["verified"] for r in given["selected_reports"] if r["status"] == "present"] == [None]
    assert dataset.main(["--data-root", str(tmp_path), "--summary-json", str(tmp_path / "s.json")]) == 0 and json.loads((tmp_path / "s.json").read_text()) == out
    with pytest.raises(RuntimeError):
        dataset.prepare(spark, str(tmp_path / "nothing"))


def test_stream_of_pixels_gives_the_batch_grid(spark, tmp_path):
    from cloudframe.operators.depth import fuse_views
    from cloudframe.streaming.fusion import fuse_stream

    pixels, cameras = synth.mock_scene(spark, 2, width=32, height=24, focal=30.0)
    kept = pixels.select("view_idx", "u", "v", "depth", "label")
    kept.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = fuse_stream(spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), cameras, 0.02)
    q = stream.writeStream.format("memory").queryName("grid").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.kx, r.ky, r.kz): r.n for r in fuse_views(kept, cameras, 0.02).collect()}
    assert {(r.kx, r.ky, r.kz): r.n for r in spark.table("grid").collect()} == batch
