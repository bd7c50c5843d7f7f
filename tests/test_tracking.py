"""Tracks and smoothing against a loop over frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import tracking

SCHEMA = "row_id bigint, clip string, frame_index bigint, hand_side bigint, root_translation_m array<double>, frame_status string, joints_3d_left_m array<array<double>>"


def slow_tracks(rows, gate):
    """{row_id: (track_id, track_at)}"""
    out = {r[0]: (r[0], 0) for r in rows}
    good = [r for r in rows if r[5] == "ok" and r[4] is not None and all(x is not None and np.isfinite(x) for x in r[4])]
    for clip in {r[1] for r in rows}:
        for side in {r[3] for r in rows}:
            own = [r for r in good if r[1] == clip and r[3] == side]
            for frame in sorted({r[2] for r in own}):
                here, there = [r for r in own if r[2] == frame], [r for r in own if r[2] == frame + 1]
                d = {(a[0], b[0]): float(np.sqrt(sum((p - q) ** 2 for p, q in zip(a[4], b[4], strict=True)))) for a in here for b in there}
                d = {k: v for k, v in d.items() if v <= gate}
                for (a, b), v in d.items():
                    if min((w, k[1]) for k, w in d.items() if k[0] == a) == (v, b) and min((w, k[0]) for k, w in d.items() if k[1] == b) == (v, a):
                        out[b] = (out[a][0], out[a][1] + 1)
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for clip in ("a", "b"):
        places = rng.normal(size=(4, 3))
        for frame in range(60):
            for hand in range(4):
                places[hand] += rng.normal(0, 0.02, 3)
                if rng.random() < 0.9:
                    status = "ok" if rng.random() < 0.95 else "invalid"
                    root = places[hand].tolist() if rng.random() < 0.97 else [None, float("nan"), float("inf")]
                    joints = rng.normal(size=(5, 3)).tolist() if rng.random() < 0.9 else None
                    rows.append((k, clip, frame, [0, 1, 1, None][hand], root, status, joints))
                    k += 1
    rows.append((k, "a", 3, 1, rows[10][4], "ok", rows[10][6]))  # two alike
    return rows


def test_tracks(spark, made):
    got = {r.row_id: (r.track_id, r.track_at) for r in tracking.with_tracks(spark.createDataFrame(made, SCHEMA).repartition(3), 0.1).collect()}
    want = slow_tracks(made, 0.1)
    assert got == want and max(at for _, at in want.values()) > 10
    assert tracking.with_tracks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_smoothing_in_stretches(spark, made, monkeypatch):
    tracks = slow_tracks(made, 0.1)
    want, last = {}, {}
    for row in sorted(made, key=lambda r: tracks[r[0]][1]):
        track = tracks[row[0]][0]
        if row[5] == "ok" and row[6] is not None:
            value = np.array(row[6])
            last[track] = value if track not in last else 0.3 * value + 0.7 * last[track]
        want[row[0]] = last.get(track)
    tracked = tracking.with_tracks(spark.createDataFrame(made, SCHEMA), 0.1).withColumn("wrist_pose_6d_left_m_rad", F.col("joints_3d_left_m")[1]).persist()
    for stretch in (10_000, 4):
        monkeypatch.setattr(tracking, "STRETCH", stretch)
        for r in tracking.smooth(tracked, 0.3).collect():
            if want[r.row_id] is None:
                assert r.joints_3d_left_m_smooth is None
            else:
                assert np.allclose(r.joints_3d_left_m_smooth, want[r.row_id], atol=1e-12) and np.allclose(r.wrist_pose_6d_left_m_rad_smooth, want[r.row_id][1], atol=1e-12)


def test_a_stream_equals_the_batch(spark, made, tmp_path):
    rows = [(r[0], t, at, r[4]) for r in made for t, at in [slow_tracks(made, 0.1)[r[0]]]]
    schema = "row_id bigint, track_id bigint, track_at bigint, root_translation_m array<double>"
    whole = spark.createDataFrame(rows, schema).withColumn("root_translation_m", F.when(~F.exists("root_translation_m", lambda x: x.isNull() | F.isnan(x)), F.col("root_translation_m")))
    batch = {r.row_id: r.root_translation_m_smooth for r in tracking.smooth(whole, 0.3, ("root_translation_m",)).collect()}
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for low, high in ((0, 5), (5, 6), (6, 100)):
        whole.where(f"track_at >= {low} AND track_at < {high}").coalesce(1).write.mode("append").parquet(folder)
        q = tracking.smooth_stream(stream, 0.3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.row_id: r.smooth for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == batch.keys()
    for k, v in batch.items():
        if v is not None:
            assert np.allclose(got[k], v, atol=1e-12)
