"""Registration of several clouds with one target, as a job.

python -m cloudframe.plans.registration --target a.ply --source b.ply [--source c.npz ...] [options], or --selftest
"""

from __future__ import annotations

import argparse
import inspect
import json
import operator
import os
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.functions.transforms import angle_of, euler_matrix, make_transform
from cloudframe.operators.points import concat_clouds, scale_cloud, voxel_downsample, working_points
from cloudframe.operators.registration import Registered, register, report, with_transforms
from cloudframe.operators.synth import registration_hand
from cloudframe.sources.clouds import read_clouds, write_ply
from cloudframe.sources.scenes import write_json

TARGET_SEED, SOURCE_SEED = 11, 100


def load_transforms(path: str | None) -> dict[str, np.ndarray]:
    """A JSON map of names to 4x4 matrices; another shape is an error."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as f:
        out = {k: np.asarray(v, float) for k, v in json.load(f).items()}
    for name, matrix in out.items():
        if matrix.shape != (4, 4):
            raise ValueError(f"the initial transform of {name!r} must be 4x4")
    return out


def find_transform(path: str, cloud_id: str, transforms: dict[str, np.ndarray]) -> np.ndarray | None:
    """The first that is there for the path, the file's name, the name without suffix, the cloud's name."""
    name = os.path.basename(path)
    return next((transforms[k] for k in (path, name, os.path.splitext(name)[0], cloud_id) if k in transforms), None)


def register_clouds(target: DataFrame, sources: DataFrame, voxel_size: float = 0.002, max_points: int = 50_000, max_iterations: int = 60, tolerance: float = 1e-7, threshold: float = 0.035, trim: float = 0.9, min_pairs: int = 80, init: dict | None = None) -> tuple[list[Registered], DataFrame, DataFrame]:
    """(results, aligned, merged) of sources (source_id, ...) and a target.

    The fit is on voxel means, at most max_points a cloud; the full clouds are moved and
    merged on one voxel grid.
    """
    thin = working_points(target, voxel_size, max_points, TARGET_SEED)
    working = working_points(sources, voxel_size, max_points, SOURCE_SEED, ("source_id",))
    results = register(working, thin, init, max_iterations, tolerance, threshold, trim, min_pairs)
    aligned = with_transforms(sources, {r.source_id: r.transform for r in results})
    merged = voxel_downsample(concat_clouds([target, aligned]), voxel_size)
    return results, aligned, merged


def run(spark: SparkSession, target_path: str, source_paths: list[str], output_dir: str, scale: float = 1.0, points_key: str | None = None, transforms: dict | None = None, **options) -> dict:
    """Read, register, write the target, each source aligned, all merged, and summary.json.

    Aligned files carry their source's number, so sources of one name don't meet.
    """
    def load(path: str, name: str) -> DataFrame:
        cloud = scale_cloud(read_clouds(spark, path, points_key), scale).withColumn("cloud_id", F.lit(name))
        colored = cloud.limit(1).where("r is not null").count() > 0
        return cloud if colored else cloud.drop("r", "g", "b")

    def stem(path: str) -> str:
        return os.path.splitext(os.path.basename(path))[0]

    target, sources, init = load(target_path, "target"), None, {}
    for k, path in enumerate(source_paths, 1):
        one = load(path, path).withColumn("source_id", F.lit(k))
        sources = one if sources is None else sources.unionByName(one, allowMissingColumns=True)
        found = find_transform(path, stem(path), transforms or {})
        if found is not None:
            init[k] = found
    settings = {k: v.default for k, v in inspect.signature(register_clouds).parameters.items() if k not in ("target", "sources", "init")} | options
    results, aligned, merged = register_clouds(target, sources, init=init, **settings)
    os.makedirs(output_dir, exist_ok=True)
    aligned = aligned.persist()
    paths = {name: os.path.join(output_dir, file) for name, file in (("target", f"target_{stem(target_path)}.ply"), ("merged", "merged.ply"), ("summary", "summary.json"))}
    write_ply(target, paths["target"])
    reports = []
    for row in json.loads("[" + ",".join(report(spark, results).toJSON().collect()) + "]"):
        k = int(row["source"])
        path = os.path.join(output_dir, f"aligned_{k:02d}_{stem(source_paths[k - 1])}.ply")
        write_ply(aligned.where(F.col("source_id") == k), path)
        reports.append(row | {"source": source_paths[k - 1], "output_ply": path, "used_initial_transform": k in init})
    count = write_ply(merged, paths["merged"], ("kx", "ky", "kz"))
    aligned.unpersist()
    parameters = {"input_scale": scale, **settings}
    summary = {"status": "ok", "method": "point_to_point_icp", "target": target_path, "target_ply": paths["target"], "parameters": parameters, "sources": reports, "merged_ply": paths["merged"], "merged_point_count": count}
    write_json(summary, paths["summary"])
    return summary


# The self-test's motions, noise and settings, and what it demands.
MOTION_RAD, MOTION_M, NOISE_M, KEPT = 0.16, 0.018, 0.0004, 0.88
SETTINGS = {"max_iterations": 80, "tolerance": 1e-8, "threshold": 0.04, "trim": 0.92, "min_pairs": 200}
GATES = {"mean_error_m": 0.0045, "rotation_error_rad": 0.035, "translation_error_m": 0.004}


def selftest(spark: SparkSession, cases: int = 3, seed: int = 20260702) -> DataFrame:
    """One row for each known motion of the synthetic hand that registration has to undo, and whether it did."""
    rng = np.random.default_rng(seed)
    motions = {k: make_transform(euler_matrix(*rng.uniform(-MOTION_RAD, MOTION_RAD, 3)), rng.uniform(-MOTION_M, MOTION_M, 3)) for k in range(cases)}
    base = registration_hand(spark).persist()
    copies = base.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in motions], "source_id int"))).where(F.rand(seed) < KEPT)
    moved = with_transforms(copies, motions).withColumns({c: F.col(c) + F.randn(seed + j) * NOISE_M for j, c in enumerate("xyz", 1)})
    rows = []
    for r in register(moved, base, **SETTINGS):
        rest = r.transform @ motions[r.source_id]
        rows.append((r.source_id, r.status, r.iterations, r.mean_error, r.rmse, float(angle_of(rest[:3, :3])), float(np.linalg.norm(rest[:3, 3]))))
    base.unpersist()
    found = spark.createDataFrame(rows, "case int, status string, iterations int, mean_error_m double, rmse_m double, rotation_error_rad double, translation_error_m double")
    return found.withColumn("ok", reduce(operator.and_, (F.col(c) < most for c, most in GATES.items())))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--selftest", action="store_true")
    parser.add_argument("--target")
    parser.add_argument("--source", action="append", default=[])
    parser.add_argument("--inputs", nargs="+", default=[], help="the target, then the sources")
    parser.add_argument("--output-dir", default="outputs/registration")
    parser.add_argument("--npz-points-key")
    parser.add_argument("--init-transforms-json")
    numbers = {"voxel-size-m": 0.002, "input-scale": 1.0, "max-points": 50_000, "max-iterations": 60, "tolerance": 1e-7, "distance-threshold-m": 0.035, "trim-fraction": 0.9, "min-pairs": 80}
    for name, default in numbers.items():
        parser.add_argument(f"--{name}", type=type(default), default=default)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("registration").getOrCreate()
    if given.selftest:
        cases = [r.asDict() for r in selftest(spark).collect()]
        passed = all(c["ok"] for c in cases)
        print(json.dumps({"status": "ok" if passed else "failed", "cases": cases}, indent=2))
        return int(not passed)
    target, sources = (given.inputs[0], given.inputs[1:]) if given.inputs else (given.target, given.source)
    if not target or not sources:
        parser.error("a target and at least one source are needed")
    summary = run(
        spark, target, sources, given.output_dir, given.input_scale, given.npz_points_key, load_transforms(given.init_transforms_json), voxel_size=given.voxel_size_m, max_points=given.max_points,
        max_iterations=given.max_iterations, tolerance=given.tolerance, threshold=given.distance_threshold_m, trim=given.trim_fraction, min_pairs=given.min_pairs,
    )
    print(json.dumps(summary, indent=2))
    return int(any(s["status"] not in ("converged", "max_iterations") for s in summary["sources"]))


if __name__ == "__main__":
    raise SystemExit(main())
