"""A data set that is on disk: choose a capture, verify its files, summarise it, as a job.

python -m cloudframe.plans.dataset --data-root DIR [--capture NAME] [--file RELATIVE_PATH ...] [--summary-json FILE]

Downloading and unpacking are left out.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloudframe.operators.files import capture_counts, capture_summary, parse_checksums, path_exists, smallest_capture, verify_files
from cloudframe.sources.scenes import write_json

SMALLEST = "auto-smallest"
#: The files of a capture that are verified.
FILES = ("mano_fits/mano_fits.tar.gzaa", "Mugsy_cameras/cam_params.json")


def prepare(spark: SparkSession, data_root: str, capture: str = SMALLEST, files: tuple[str, ...] = FILES) -> dict:
    """The report of one capture: its frames, the counts of its files, and whether those named agree with CHECKSUM.

    A file without a checksum is neither right nor wrong (verified is null); a file that isn't
    there has the status missing. Without a frame list there is nothing to choose from: an error.
    """
    data_root = data_root.rstrip("/")
    counts = {r["capture"]: r["frame_count"] for r in capture_counts(spark, data_root).collect()}
    if capture == SMALLEST:
        found = smallest_capture(capture_counts(spark, data_root)).first()
        if found is None:
            raise RuntimeError(f"no frame_list.txt in the captures of {data_root}")
        capture = found["capture"]
    folder = f"{data_root}/{capture}"
    there = [f for f in files if path_exists(spark, f"{folder}/{f}")]
    reports = [{"path": f"{folder}/{f}", "status": "missing"} for f in files if f not in there]
    if there:
        content = spark.read.format("binaryFile").load([f"{folder}/{f}" for f in there]).select(F.substring_index("path", f"/{capture}/", -1).alias("path"), "content")
        has_sums = path_exists(spark, f"{folder}/CHECKSUM")
        lines = spark.read.text(f"{folder}/CHECKSUM", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")) if has_sums else spark.createDataFrame([], "line int, value string")
        checked = verify_files(content, parse_checksums(lines, order="line")).orderBy("path")
        reports += [{"status": "present", **r.asDict(), "path": f"{folder}/{r['path']}"} for r in checked.collect()]
    summary = capture_summary(spark, folder).first().asDict() if path_exists(spark, folder) else {"capture": capture, "mano_mesh_count": 0, "mano_param_count": 0, "has_mugsy_cam_params": False}
    return {"status": "ok", "data_root": data_root, "selected_capture": capture, "selected_capture_summary": summary | {"frame_count": counts.get(capture)}, "capture_frame_counts": counts, "selected_reports": reports}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--data-root", required=True)
    parser.add_argument("--capture", default=SMALLEST)
    parser.add_argument("--file", action="append", default=[])
    parser.add_argument("--summary-json")
    given = parser.parse_args(args)
    found = prepare(SparkSession.builder.appName("dataset").getOrCreate(), given.data_root, given.capture, tuple(given.file) or FILES)
    if given.summary_json:
        write_json(found, given.summary_json)
    print(json.dumps(found, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
