"""Accuracy of a hand file, alone or against a reference, as a job.

python -m cloudframe.plans.accuracy --prediction a.npz [--reference b.npz] [--output report.json]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from cloudframe.operators.accuracy import verdict
from cloudframe.sources.hands import read_hands
from cloudframe.sources.scenes import write_json


def evaluate(spark: SparkSession, prediction: str, reference: str | None = None) -> dict:
    hands, meta = read_hands(spark, prediction)
    other = read_hands(spark, reference)[0].drop("path") if reference else None
    return json.loads(verdict(hands.drop("path"), meta.drop("path"), other).toJSON().first())


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--prediction", required=True)
    parser.add_argument("--reference")
    parser.add_argument("--output")
    given = parser.parse_args(args)
    found = evaluate(SparkSession.builder.appName("accuracy").getOrCreate(), given.prediction, given.reference)
    if given.output:
        write_json(found, given.output)
    print(json.dumps(found, indent=2))
    return int(not found["passed"])


if __name__ == "__main__":
    raise SystemExit(main())
