"""Every registered query with SQL gives DuckDB's rows."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        return None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", ENGINE)
def test_same_rows(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_quality_report_of_few_voxels(spark, tmp_path):
    """Order lines that are all cheap give fewer than 100 voxels: the report warns, and what its SQL computes is the same."""
    place = f"{tmp_path}/lineitem.parquet"
    line = "(id % 7 + 1)::INT AS l_linenumber, id // 7 % 128 AS l_partkey, id // 896 AS l_orderkey, 900.0 + id % 13 AS l_extendedprice, CASE id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS l_returnflag"
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT {line} FROM range({7 * 128 * 96}) AS t(id)) TO '{place}'")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{place}'")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    ours = entry.queries()["quality_report"](spark, str(tmp_path)).toPandas()
    theirs = duck.execute(entry.oracle_sql()["quality_report"]).df()
    constant = ["status", "passed", "n_warnings"]
    assert 0 < theirs.fused_point_count[0] < 100 and ours[constant].values.tolist() == [["failed", False, 1]]
    assert rows(ours.drop(columns=constant)) == rows(theirs.drop(columns=constant))
