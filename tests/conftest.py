"""One session for all tests, and a comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(df: DataFrame) -> list[tuple]:
    """Rows with columns in the order of their names, sorted."""
    names = sorted(df.columns)
    return sorted((tuple(rounded(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def rounded(x):
    return round(x, 6) if isinstance(x, float) else x


def same_rows(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """Names and rows of a Spark query and of its SQL agree."""
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(n) for n in sorted(want.columns)]
    expected = sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=repr)
    got = rows_of(df)
    assert len(got) == len(expected)
    assert got == expected
