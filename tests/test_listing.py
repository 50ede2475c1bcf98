"""Files of a folder are listed and read by tasks: what Spark's own listing finds, without a list of files on the driver."""

from __future__ import annotations

import os

from conftest import rows_of
from pyspark.sql import functions as F
from test_parts import write

from provlog import api
from provlog.sources import cache, segments


def folder(tmp_path):
    top = tmp_path / "lo gs%20é"
    (top / "a" / "b").mkdir(parents=True)
    for hidden in ("_temporary", ".x", "_k=v"):
        (top / hidden).mkdir()
    write(top, n=9)
    text = next(top.glob("*.log")).read_bytes()
    for name in ("a/b/part-0 é.txt", "a/part-1.log", "a/_no.log", "a/.no.log", "a/part-2.csv", "a/x.txt", "_temporary/no.log", ".x/no.log", "_k=v/yes.log", "a/b/.part-3.txt.crc"):
        (top / name).write_bytes(text)
    (top / "a" / "wrong.log").write_bytes(b"\xff\xfe")
    (top / "a" / "empty.log").write_bytes(b"")
    return top


def test_tasks_list_and_read_what_spark_does(spark, tmp_path, monkeypatch):
    top = folder(tmp_path)
    want = segments.read(spark, str(top))
    kept = []
    cut = segments.cut
    monkeypatch.setattr(segments, "cut", lambda df, name: kept.append(df) or cut(df, name))
    found = segments.manifest(spark, str(top))
    assert not any("binaryFile" in k._jdf.queryExecution().toString() for k in kept)
    assert rows_of(found) == rows_of(want.select("file", "bytes", "modified")) and found.count() > 5
    read = cache.read_files(spark, str(top), found)
    assert "binaryFile" not in read._jdf.queryExecution().toString()
    assert rows_of(read) == rows_of(want) and read.where("error is not null").count() == 1
    assert cache.read_files(spark, str(top), found.where("false")) is None


def test_what_arrow_does_not_reach_is_listed_by_spark(spark, tmp_path, monkeypatch):
    top = folder(tmp_path)
    found, want = segments.manifest(spark, str(top)), segments.read(spark, str(top))
    monkeypatch.setattr(segments, "rooted", lambda spark, directory: None)
    assert rows_of(segments.manifest(spark, str(top))) == rows_of(found)
    assert rows_of(cache.read_files(spark, str(top), found)) == rows_of(want)


def test_copies_with_one_content_count_once(spark, tmp_path):
    """Files with the same content, kept by the same call: the segment is told once."""
    top, store = tmp_path / "logs", str(tmp_path / "store")
    top.mkdir()
    write(top)
    want = rows_of(api.transrept(spark, str(top)))
    for f in list(top.glob("*.log")):
        os.link(f, top / f"z-{f.name}")
    for _ in range(2):
        assert rows_of(api.cached(spark, str(top), store)) == want
    assert spark.read.parquet(f"{store}/index").where(F.col("finished")).count() % 2 == 0
