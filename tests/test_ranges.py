"""Sources that read parts of files, and streams that follow files as they grow."""

from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_parts import write

from provlog import api
from provlog.operators import triples, verify
from provlog.sources import cache, ranges, segments
from provlog.streaming import live
from provlog.vocabulary import Vocabulary


def test_appended_lines_come_once_and_whole(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    whole = "\n".join(write(tmp_path)[min(write(tmp_path))]) + "\n"
    head, body = whole.split("\n\n", 1)
    lines = body.split("\n")
    lines[1] = lines[1].replace("msg=m0", "msg=né漢")
    data = "\n".join(lines).encode()
    cut = data.index("漢".encode()) + 1  # within a character
    file = folder / "a.log"

    def run() -> list[str]:
        live.started(ranges.tail(spark, str(folder)).select("line_no", "raw", "kind"), out).awaitTermination()
        return [r["raw"] for r in spark.read.parquet(f"{out}/out").orderBy("line_no").collect()]

    file.write_text(head)  # the header isn't whole
    live.started(ranges.tail(spark, str(folder)).select("line_no", "raw", "kind"), out).awaitTermination()
    for data_now, n in ((b"\n\n" + data[:cut], 1), (data[cut:-5], len(lines) - 2), (data[-5:], len(lines) - 1)):
        with file.open("ab") as f:
            f.write(data_now)
        assert run() == lines[:n]
    assert run() == lines[:-1]
    (folder / "b.log").write_text(whole.replace(":a:", ":b:"))
    assert len(run()) == 2 * len(lines) - 2


def test_pieces_of_a_file_part_no_line(spark, tmp_path, monkeypatch):
    write(tmp_path, n=60)
    whole = {f.name: f.read_text().split("\n\n", 1)[1].split("\n")[:-1] for f in tmp_path.glob("*.log")}
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(ranges, "PIECE", size)
        monkeypatch.setattr(ranges, "STEP", 3 if size < 100 else 64)
        reader = ranges.TailReader({"path": str(tmp_path)})
        got: dict[str, list] = {}
        for p in reader.partitions({}, reader.latestOffset()):
            for batch in reader.read(p):
                for r in batch.to_pylist():
                    got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["following"], r["raw"]))
        assert {k: [x[2] for x in sorted(v)] for k, v in got.items()} == whole
        assert all(a[1] == b[0] for v in got.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_growing_files_as_triples(spark, tmp_path):
    write(tmp_path, n=9)
    v = Vocabulary.built_in()
    out = str(tmp_path / "out")
    for most in (700, 700, None):  # each run goes on where the one before stopped, within a segment too
        live.started(live.triples_stream(ranges.tail(spark, str(tmp_path), batch=most), v), out).awaitTermination()
    got = spark.read.parquet(f"{out}/out")
    want = api.transrept(spark, str(tmp_path))
    heads = triples.of_header(segments.listing(segments.read(spark, str(tmp_path))).withColumn("level", F.regexp_replace("level", "^.*#", "")))
    assert rows_of(got.unionByName(heads)) == rows_of(want) != []
    assert rows_of(got.select("graph").distinct()) == rows_of(want.select("graph").distinct())


def test_probes_read_ranges(spark, tmp_path):
    write(tmp_path, n=9)
    first = sorted(tmp_path.glob("*.log"))[0]
    text = first.read_text()
    cut = text.rindex("#seal")
    first.write_text(text[:cut] + "# a long note\n" * 60_000 + text[cut:])  # beyond a range, before the last seal
    last = sorted(tmp_path.glob("*.log"))[-1]
    last.write_text(last.read_text() + "# notes\n" * 60_000)  # after the last seal
    p = ranges.probe(spark, str(tmp_path))
    sizes = {f.name: f.stat().st_size for f in tmp_path.glob("*.log")}
    name = F.regexp_extract("file", "[^/]+$", 0)
    read = {(r["n"], r["part"]): r["read"] for r in p.select(name.alias("n"), "part", "read").collect()}
    assert read[first.name, "header"] == ranges.HEAD and read[first.name, "tail"] == ranges.TAIL
    assert read[last.name, "tail"] == ranges.TAIL + sizes[last.name]  # the range holds no seal
    only = p.where("part = 'header'")
    assert {r["part"] for r in only.collect()} == {"header"}
    assert sum(r["read"] for r in only.collect()) <= ranges.HEAD * len(sizes)
    files = segments.read(spark, str(tmp_path))
    report = verify.reports(verify.scanned(segments.lines(files)), segments.opened(files)[0], Vocabulary.built_in())
    assert rows_of(ranges.heads(spark, str(tmp_path)).select("segment", "instance", "prev", "head")) == rows_of(report.select("segment", "instance", "prev", "head"))
    with pytest.raises(ValueError, match="shorter"):
        reader = ranges.TailReader({"path": str(tmp_path)})
        reader.latestOffset()
        first.write_text(text[:100])
        reader.latestOffset()


def test_finished_segments_are_read_once(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    write(folder)
    v = Vocabulary.built_in()
    want = rows_of(api.transrept(spark, str(folder)))
    assert rows_of(api.cached(spark, str(folder), store)) == want
    again = api.cached(spark, str(folder), store)
    assert rows_of(again) == want
    assert not any(name.endswith(".log") for name in again.inputFiles()) and "binaryFile" not in again._jdf.queryExecution().toString()
    since = "2024-01-01T00:00:05.000Z"
    late = api.cached(spark, str(folder), store, since=since)
    assert rows_of(late) == rows_of(api.transrept(spark, str(folder), since=since)) != want
    assert "GreaterThanOrEqual(time," in late._jdf.queryExecution().toString()  # reaches the Parquet scan
    last = sorted(folder.glob("*.log"))[-1]
    whole = last.read_text()
    last.write_text(whole[: whole.rindex("#seal")])  # open again: other bytes, and no seal at the end
    (folder / "bad.log").write_text("no header\n")
    mixed = api.cached(spark, str(folder), store)
    assert rows_of(mixed) == rows_of(api.transrept(spark, str(folder))) != want
    assert {r["finished"] for r in cache.index(spark, store).where(F.col("file").endswith(last.name)).collect()} == {True, False}
    assert cache.remember(spark, str(folder), store, v).count() == 3  # the file without a header is known, as one that is open
