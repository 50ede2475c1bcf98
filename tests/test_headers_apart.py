"""Headers of segments given as rows are worked out apart from their lines, which are written by nobody before they are scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlog.operators import verify
from provlog.operators.writer import header
from provlog.sources import segments
from provlog.vocabulary import LOG, Vocabulary

T = "2024-01-01T00:00:00.000Z"


def rows(spark):
    """A whole segment, one that ends in its header, one with a line that doesn't belong, one that begins with a blank line."""
    of = {n: header(f"urn:log:{n}", "urn:inst:a", "trace", T, "genesis").split("\n")[:-1] for n in ("a", "b", "c")}
    of["a"] += [f"{T} log:Message urn:x:y seq={i} k=v" for i in range(1, 30)] + ["", f"{T} log:Rotation urn:log:a seq=30 next=urn:log:b\r"]
    of["b"] = of["b"][:-1]
    of["c"].insert(3, "what is this")
    of["d"] = ["", "# nothing"]
    return spark.createDataFrame([(n, i + 1, line) for n, ls in of.items() for i, line in enumerate(ls)], "segment string, line_no long, line string")


def test_only_headers_are_written(spark, monkeypatch):
    kept = []
    cut = segments.cut
    monkeypatch.setattr(segments, "cut", lambda df, name: kept.append(cut(df, name)) or kept[-1])
    headers, lines = segments.of_lines(rows(spark).repartition(3))
    assert sum(k.count() for k in kept) == 4
    assert {r["segment"]: r["error"] for r in headers.collect()} == {"a": None, "b": None, "c": "not a header line", "d": "version"}
    told = lines.orderBy("line_no").collect()
    assert {r["segment"] for r in told} == {"a"} and [r["kind"] for r in told] == ["entry"] * 29 + ["blank", "entry"]
    assert told[-1]["raw"].endswith("next=urn:log:b") and told[0]["line_no"] == len(header("", "", "", "", "").split("\n"))


def test_fields_that_no_rule_reads_go(spark):
    v = Vocabulary.built_in()
    headers, lines = segments.of_lines(rows(spark))
    slim, full = (verify.scanned(lines, c) for c in (verify.noted(v), None))
    assert {r["class"] for r in slim.where("fields is not null").collect()} == {LOG + "Rotation"}
    assert full.where("fields is not null").count() == 30
    report = lambda s: sorted(map(tuple, verify.reports(s, headers, v).drop("level_changes").collect()), key=repr)
    assert report(slim) == report(full) and any("urn:log:b" in map(str, r) for r in report(slim))
