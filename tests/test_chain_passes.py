"""Chains and seals are folded in one pass over a segment, whose rows are never gathered in one."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from provlog.operators import chain
from provlog.operators.writer import tagged


def test_a_long_segment_is_folded_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(chain, "ROWS", 7)
    n = 5000
    lines = spark.range(1, n + 1).select(F.when(F.col("id") <= 4900, "long").otherwise("short").alias("segment"), F.col("id").alias("line_no"), F.format_string("line %d", "id").alias("line"), F.col("id").alias("ms"))
    headers = spark.createDataFrame([("long", "h"), ("short", "g"), ("none", "x")], "segment string, h0 string")
    points = chain.seal_points(lines, 3, 10**9)
    sealed, heads = chain.sealed(lines.repartition(3), headers, points), chain.heads(lines.repartition(3), headers)
    for df in (points, sealed, heads):
        said = io.StringIO()
        with redirect_stdout(said):
            df.explain()
        assert "collect_list" not in said.getvalue()
    after = {"long": ["h"], "short": ["g"]}
    for i in range(1, n + 1):
        of = after["long" if i <= 4900 else "short"]
        of.append(tagged(f"{of[-1]}\nline {i}"))
    want = {(s, a + 1, a + 3) for s, h in after.items() for a in range(0, len(h) - 3, 3)}
    assert {tuple(r) for r in points.collect()} == want
    assert {tuple(r) for r in sealed.collect()} == {(s, a, b, after[s][b]) for s, a, b in want}
    assert {tuple(r) for r in heads.collect()} == {(s, h[-1], len(h) - 1) for s, h in after.items()}
