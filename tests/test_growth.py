"""What holds at sizes that the other tests' tables don't have, and what is worked out once."""

from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators import triples


def test_each_graph_has_one_document(spark):
    """Graphs whose lines fill partitions unevenly: each is one row, with its prefixes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = F.col("id")
        t = spark.range(120_000).select((n % 400).cast("string").alias("graph"), F.format_string("urn:s:%d", "id").alias("s"), F.lit("urn:p").alias("p"), F.repeat(F.lit("x"), 200).alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))
        d = triples.digests(triples.turtle(t.repartition(16)))
        got = d.agg(F.count("*").alias("rows"), F.countDistinct("graph").alias("graphs"), F.min("bytes").alias("least")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got["rows"], got["graphs"]) == (400, 400) and got["least"] > 300 * 200


def test_a_condition_never_parses_again(spark):
    lines = spark.range(5).select(F.format_string("2024-01-01T00:00:00.000Z log:Message urn:x:y seq=%d", "id").alias("line"))
    e = X.once(lines, "e", X.parse_entry(F.col("line"), F.create_map(F.lit("log"), F.lit("urn:l#"))))
    seq = e.select("e.subject", X.stated_sequence(F.col("e.fields")).cast("long").alias("seq")).where("seq between 1 and 3")
    plan = seq._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=\\x20|\\z)") == 1  # the pattern of tokens
    assert sorted(r["seq"] for r in seq.collect()) == [1, 2, 3]


def test_tokens_of_odd_lines(spark):
    """The short way for runs of printable ASCII finds what the long one finds."""
    rows = [('a b', ["a", "b"]), ('ab"cd e', ["ab", "cd", "e"]), ('k="x y" z', ['k="x y"', "z"]), ("aéb c d", ["aéb", "c", "d"]), ("a\tb\n", ["a", "b"]), ("", []), ('x"a\\"b"y', ['x"a\\"b"y'])]
    got = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(rows)], "i int, line string").select("i", X.tokens(F.col("line")).alias("t"), X.is_scannable(F.col("line")).alias("ok")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in rows]
    assert [r["ok"] for r in got] == [True, False, True, True, True, True, True]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """Tasks of the tail and of the probe grow with bytes, not with files; files are found where they were written, and nothing hidden stays."""
    from provlog.operators.writer import write_files
    from provlog.sources import ranges, segments

    n = F.col("id")
    lines = spark.range(3000).select(F.format_string("urn:log:s%d", n % 1000).alias("segment"), n.alias("line_no"), F.when(n < 1000, "").otherwise(F.format_string("line %d", "id")).alias("line"))
    path = str(tmp_path / "files")
    write_files(lines, path)
    assert not [f for f in (tmp_path / "files").rglob(".*")] and segments.read(spark, path).count() == 1000
    reader = ranges.TailReader({"path": path, "ending": ".txt"})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= 4 and sum(len(p.pieces) for p in parts) == 1000
    told = [r["raw"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(told) == sorted(f"line {i}" for i in range(1000, 3000))
    assert len(ranges.ProbeReader({"path": path, "ending": ".txt"}).partitions()) == 16


def test_many_files_go_to_the_store_by_folder(spark, tmp_path, monkeypatch):
    """More files than are named by their paths are read as a folder, with the same result."""
    from test_parts import write

    from provlog import api
    from provlog.sources import cache

    folder = tmp_path / "logs"
    folder.mkdir()
    write(folder, n=9)
    by_path = sorted(map(tuple, api.cached(spark, str(folder), str(tmp_path / "one")).collect()), key=repr)
    monkeypatch.setattr(cache, "PATHS", 1)
    by_folder = sorted(map(tuple, api.cached(spark, str(folder), str(tmp_path / "two")).collect()), key=repr)
    assert by_folder == by_path and by_path


def test_batches_of_several_files_keep_their_turn(spark):
    """Each batch of a fed stream is written by several tasks, and comes whole and in its turn."""
    from provlog.streaming import live

    rows = spark.range(60_000).select("id", F.floor(F.col("id") / 25_000).alias("b"))
    stream = live.fed(rows, "turns", F.col("b"), 3)
    seen = []
    query = stream.writeStream.foreachBatch(lambda d, i: seen.append(d.agg(F.min("id"), F.max("id"), F.count("*")).first())).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [tuple(r) for r in seen] == [(0, 24_999, 25_000), (25_000, 49_999, 25_000), (50_000, 59_999, 10_000)]


def test_edited_texts_need_no_fingerprints(spark):
    """Digests of edited texts are those that come with fingerprints, without the words' work."""
    import pytest

    pytest.importorskip("provlog.llm")
    from provlog.llm import fingerprints

    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "é" * 9), (3, None), (5, "line one\nline two")], "doc_id long, text string")
    plain = fingerprints.edits(docs).select("id", "n_chars", "edited_sha256")
    assert "xxhash64" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, fingerprints.with_edits(docs).select("id", "n_chars", "edited_sha256").collect()))
