"""Streams whose keys share buckets: what is kept of many keys, near or far, and how often a triple's parts are worked out."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators import triples
from provlog.streaming import live
from provlog.vocabulary import LOG, Vocabulary

T = "2024-01-01T00:00:{:02d}.000Z"


def lines(spark, segments: int = 30):
    """Segments of eight lines with calls and agents, in four batches, some lines ahead of their turn."""
    rows = []
    for s in range(segments):
        body = [f"{T.format(n)} log:Message urn:x:y span={n} parent={n // 2} principal=urn:agent:a{n % 2}" for n in range(1, 8)]
        body.append(f"{T.format(8)} log:ProcessStop urn:x:y")
        rows += [(f"urn:log:{s}", f"urn:inst:{s}", n, raw, max(0, (n - 1) // 2 - (n % 3 == 0))) for n, raw in enumerate(body, 1)]
    d = spark.createDataFrame(rows, "segment string, instance string, line_no long, raw string, n long")
    return d.withColumns({"kind": X.line_kind(F.col("raw")), "prefixes": F.create_map(F.lit("log"), F.lit(LOG))})


def told(spark, d, v):
    stream = live.fed(d, "buckets", F.col("n"), 4).drop("n")
    return sorted(map(tuple, live.drained(live.triples_stream(stream, v), "buckets").collect()), key=repr)


def batch(d, v):
    e = d.withColumn("e", X.parse_entry(F.col("raw"), F.col("prefixes"))).select("segment", "instance", "line_no", "e.*")
    core = triples.core(e, v.class_table(d.sparkSession))
    all_ = [core, triples.declared(e, v), triples.undeclared(e, v), triples.delegation(e), triples.invoked(e)]
    return sorted((tuple(r) for t in all_ for r in t.collect()), key=repr)


def test_segments_share_a_bucket_near_and_far(spark, monkeypatch):
    """One bucket for all segments, room for few of them at once, and parts of a few spans: the rows stay those of the batch operators."""
    v = Vocabulary.built_in()
    d = lines(spark).cache()
    want = batch(d, v)
    assert len(want) > 30 * 8 * 6
    assert told(spark, d, v) == want
    for near, part in ((500, 2), (0, 0)):
        monkeypatch.setattr(live, "BUCKETS", 1)
        monkeypatch.setattr(live, "NEAR", near)
        monkeypatch.setattr(live, "PART", part)
        assert told(spark, d, v) == want


def test_segments_are_dealt_to_buckets(spark, monkeypatch):
    """Groups of the stateful step grow with the buckets and not with the segments."""
    v = Vocabulary.built_in()
    monkeypatch.setattr(live, "BUCKETS", 3)
    d = lines(spark)
    stream = live.fed(d.drop("n"), "groups")
    query = live.started(live.followed(stream, v), f"{live.shared_dir(spark)}/groups")
    query.awaitTermination()
    assert max(r[3] for r in live.accounts(query)) <= 3


def test_an_identifier_is_worked_out_once(spark):
    """Every triple names its entry; the sequence is looked up once all the same."""
    v = Vocabulary.built_in()
    e = spark.createDataFrame([("g", "i", 1, LOG + "Message", "urn:x:y", T.format(1), [("seq", "5")])], "segment string, instance string, line_no long, class string, subject string, time string, fields array<struct<key: string, value: string>>")
    t = triples.exploded(triples.node(e), triples.core_array(F.lit(None).cast("string")))
    assert t._jdf.queryExecution().optimizedPlan().toString().count("18446744073709551615") <= 1
    assert {r["s"] for r in t.collect()} == {"g:5"}


def test_iris_are_told_the_short_way_and_the_long_one(spark):
    rows = {"urn:a:b": True, "http://x/y?z=1#[a]~!$&'()*+,;=@_-.": True, "urn:a%20b": True, "urn:a%2": False, "urn:é": True, "urn:a b": False, "urn:a ": False, "a": False, ":a": False, "urn:": True, "urn:<a": False, "urn:a`": False, "urn:{a}": False, "urn:a\n": False, "1urn:a": False, "urn:a\\": False}
    got = spark.createDataFrame([(k,) for k in rows], "c string").select("c", X.is_rdf_iri(F.col("c")).alias("ok")).collect()
    assert {r["c"]: r["ok"] for r in got} == rows


def test_writers_share_a_bucket_near_and_far(spark, monkeypatch):
    """Late entries of many instances in one bucket: the lines are those of the batch writer, each instance's last segment aside, and groups grow with the buckets."""
    from provlog.operators.writer import Cadence, write_lines

    n = F.col("id")
    rows = spark.range(600).select(
        F.format_string("urn:inst:%d", n % 40).alias("instance"), (n * 1000 + 1_000_000).alias("ms"), X.time_string(n * 1000 + 1_000_000).alias("time"), F.lit(LOG + "Message").alias("class"), F.lit("log:Message").alias("curie"),
        F.format_string("urn:x:%d", "id").alias("subject"), F.lit("").alias("tail"), n.alias("event_id"), F.greatest(F.floor(n / 200) - F.when(n % 7 == 0, 1).otherwise(0), F.lit(0)).alias("n"),
    )
    last = spark.range(1).select(F.lit("urn:inst:end").alias("instance"), F.lit(10_000_000).cast("long").alias("ms"), F.lit(T.format(0)).alias("time"), F.lit(LOG + "Message").alias("class"), F.lit("log:Message").alias("curie"), F.lit("urn:x:end").alias("subject"), F.lit("").alias("tail"), F.lit(-1).cast("long").alias("event_id"), F.lit(3).cast("long").alias("n"))
    cadence, order = Cadence(4, None, 6, None), ["ms", "event_id"]
    closed = write_lines(rows.drop("class", "n"), cadence, order)
    want = sorted(map(tuple, closed.where("line not like '% log:ProcessStop %'").collect()))

    def run() -> list[tuple]:
        stream = live.fed(rows.unionByName(last), "late", F.col("n"), 4).drop("n")
        got = live.drained(live.write_stream(stream, cadence, order, "trace", Vocabulary.built_in(), "300 seconds"), "late")
        return sorted(map(tuple, got.where("instance <> 'urn:inst:end'").collect()))

    stop = {(i, s, no) for i, s, no, line in map(tuple, closed.where("line like '% log:ProcessStop %'").collect())}
    want = [w for w in want if not any(w[:2] == x[:2] and w[2] > x[2] for x in stop)]  # closing seals too
    assert len(want) > 600
    assert run() == want
    monkeypatch.setattr(live, "BUCKETS", 1)
    for near in (1000, 0):
        monkeypatch.setattr(live, "NEAR", near)
        assert run() == want
    monkeypatch.setattr(live, "BUCKETS", 3)
    monkeypatch.setattr(live, "NEAR", 8 << 20)
    stream = live.write_stream(live.fed(rows.drop("n"), "dealt"), cadence, order, "trace", Vocabulary.built_in())
    query = live.started(stream, f"{live.shared_dir(spark)}/dealt")
    query.awaitTermination()
    assert max(r[3] for r in live.accounts(query)) <= 3
