"""Files, configuration, streams, the API and odd cases of the grammar."""

from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from provlog import api, config
from provlog.functions import text as X
from provlog.operators import verify
from provlog.operators.writer import Cadence, Segments
from provlog.sources import segments
from provlog.streaming import live
from provlog.vocabulary import LOG, Vocabulary


def write(folder, n=7, cadence=None, level="trace", cut=None):
    """Files of one instance's segments; returns their lines by segment."""
    w = Segments("urn:inst:a", level, cadence or Cadence(2, None, 5, None))
    rows = []
    for i in range(n):
        rows += w.add(f"2024-01-01T00:00:{i:02d}.000Z", 1000 * i, "log:Message", "urn:x:y", f" msg=m{i} k=1 principal=urn:agent:a")
    rows += w.close("2024-01-01T00:01:00.000Z", 60_000)
    out: dict[str, list[str]] = {}
    for name, _, line in rows:
        out.setdefault(name, []).append(line)
    for i, (name, lines) in enumerate(out.items()):
        (folder / f"{i}.log").write_text("\n".join(lines) + "\n")
    return out


def test_written_files_are_listed_and_verify(spark, tmp_path):
    out = write(tmp_path)
    assert len(out) == 2
    assert [r["segment"] for r in api.list_segments(spark, str(tmp_path)).collect()] == sorted(out)
    report, found = api.verify(spark, str(tmp_path))
    assert found.collect() == []
    assert all(r["finished"] for r in report.collect()) and report.where("successor is not null").count() == 1
    said = [r["line"] for r in verify.text_report(report, found).collect()]
    assert [x.split(" ")[2] for x in said[:-1]] == ["OK", "OK"] and said[-1] == "verified 2 segment(s), 0 broken"


def test_an_edited_entry_breaks_every_later_seal_and_the_link_stays(spark, tmp_path):
    write(tmp_path)
    text = (tmp_path / "0.log").read_text()
    (tmp_path / "0.log").write_text(text.replace("msg=m0", "msg=m9"))
    found = api.verify(spark, str(tmp_path))[1].collect()
    assert {r["kind"] for r in found} == {"SealMismatch"} and len(found) == text.count("#seal")


def test_unreadable_files_are_told(spark, tmp_path):
    write(tmp_path)
    (tmp_path / "x.log").write_bytes(b"\xff\xfe")
    (tmp_path / "y.log").write_text("no header\n")
    files = segments.read(spark, str(tmp_path))
    assert [r["file"].rsplit("/", 1)[1] for r in segments.damaged(files).collect()] == ["x.log", "y.log"]
    assert segments.damaged(segments.read(spark, str(tmp_path), limit=10)).count() == 4


def test_transrept_and_its_windows(spark, tmp_path):
    write(tmp_path)
    t = api.transrept(spark, str(tmp_path))
    assert t.where(F.col("p") == LOG + "text").count() == 7
    assert t.where(F.col("o") == LOG + "Segment").count() == 2
    bounded = api.transrept(spark, str(tmp_path), since="2024-01-01T00:00:01.000Z", until="2024-01-01T00:00:02.000Z")
    assert bounded.where(F.col("p") == LOG + "text").count() == 2


def test_stream_of_files_gives_the_batch_rows(spark, tmp_path):
    write(tmp_path)
    v = Vocabulary.built_in()
    got = live.drained(live.triples_of(live.finished_files(spark, str(tmp_path)), v), "files")
    lines = segments.lines(segments.read(spark, str(tmp_path))).where("kind = 'entry'").withColumn("e", X.parse_entry(F.col("raw"), F.col("prefixes")))
    want = live.triples.declared(lines.select("segment", F.lit(None).cast("string").alias("instance"), "line_no", "e.*"), v)
    assert rows_of(got) == rows_of(want) != []


def test_level_changes_must_be_recorded(spark):
    level = lambda x: F.array(F.struct(F.lit(1).cast("long").alias("at"), F.lit(x[0]).alias("from"), F.lit(x[1]).alias("to")))
    steps = F.concat(level(("a", "b")), level(("b", "c")))
    row = spark.range(1).select(verify.bracketed(F.lit("a"), F.lit("c"), steps).alias("two"), verify.bracketed(F.lit("c"), F.lit("a"), steps).alias("back"))
    assert row.first().asDict() == {"two": True, "back": False}


def test_chain_order_follows_links_before_names(spark):
    rows = [("s3", "i", "genesis", "h1"), ("s1", "i", "h1", "h2"), ("s2", "i", "h2", "h3"), ("t2", "j", "x", "y"), ("t1", "j", "z", "w")]
    got = verify.chain_order(spark.createDataFrame(rows, "segment string, instance string, prev string, head string")).collect()
    assert {r["segment"]: r["place"] for r in got} == {"s3": 1, "s1": 2, "s2": 3, "t1": 1, "t2": 2}


def test_a_long_chain_is_ranked_by_its_links(spark):
    n = 100_000
    i = F.col("id")
    rows = spark.range(n).select(F.sha2(i.cast("string"), 256).alias("segment"), F.lit("i").alias("instance"), F.when(i == 0, "genesis").otherwise(F.concat(F.lit("h"), (i - 1).cast("string"))).alias("prev"), F.concat(F.lit("h"), i.cast("string")).alias("head"), i)
    placed = verify.chain_order(rows)
    assert placed.where(F.col("place") == i + 1).count() == n


def test_forks_and_cycles_go_by_name(spark):
    chain = [("c1", "c", "genesis", "h1"), ("c0", "c", "h1", "h2"), ("c2", "c", "h4", "h3"), ("c3", "c", "h3", "h4")]  # a cycle beside a chain
    fork = [("f2", "f", "genesis", "h1"), ("f1", "f", "h1", "h2"), ("f0", "f", "h1", "h3")]
    twice = [("t1", "t", "genesis", "h1"), ("t0", "t", "h1", "h1")]  # one head of two
    got = verify.chain_order(spark.createDataFrame(chain + fork + twice, "segment string, instance string, prev string, head string")).collect()
    assert [r["segment"] for r in sorted(got, key=lambda r: (r["instance"], r["place"]))] == ["c0", "c1", "c2", "c3", "f0", "f1", "f2", "t0", "t1"]


def test_intervals_between_seals_are_folded_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(verify, "BUCKET", 3)
    write(tmp_path, n=40, cadence=Cadence(4, None, 25, None))
    files = sorted(tmp_path.glob("*.log"))
    files[0].write_text(files[0].read_text().replace("msg=m9", "msg=x"))  # every seal from here on
    seal = next(x for x in files[1].read_text().split("\n") if x.startswith("#seal"))
    files[1].write_text(files[1].read_text().replace(seal, seal[:-3] + "000"))  # that seal, and the interval after it
    headers, lines = segments.opened(segments.read(spark, str(tmp_path)))
    want = verify.seal_mismatches(verify.scanned(lines), headers)
    got = verify.interval_mismatches(lines, headers)
    assert rows_of(got) == rows_of(want) and len({r["segment"] for r in got.collect()}) == 2
    again = verify.verify(headers, lines, Vocabulary.built_in(), intervals=True)[1]
    assert rows_of(again) == rows_of(verify.verify(headers, lines, Vocabulary.built_in())[1])


def test_copies_of_a_file_are_verified_each_by_itself(spark, tmp_path):
    out = write(tmp_path)
    first = (tmp_path / "0.log").read_text()
    (tmp_path / "copy.log").write_text(first.replace("msg=m0", "msg=m9"))
    report, found = api.verify(spark, str(tmp_path))
    assert {(r["file"][-5:], r["entries"]) for r in report.collect()} == {("0.log", 5), ("1.log", 5), ("y.log", 5)} or report.count() == 3
    mismatched = found.where("kind = 'SealMismatch'").collect()
    assert {r["file"].rsplit("/", 1)[1] for r in mismatched} == {"copy.log"} and {r["segment"] for r in mismatched} == {min(out)}
    said = [r["line"] for r in verify.text_report(report, found).collect()]
    assert sum(x.startswith(f"segment {min(out)} ") for x in said) == 2 and said[-1].startswith("verified 3 segment(s)")
    assert [r["line"] for r in api.segment(spark, str(tmp_path), min(out)).orderBy("line_no").collect()] == out[min(out)]
    assert api.transrept(spark, str(tmp_path)).where(F.col("p") == LOG + "text").count() == 7


def test_a_file_that_changes_while_it_is_read_is_a_conflict(spark, tmp_path):
    write(tmp_path)
    (tmp_path / "x.log").write_text("gone\n")
    before = segments.manifest(spark, str(tmp_path))
    files = segments.cut(segments.read(spark, str(tmp_path)), "files")
    (tmp_path / "0.log").write_text((tmp_path / "0.log").read_text() + "# more\n")
    (tmp_path / "x.log").unlink()
    (tmp_path / "new.log").write_text("new\n")
    got = segments.settled(before, files, segments.manifest(spark, str(tmp_path)))
    state = {r["file"].rsplit("/", 1)[1]: (r["error"], r["text"] is not None, r["hash"] is not None) for r in got.collect()}
    wrong = ("changed while it was read", False, False)
    assert state == {"0.log": wrong, "x.log": wrong, "new.log": wrong, "1.log": (None, True, True)}
    calm = segments.read_pinned(spark, str(tmp_path))
    assert calm.where("error is null and hash is not null").count() == 3
    report, found = verify.verify(*segments.opened(got), Vocabulary.built_in())
    assert report.count() == 1 and found.where("x = 'changed while it was read'").count() == 3


@pytest.mark.parametrize("value", ["", "a b", 'q"uote', "back\\slash", "new\nline", "tab\t", "‎bidi‮", "é漢😀", "a=b", "\x00\x7f", "x" * 30000])
def test_values_survive_the_line(spark, value):
    df = spark.createDataFrame([(value,)], "v string").withColumn("line", X.render_entry(F.lit("2024-01-01T00:00:00.000Z"), F.lit("log:Message"), F.lit("urn:x:y"), F.array(F.struct(F.lit("msg").alias("key"), F.col("v").alias("value")))))
    e = df.select("line", X.parse_entry(F.col("line"), F.create_map(F.lit("log"), F.lit(LOG))).alias("e"), X.is_scannable(F.col("line")).alias("ok")).first()
    assert e["ok"] and "\n" not in e["line"] and e["e"]["fields"][0]["value"] == value and e["e"]["class"] == LOG + "Message"


def test_config_layers(tmp_path):
    (tmp_path / "log.toml").write_text('level = "debug"\n[seal]\nentries = 5\n')
    (tmp_path / "app.log.toml").write_text('[seal]\nmillis = "never"\n')
    c = config.load(str(tmp_path), "app")
    assert (c.level, c.seal) == ("debug", {"entries": 5, "millis": None})
    assert [k for k, _ in config.changes(config.Config(), c, "f")] == ["LevelChange", "ConfigChange", "ConfigChange"]
    for bad in ({"color": "x"}, {"level": "loud"}, {"seal": {"entries": 0}}, {"seal": {"x": 1}}, {"directory": " "}, {"destination": "mail"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            config.merged(config.Config(), bad)


def test_vocabulary_extension():
    turtle = f'@prefix log: <{LOG}> .\n@prefix x: <urn:x#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\nx:Sale rdfs:subClassOf log:Access ; log:minLevel log:error .\nx:price log:keyName "price" ; rdfs:range xsd:integer .\n'
    v = Vocabulary.built_in().extend(turtle)
    assert v.nearest("urn:x#Sale", v.least) == LOG + "error" and v.nearest("urn:x#Sale", v.predicate) == LOG + "requested"
    assert v.keys["price"] == ("urn:x#price", "http://www.w3.org/2001/XMLSchema#integer")


def test_callers_cannot_write_what_is_the_writers(spark):
    rows = [(LOG + "Message", "urn:x:y", [("msg", "a")]), (LOG + "Seal", "urn:x:y", []), (LOG + "Message", "no", []), (LOG + "Message", "urn:x:y", [("seq", "1")]), (LOG + "Message", "urn:x:y", [("a b", "1")])]
    r = spark.createDataFrame(rows, "class string, subject string, fields array<struct<key: string, value: string>>")
    got = [x["error"] for x in api.checked(r, Vocabulary.built_in().class_table(spark)).collect()]
    assert got[0] is None and all(got[1:])


def test_level_filter_of_the_writer(spark):
    rows = [("urn:inst:a", f"2024-01-01T00:00:0{i}.000Z", i, LOG + c, "log:" + c, "urn:x:y", "") for i, c in enumerate(["Error", "Resolution", "CacheHit", "Message"])]
    e = spark.createDataFrame(rows, "instance string, time string, ms long, class string, curie string, subject string, tail string")
    lines = [r["line"] for r in api.write_entries(e, level="info").orderBy("line_no").collect()]
    assert [x.split()[1] for x in lines if x[:2] == "20"] == ["log:ProcessStart", "log:Error", "log:Message", "log:ProcessStop"]
