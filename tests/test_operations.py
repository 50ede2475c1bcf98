"""The operations on folders: damaged files, windows, sinks that are read back, restarts, configuration, streams."""

from __future__ import annotations

import io
from contextlib import redirect_stderr, redirect_stdout

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_parts import write

from provlog import api, config
from provlog.functions import text as X
from provlog.operators import triples, verify, writer
from provlog.operators.writer import Cadence, Predecessor, Segments
from provlog.sources import segments
from provlog.streaming import live
from provlog.vocabulary import LOG, PROV, Vocabulary


def damage(folder):
    (folder / "x.log").write_bytes(b"\xff\xfe")
    (folder / "y.log").write_text("no header\n")
    (folder / "z.log").write_text("# provlog v1\n@name urn:log:z\n\n")  # directives are missing


def test_one_damaged_file_hides_no_other(spark, tmp_path):
    out = write(tmp_path)
    damage(tmp_path)
    files = segments.read(spark, str(tmp_path))
    assert [r["segment"] for r in api.list_segments(spark, str(tmp_path)).collect()] == sorted(out)
    assert [(r["file"][-5:], r["error"]) for r in segments.damaged(files).collect()] == [("x.log", "not UTF-8"), ("y.log", "not a header line"), ("z.log", "missing instance")]
    report, found = api.verify(spark, str(tmp_path))
    assert report.count() == 2 and {(r["segment"][-5:], r["kind"], r["a"]) for r in found.collect()} == {(f"{x}.log", "Malformed", 1) for x in "xyz"}
    said = [r["line"] for r in verify.text_report(report, found).collect()]
    assert said[-1] == "verified 5 segment(s), 3 broken" and [x.endswith("BROKEN unreadable") for x in said if x.startswith("segment")] == [False, False, True, True, True]
    one = sorted(out)[0]
    for chosen in ({"segment": one}, {"instance": "urn:inst:a"}):
        report, found = api.verify(spark, str(tmp_path), **chosen)
        assert report.count() == 2 and found.count() == 0
    assert api.verify(spark, str(tmp_path), segment="urn:log:none")[0].count() == 0
    with pytest.raises(ValueError, match="over budget"):
        api.verify(spark, str(tmp_path), budget=100)
    with pytest.raises(ValueError, match="instance: blank"):
        api.verify(spark, str(tmp_path), instance=" ")
    assert api.exists(spark, str(tmp_path), one) and not api.exists(spark, str(tmp_path), "urn:log:z")
    assert [r["line"] for r in api.segment(spark, str(tmp_path), one).orderBy("line_no").collect()] == out[one]


def test_long_headers_and_windows_line_ends(spark, tmp_path):
    for i, end in enumerate(("\n", "\r\n")):
        top = ["# provlog v1", f"@prefix log: <{LOG}> .", *[f"@prefix p{k}: <urn:{'x' * 60}{k}> ." for k in range(300)], f"@name urn:log:long{i}", "@instance urn:inst:l", "@level log:info", "@started 2024-01-01T00:00:00.000Z", "@prev genesis", ""]
        (tmp_path / f"{i}.log").write_bytes(end.join([*top, "2024-01-01T00:00:01.000Z log:Message urn:x:y msg=a", ""]).encode())
    files = segments.read(spark, str(tmp_path))
    assert [r["segment"] for r in api.list_segments(spark, str(tmp_path)).collect()] == ["urn:log:long0", "urn:log:long1"]
    headers, lines = segments.opened(files)
    got = {r["segment"]: r for r in lines.where("kind = 'entry'").collect()}
    assert len(got) == 2 and len({(r["line_no"], r["raw"]) for r in got.values()}) == 1 and len({r["h0"] for r in headers.collect()}) == 2
    rows = files.withColumn("h", segments.parse_header(F.col("text"))).select(F.col("h.name").alias("segment"), F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).select("segment", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    again, others = segments.of_lines(rows)
    assert rows_of(again.select("segment", "h0", "head_lines")) == rows_of(headers.select("segment", "h0", "head_lines"))
    assert others.where("kind = 'entry'").count() == 2


def test_written_files_are_read_back_and_never_overwritten(spark, tmp_path):
    w = Segments("urn:inst:a", "trace", Cadence(2, None, 4, None))
    rows = [row for i in range(7) for row in w.add(f"2024-01-01T00:00:{i:02d}.000Z", 1000 * i, "log:Message", "urn:x:y", f" msg=m{i}")] + w.close("2024-01-01T00:01:00.000Z", 60_000)
    rows += [("urn/log:a:2024-01-01T00-00-00Z", n, line.replace("urn:log:a:", "urn/log:a:")) for s, n, line in rows if s == "urn:log:a:2024-01-01T00-00-00Z"]  # the same slug
    lines = spark.createDataFrame(rows, "segment string, line_no long, line string")
    path = str(tmp_path / "out")
    writer.deliver(lines, "file", path)
    assert api.list_segments(spark, path).count() == len({s for s, _, _ in rows})
    report, found = api.verify(spark, path, instance="urn:inst:a")
    assert report.where("finished").count() >= 2
    with pytest.raises(Exception, match="already exists"):
        writer.deliver(lines, "file", path)
    said, out = io.StringIO(), io.StringIO()
    with redirect_stderr(said), redirect_stdout(out):
        writer.deliver(lines, "console")
        writer.deliver(lines, "off")
    assert "msg=m3" in said.getvalue() and out.getvalue() == ""
    seen = str(tmp_path / "seen")

    def sink(part):
        with open(seen, "a") as f:
            f.writelines(f"{r['segment']} {r['line_no']}\n" for r in part)

    writer.deliver(lines, "sink", sink=sink)
    told = [x.rsplit(" ", 1) for x in open(seen).read().splitlines()]
    assert len(told) == len(rows) and all(int(b) == int(a) + 1 for (s, a), (t, b) in zip(told, told[1:]) if s == t)
    with pytest.raises(ValueError, match="destination"):
        writer.deliver(lines, "mail")


def test_a_restarted_writer_goes_on_from_the_chain(spark, tmp_path):
    write(tmp_path, level="info")
    before = api.resumed(spark, str(tmp_path))
    tail = before.first()
    assert tail["level"] == LOG + "info" and tail["name"] == sorted(write(tmp_path, level="info"))[-1]
    e = spark.createDataFrame([("urn:inst:a", "2023-01-01T00:00:00.000Z", 5, LOG + "Error", "log:Error", "urn:x:y", " msg=late")], "instance string, time string, ms long, class string, curie string, subject string, tail string")
    path = str(tmp_path / "more")
    c = config.merged(config.Config(), {"level": "error", "directory": path})
    lines = api.write_entries(e, config=c, predecessors=before)
    names = {r["segment"] for r in lines.collect()}
    assert len(names) == 1 and min(names) > tail["name"]  # stamped no earlier than what it follows
    report, found = api.verify(spark, str(tmp_path))
    assert report.count() == 3 and found.count() == 0  # the change of the level is recorded, and sealed
    text = "\n".join(r["line"] for r in lines.orderBy("line_no").collect())
    assert f"log:LevelChange {min(names)} seq=2 key=level from={LOG}info to={LOG}error effective=this-segment" in text
    w = Segments("urn:inst:a", "info", Cadence(), None, 42, "urn:inst:asked", Predecessor(tail["name"], LOG + "info", tail["head"], tail["started"]))
    assert w.add("2024-01-01T00:00:00.000Z", 0, "log:Message", "urn:x:y", "")[9][2].endswith("log:ProcessStart urn:inst:a seq=1 pid=42 configured=urn:inst:asked")


def test_segments_of_one_second(spark):
    w = Segments("urn:inst:a", "trace", Cadence(None, None, 1, None))
    names = [s for i in range(5) for s, n, _ in w.add("2024-01-01T00:00:00.000Z", 0, "log:Message", "urn:x:y", "") if n == 1]
    assert names == ["urn:log:a:2024-01-01T00-00-00Z", *[f"urn:log:a:2024-01-01T00-00-00Z-{i}" for i in range(1, 6)]]
    # Where the second's names are used up the entries go on in the open segment, and one error notes it; the next second has names.
    more = [r for _ in range(200) for r in w.add("2024-01-01T00:00:00.000Z", 0, "log:Message", "urn:x:y", "")]
    last = f"{names[0]}-100"
    assert len({s for s, _, _ in more}) == 96 and sum(" log:Message " in line for _, _, line in more) == 200
    assert [(s, line) for s, _, line in more if " log:Error " in line] == [(last, f'2024-01-01T00:00:00.000Z log:Error {last} seq=3 reason=rotation-failed msg="{names[0]}: more than 100 segments in a second"')]
    again = Segments("urn:inst:a", "trace", Cadence(None, None, 1, None)).restore(w.state()).add("2024-01-01T00:00:01.000Z", 1000, "log:Message", "urn:x:y", "")
    assert again[-1][0] == "urn:log:a:2024-01-01T00-00-01Z" and [line for s, _, line in again if s == last][-2].endswith(" next=urn:log:a:2024-01-01T00-00-01Z")


def test_refusals_are_about_the_segment_they_land_in(spark):
    rows = [("urn:inst:a", 1000, "urn:cap:x", "read it", "urn:agent:b"), ("urn:inst:a", 2000, "urn:cap:y", "urn:do:that", None)]
    r = api.denials(spark.createDataFrame(rows, "instance string, ms long, capability string, action string, principal string"))
    lines = [x["line"] for x in api.write_entries(r, Cadence(None, None, 2, None), level="error").orderBy("segment", "line_no").collect() if "Denied" in x["line"]]
    one, two = (f"urn:log:a:1970-01-01T00-00-01Z{n}" for n in ("", "-1"))
    assert lines == [
        f'1970-01-01T00:00:01.000Z log:CapabilityDenied {one} seq=2 principal=urn:agent:b denied=urn:cap:x reason="read it"',
        f"1970-01-01T00:00:02.000Z log:CapabilityDenied {two} seq=2 denied=urn:cap:y reason=urn:do:that",
    ]


def test_bounds_and_sequences_are_unsigned_numbers_of_64_bits(spark):
    from decimal import Decimal

    top = (1 << 64) - 1
    rows = [(f"#seal {a}-{b} sha256:x",) for a, b in ((1, top), (1 << 63, (1 << 63) + 5), (1, top + 1), (10**40, 10**41))]
    s = X.parse_seal(F.col("r"))
    got = [tuple(x) for x in spark.createDataFrame(rows, "r string").select(s["first"], s["last"], X.is_seal(F.col("r"), s)).collect()]
    assert got == [(Decimal(1), Decimal(top), True), (Decimal(1 << 63), Decimal((1 << 63) + 5), True), (Decimal(1), None, False), (None, None, False)]


def test_unreadable_lines_are_errors_unless_a_window_leaves_them_out(spark, tmp_path):
    write(tmp_path)
    text = (tmp_path / "0.log").read_text()
    (tmp_path / "0.log").write_text(text + "2024-01-01T00:00:59.000Z nothing\n")
    with pytest.raises(ValueError, match="no entry"):
        api.transrept(spark, str(tmp_path))
    assert api.transrept(spark, str(tmp_path), until="2024-01-01T00:00:30.000Z").where(F.col("p") == LOG + "text").count() == 7
    loose = api.transrept(spark, str(tmp_path), strict=False)
    assert loose.select("graph").distinct().count() == 1
    some = api.transrept(spark, str(tmp_path), strict=False, first=2, last=3)
    assert some.where(F.col("p") == LOG + "sequence").select("o").distinct().count() == 2


def test_documents_are_escaped_and_in_order(spark, tmp_path):
    rows = [("g", f"s{i}", p, o, k, t) for i, (p, o, k, t) in enumerate([(LOG + "text", 'a"b\\c\r\t\n\x01\x7f\b', "literal", None), ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", LOG + "Entry", "iri", None), ("urn:x:y", LOG + "a/b", "iri", None), (LOG + "bytes", "5", "literal", "http://www.w3.org/2001/XMLSchema#integer")])]
    d = [r["line"] for r in triples.turtle(spark.createDataFrame(rows, "graph string, s string, p string, o string, o_kind string, o_type string")).collect()]
    assert d[4:] == [r'<s0> log:text "a\"b\\c\r\t\n\u0001\u007F\b" .', "<s1> a log:Entry .", f"<s2> <urn:x:y> <{LOG}a/b> .", '<s3> log:bytes "5"^^xsd:integer .'] and not any("logkey" in x for x in d)
    write(tmp_path)
    t = api.transrept(spark, str(tmp_path), ordered=True)
    first = t.select("graph").orderBy("graph").first()["graph"]
    d = [r["line"] for r in triples.turtle(t.where(F.col("graph") == first)).collect()]
    assert d[4].startswith("@prefix logkey:") and d[5].startswith(f"<{first}> a log:Segment") and d[-1].startswith(f"<{first}:seal:")
    at = [int(x.split(":seal:")[0].split(first + ":")[1].split(">")[0].split(":")[0]) for x in d if x.startswith(f"<{first}:") and ":seal:" not in x and "log:invoked" not in x and ":delegation" not in x]
    assert at == sorted(at)
    digest = triples.digests(triples.turtle(t)).collect()
    import hashlib

    assert {r["graph"]: r["hash"] for r in digest}[first] == "sha256:" + hashlib.sha256(("\n".join(d) + "\n").encode()).hexdigest()
    kept = api.kept(t.drop("part", "at", "pos"), api.verify(spark, str(tmp_path))[0], "kept")
    assert rows_of(kept) == rows_of(t.drop("part", "at", "pos"))


def test_predicates_that_are_no_iris_and_second_principals(spark):
    fields = [("principal", "urn:agent:a"), ("principal", "anon"), ("principal", "urn:agent:b"), ("odd{key", "v"), ("k", "1"), ("k", "1"), ("k", "2")]
    e = spark.createDataFrame([("g", "urn:inst:i", 1, "2024-01-01T00:00:00.000Z", "not an iri", "urn:x:{y}", fields)], "segment string, instance string, line_no long, time string, class string, subject string, fields array<struct<key: string, value: string>>")
    v = Vocabulary.built_in()
    got = rows_of(triples.undeclared(e, v).select("p", "o"))
    key = "urn:provlog:ns/key#k"
    assert sorted(got) == sorted([("v", LOG + "undeclaredKey"), ("odd{key", LOG + "undeclaredKey"), ("1", key), ("2", key), ("k", LOG + "undeclaredKey")])
    core = {(r["p"], r["o"], r["o_kind"]) for r in triples.core(e, v.class_table(spark)).collect()}
    assert {(LOG + "unreadableIri", "class=not an iri", "literal"), (LOG + "unreadableIri", "subject=urn:x:{y}", "literal"), (LOG + "subject", "urn:x:{y}", "literal")} <= core
    d = {(r["s"], r["o"]) for r in triples.delegation(e).where(F.col("p") == PROV + "agent").collect()}
    assert d == {("g:1:delegation", "urn:agent:a"), ("g:1:delegation:2", "urn:agent:b")}


def test_changed_files_are_told(spark, tmp_path):
    write(tmp_path)
    before = spark.createDataFrame(segments.read(spark, str(tmp_path)).select("file", "bytes", "modified").collect())
    assert segments.conflicts(before, segments.read(spark, str(tmp_path))).count() == 0
    (tmp_path / "0.log").write_text((tmp_path / "0.log").read_text() + "#\n")
    assert [r["file"][-5:] for r in segments.conflicts(before, segments.read(spark, str(tmp_path))).collect()] == ["0.log"]
    assert all(r["valid"] and r["hash"].startswith("sha256:") for r in segments.bodies(segments.read(spark, str(tmp_path))).collect())


def test_configuration_has_two_faces_and_is_written_key_by_key(spark, tmp_path):
    (tmp_path / "log.toml").write_text('level = "warn"\n[seal]\nentries = 5\n')
    after, said = config.write_layer(str(tmp_path), {"seal": {"millis": "never"}, "level": "warn", "directory": 'a "b"\\ü'}, "app")
    assert after.seal == {"entries": 5, "millis": None} and after.directory == 'a "b"\\ü'
    assert [(c, dict(f)["key"]) for c, f in said] == [("ConfigChange", "directory"), ("ConfigChange", "seal.millis")]
    config.write_layer(str(tmp_path), {"seal": {"entries": 7}}, "app")
    assert config.load(str(tmp_path), "app").seal == {"entries": 7, "millis": None}
    text = (tmp_path / "app.log.toml").read_text()
    with pytest.raises(ValueError, match="colour"):
        config.write_layer(str(tmp_path), {"colour": "red"}, "app")
    assert (tmp_path / "app.log.toml").read_text() == text
    face = api.config(spark, str(tmp_path), "app", face="toml")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "log.toml").write_text(face)
    assert config.flat(config.load(str(tmp_path / "other"))) == config.flat(config.load(str(tmp_path), "app"))
    g = {(r["s"], r["p"], r["o"]) for r in api.config(spark, str(tmp_path), "app").collect()}
    me = "urn:log:config"
    assert {(me, LOG + "currentSegment", LOG + "none"), (me + "#seal", LOG + "unbounded", LOG + "everyMillis"), (me + "#seal", LOG + "everyEntries", "7"), (me, LOG + "configLayer", str(tmp_path / "app.log.toml"))} <= g
    entries = api.write_config(spark, str(tmp_path), {"level": "error"}, "app").collect()
    assert [(r["class"], {f["key"]: f["value"] for f in r["fields"]}["to"]) for r in entries] == [(LOG + "LevelChange", "error")]


def test_requests_have_defaults(spark):
    rows = [("urn:inst:a", 5, None, None, "hello there", None), ("urn:inst:a", 6, "urn:other#X", "urn:x:y", None, [("k", "v")])]
    r = api.requested(spark.createDataFrame(rows, "instance string, ms long, class string, subject string, msg string, fields array<struct<key: string, value: string>>"))
    got = [(x["curie"], x["subject"], x["tail"]) for x in r.orderBy("ms").collect()]
    assert got == [("log:Message", "urn:inst:a", ' msg="hello there"'), ("<urn:other#X>", "urn:x:y", " k=v")]
    bad = r.select(X.entry_error(F.col("time"), F.col("class"), F.col("subject"), F.col("fields")).alias("e"), X.entry_error(F.lit("now"), F.col("class"), F.col("subject"), F.col("fields")).alias("t"), X.entry_error(F.col("time"), F.col("class"), F.lit("a b"), F.col("fields")).alias("s"))
    assert [tuple(x) for x in bad.collect()] == [(None, "no time", "subject is no IRI")] * 2
    assert [x[0] for x in spark.createDataFrame([("serve",), ("urn:inst:x",)], "n string").select(X.instance_iri(F.col("n"), "urn:inst:")).collect()] == ["urn:inst:serve", "urn:inst:x"]


def test_streams_keep_state_over_batches_within_a_bound(spark, tmp_path):
    v = Vocabulary.built_in()
    rows = [("g", "urn:inst:i", n, f"2024-01-01T00:00:0{n}.000Z log:{c} urn:x:y{t}", "entry") for n, (c, t) in enumerate([("ProcessStart", ""), ("Message", " span=1"), ("Message", " parent=1 principal=urn:agent:a"), ("ProcessStart", ""), ("Message", " parent=1"), ("ProcessStop", "")], 1)]
    bound = F.create_map(F.lit("log"), F.lit(LOG))
    path = str(tmp_path / "source")
    kind = "segment string, instance string, line_no long, raw string, kind string"
    spark.createDataFrame(rows[:3], kind).withColumn("prefixes", bound).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    seen = []
    listener = live.Appended(lambda name, n, batch: seen.append(n))
    spark.streams.addListener(listener)
    out = str(tmp_path / "out")

    def run():
        q = live.started(live.followed(stream, v), out)
        q.awaitTermination()
        return {(r["what"], r["line_no"], r["ordinal"], r["a"], r["b"]) for r in spark.read.parquet(f"{out}/out").collect()}

    assert run() == {("entry", n, n, None, None) for n in (1, 2, 3)}
    spark.createDataFrame(rows[3:], kind).withColumn("prefixes", bound).coalesce(1).write.mode("append").parquet(path)
    assert run() == {("entry", n, n, None, None) for n in range(1, 7)} | {("edge", None, None, "g:2", "g:3"), ("agent", None, None, "urn:agent:a", None)}
    spark.streams.removeListener(listener)
    by_file = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(Exception, match="over budget"):
        live.drained(live.followed(by_file, v, budget=10), "small")  # what the first file leaves to be kept


def test_a_rotated_chain_written_out_by_hand():
    import hashlib

    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    prov = "http://www.w3.org/ns/prov#"

    def head(name: str, started: str, prev: str) -> list[str]:
        return ["# provlog v1", f"@prefix log:  <{LOG}> .", f"@prefix prov: <{prov}> .", f"@name     {name}", "@instance urn:inst:a", "@level    log:trace", f"@started  {started}", f"@prev     {prev}", ""]

    def fold(head: str, *lines: str) -> str:
        for line in lines:
            head = sha(head + "\n" + line)
        return head

    at = lambda i: f"2024-01-01T00:00:{i:02d}.000Z"
    one, two, three = (f"urn:log:a:2024-01-01T00-00-0{i}Z" for i in (1, 2, 5))
    # The third entry makes three with the process start; the rotation comes right after it, at its time, about the segment itself.
    top = head(one, at(1), "genesis")
    body = [f"{at(1)} log:ProcessStart urn:inst:a seq=1 pid=7", f"{at(1)} log:Message urn:x:y seq=2 msg=a"]
    h0 = sha("\n".join(top) + "\n")
    sealed = fold(h0, *body)
    more = [f"{at(2)} log:Message urn:x:y seq=3 msg=b", f"{at(2)} log:Rotation {one} seq=4 next={two}"]
    ended = fold(sealed, *more)
    want = [*top, *body, f"#seal 1-2 {sealed}", *more, f"#seal 3-4 {ended}"]
    # Each segment begins with a process start; an entry that the level leaves out can make a rotation due by its time.
    top = head(two, at(2), ended)
    start = f"{at(2)} log:ProcessStart urn:inst:a seq=1 pid=7"
    rotation = f"{at(5)} log:Rotation {two} seq=2 next={three}"
    again = fold(sha("\n".join(top) + "\n"), start, rotation)
    want += [*top, start, rotation, f"#seal 1-2 {again}"]
    # An entry that comes late is written under its own time; a close seals what is left.
    top = head(three, at(5), again)
    body = [f"{at(5)} log:ProcessStart urn:inst:a seq=1 pid=7", f"{at(3)} log:Message urn:x:y seq=2 msg=c"]
    sealed = fold(sha("\n".join(top) + "\n"), *body)
    stop = f"{at(6)} log:ProcessStop urn:inst:a seq=3"
    want += [*top, *body, f"#seal 1-2 {sealed}", stop, f"#seal 3-3 {fold(sealed, stop)}"]
    w = Segments("urn:inst:a", "trace", Cadence(2, None, 3, 3000), pid=7)
    rows = w.add(at(1), 1000, "log:Message", "urn:x:y", " msg=a") + w.add(at(2), 2000, "log:Message", "urn:x:y", " msg=b") + w.add(at(5), 5000, None, None, None)
    rows += w.add(at(3), 3000, "log:Message", "urn:x:y", " msg=c") + w.close(at(6), 6000)
    assert [line for _, _, line in rows] == want
    assert [n for s, n, _ in rows if s == two] == list(range(1, 13))
