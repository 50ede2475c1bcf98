"""Verification of segments and of chains of segments: findings and reports as tables.

Lines of a segment are ordered by windows over the segment, whose size rotation bounds.  The
hash chain is checked in one pass over a segment's ordered lines, with the chain's state alone
in memory.

findings: segment, kind, breaking, a, b, c (numbers), x, y (texts); what they hold:

=======================  ==============================================
Malformed                a: line; x: why, where the header can't be read
SealMismatch             a, b: range; x: stated, y: recomputed
SealRangeMismatch        a, b: range; c: covered
SealRangeGap             a: after, b: next first
SequenceGap              a: after, b: next
AfterTheEnd              a: ended at, b: from, c: to
UnmarkedEnd              x: class of the last entry
UnsealedTail             a: from, b: to
PrevMismatch             x: stated, y: expected
UnexpectedGenesis        x: predecessor
MissingSuccessor         x: successor that was named
UnbracketedLevelChange   x: from, y: to
=======================  ==============================================
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators.chain import batched, in_order, rows_of
from provlog.operators.writer import tagged
from provlog.sources.tables import written
from provlog.vocabulary import LOG, Vocabulary

#: Sequences, places and bounds: unsigned numbers of 64 bits.
NUMBER = "decimal(20,0)"
FINDING = f"struct<kind: string, breaking: boolean, a: {NUMBER}, b: {NUMBER}, c: {NUMBER}, x: string, y: string>"
NOTED = ("UnmarkedEnd", "UnsealedTail")
CHANGES = f"array<struct<at: {NUMBER}, from: string, to: string>>"


def finding(kind: str, a=None, b=None, c=None, x=None, y=None) -> Column:
    of = lambda v, t: (F.lit(v) if v is None or isinstance(v, (str, int)) else v).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(kind not in NOTED).alias("breaking"), of(a, NUMBER).alias("a"), of(b, NUMBER).alias("b"), of(c, NUMBER).alias("c"), of(x, "string").alias("x"), of(y, "string").alias("y")
    ).cast(FINDING)


def exploded(rows: DataFrame, *found: Column) -> DataFrame:
    each = rows.select("segment", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f"))
    return each.select("segment", "f.*")


def noted(v: Vocabulary) -> list[str]:
    """Classes of whose fields reports read something."""
    return [c for name in ("Rotation", "ConfigChange", "LevelChange") for c in v.below(LOG + name)]


def scanned(lines: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """segment, line_no, raw, is_entry, is_seal, bad, class, fields, seal, stated, position, covered (sealed before), previous (stated sequence before).

    classes: those whose fields are kept; others have null.
    """
    e = X.parse_entry(F.col("raw"), F.col("prefixes"))
    p = X.once(X.once(lines, "e", F.when(F.col("kind") == "entry", e)), "seal", F.when((F.col("kind") == "seal"), X.parse_seal(F.col("raw"))))
    p = p.withColumns({"is_entry": (F.col("kind") == "entry") & X.is_entry(F.col("raw"), F.col("e")), "is_seal": (F.col("kind") == "seal") & X.is_seal(F.col("raw"), F.col("seal"))})
    stated = F.when(F.col("is_entry"), X.stated_sequence(F.col("e.fields")))
    fields = F.col("e.fields") if classes is None else F.when(F.col("e.class").isin(classes), F.col("e.fields"))
    bad = F.col("kind").isin("entry", "seal", "directive") & ~F.col("is_entry") & ~F.col("is_seal")
    # What isn't asked for later goes before lines are sorted.
    p = p.select("segment", "line_no", "raw", "is_entry", "is_seal", bad.alias("bad"), F.col("e.class").alias("class"), fields.alias("fields"), F.when(F.col("is_seal"), F.col("seal")).alias("seal"), stated.alias("stated"))
    order = W.partitionBy("segment").orderBy("line_no")
    here, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("own", F.when(F.col("is_entry"), F.coalesce("stated", F.sum(F.col("is_entry").cast("long")).over(here).cast(NUMBER))))
    p = p.withColumn("position", F.coalesce(F.last("own", True).over(here), F.lit(0).cast(NUMBER)))
    p = p.withColumns({
        "covered": F.coalesce(F.last(F.when(F.col("is_seal"), F.col("position")), True).over(before), F.lit(0).cast(NUMBER)),
        "previous": F.last("stated", True).over(before),
    })
    return p.select("segment", "line_no", "raw", "is_entry", "is_seal", "bad", "class", "fields", "seal", "stated", "position", "covered", "previous")


def line_findings(rows: DataFrame) -> DataFrame:
    """What single lines and their neighbours tell."""
    s = F.col("seal")
    return exploded(
        rows,
        F.when(F.col("bad"), finding("Malformed", F.col("line_no"))),
        F.when(F.col("is_seal") & (s["first"] != F.col("covered") + 1), finding("SealRangeGap", F.col("covered"), s["first"])),
        F.when(F.col("is_seal") & (s["last"] != F.col("position")), finding("SealRangeMismatch", s["first"], s["last"], F.col("position"))),
        F.when(F.col("stated") != F.col("previous") + 1, finding("SequenceGap", F.col("previous"), F.col("stated"))),
    )


def seal_mismatches(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Seals whose hash isn't the chain's head at their place; the chain goes on from the head, not from what the seal states."""

    def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment = head = None
        for now, kind, first, last, text in rows:
            if kind == 0 or now != segment:
                segment, head = now, text if kind == 0 else None
            elif head is not None and kind == 1:
                head = tagged(head + "\n" + text)
            elif head is not None and text != head:
                yield segment, first, last, text, head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(folded(rows_of(batches)), pa.schema([("segment", pa.string()), ("first", pa.decimal128(20, 0)), ("last", pa.decimal128(20, 0)), ("x", pa.string()), ("y", pa.string())]))

    none = F.lit(None).cast(NUMBER)
    start = headers.where("h0 is not null").select("segment", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("line_no"), none.alias("first"), none.alias("last"), F.col("h0").alias("text"))
    each = rows.where("is_entry or is_seal").select("segment", F.when(F.col("is_entry"), 1).otherwise(2).alias("kind"), "line_no", F.col("seal.first").alias("first"), F.col("seal.last").alias("last"), F.coalesce("seal.hash", "raw").alias("text"))
    found = in_order(start.unionByName(each), "line_no", "kind").select("segment", "kind", "first", "last", "text").mapInArrow(run, f"segment string, first {NUMBER}, last {NUMBER}, x string, y string")
    return exploded(found, finding("SealMismatch", F.col("first"), F.col("last"), None, F.col("x"), F.col("y")))


#: Lines of a bucket, by which lines and intervals between seals meet.
BUCKET = 4096


def interval_mismatches(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """The findings of :func:`seal_mismatches`, from lines (segment, line_no, raw, kind, prefixes) and headers.

    A seal states the chain's head, so what stands between two seals can be folded from the first one's hash: intervals are dealt to
    tasks, whatever segment they are of.  Where all of a segment's intervals come out, so does the segment.  Only the others are
    folded from their beginning, because there the chain goes on from its own head.
    """
    e = X.parse_entry(F.col("raw"), F.col("prefixes"))
    entries = X.once(lines.where("kind = 'entry'"), "e", e).where(X.is_entry(F.col("raw"), F.col("e"))).select("segment", "line_no", "raw")
    seals = X.once(lines.where("kind = 'seal'"), "s", X.parse_seal(F.col("raw"))).where(X.is_seal(F.col("raw"), F.col("s"))).select("segment", "line_no", "s.first", "s.last", "s.hash")
    order = W.partitionBy("segment").orderBy("line_no")
    h0 = headers.where("h0 is not null").select("segment", "h0")
    each = seals.join(h0, "segment").select(
        "segment", "line_no", "first", "last", "hash", F.coalesce(F.lag("hash").over(order), F.col("h0")).alias("start"), F.coalesce(F.lag("line_no").over(order), F.lit(0).cast("long")).alias("low"),
    )
    each = written(each, "intervals")
    buckets = F.sequence(F.floor((F.col("low") + 1) / BUCKET), F.floor(F.col("line_no") / BUCKET))
    spread = each.select("segment", F.col("line_no").alias("to"), "low", F.explode(buckets).alias("bucket"))
    met = entries.withColumn("bucket", F.floor(F.col("line_no") / BUCKET)).join(spread, ["segment", "bucket"]).where("line_no > low and line_no < to")
    none = F.lit(None).cast("string")
    ends = each.select("segment", F.col("line_no").alias("to"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("line_no"), F.col("start").alias("text"), "hash")
    rows = ends.unionByName(met.select("segment", "to", F.lit(1).alias("kind"), "line_no", F.col("raw").alias("text"), none.alias("hash")))

    def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment = head = stated = None
        for now, kind, text, hash_ in rows:
            if kind == 0:
                if stated is not None and head != stated:
                    yield (segment,)
                segment, head, stated = now, text, hash_
            elif head is not None:
                head = tagged(head + "\n" + text)
        if stated is not None and head != stated:
            yield (segment,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(folded(rows_of(batches)), pa.schema([("segment", pa.string())]))

    dealt = rows.repartition("segment", "to").sortWithinPartitions("segment", "to", "kind", "line_no")
    doubtful = written(dealt.select("segment", "kind", "text", "hash").mapInArrow(run, "segment string").distinct(), "doubtful")
    again = entries.select("segment", "line_no", "raw", F.lit(True).alias("is_entry"), F.lit(False).alias("is_seal"), F.lit(None).cast(f"struct<first: {NUMBER}, last: {NUMBER}, hash: string>").alias("seal"))
    again = again.unionByName(seals.select("segment", "line_no", none.alias("raw"), F.lit(False).alias("is_entry"), F.lit(True).alias("is_seal"), F.struct("first", "last", "hash").alias("seal")))
    return seal_mismatches(again.join(doubtful, "segment", "left_semi"), headers.join(doubtful, "segment", "left_semi"))


def level_iri(name: Column) -> Column:
    """A level's name, CURIE or IRI as an IRI; null where it is none of them."""
    bare = name.isin("always", "error", "warn", "info", "debug", "trace")
    return F.when(bare, F.concat(F.lit(LOG), name)).when(name.startswith("log:"), F.concat(F.lit(LOG), F.substring(name, F.lit(5), F.length(name)))).when(X.is_iri(name), name)


def reports(rows: DataFrame, headers: DataFrame, v: Vocabulary) -> DataFrame:
    """One row for each segment with a header: what its lines say, and where it ends."""
    below = lambda c: v.below(LOG + c)
    ends, rotation, config, level = below("ProcessStop") + below("Rotation"), below("Rotation"), below("ConfigChange"), below("LevelChange")
    of = lambda k: X.first_value(F.col("fields"), k)
    records = F.col("class").isin(level) | (F.col("class").isin(config) & (of("key") == "level"))
    change = F.struct(F.col("position").alias("at"), level_iri(of("from")).alias("from"), level_iri(of("to")).alias("to"))
    entry = F.col("is_entry")
    found = rows.groupBy("segment").agg(
        F.count_if(entry).alias("entries"), F.count_if("is_seal").alias("seals"),
        F.coalesce(F.max_by("position", "line_no"), F.lit(0)).alias("position"),
        F.coalesce(F.max_by("position", F.when(F.col("is_seal"), F.col("line_no"))), F.lit(0)).alias("sealed_through"),
        F.max_by("seal.hash", F.when(F.col("is_seal"), F.col("line_no"))).alias("seal_hash"),
        F.min_by("position", F.when(entry & F.col("class").isin(ends), F.col("line_no"))).alias("ended_at"),
        F.max_by("class", F.when(entry, F.col("line_no"))).alias("last_class"),
        F.max_by(F.when(F.col("class").isin(rotation), of("next")), F.when(entry, F.col("line_no"))).alias("successor"),
        F.array_sort(F.collect_list(F.when(entry & records & change["from"].isNotNull() & change["to"].isNotNull(), change))).alias("changes"),
    )
    first = rows.where("seal.sig_alg is not null").groupBy("segment", F.col("seal.sig_alg").alias("sig_alg")).agg(F.min("line_no").alias("line_no"))
    signs = first.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "sig_alg"))).alias("signs"))  # one for each algorithm
    found = found.join(signs, "segment", "left")
    readable = headers.where("h0 is not null")
    name = [c for c in ("name",) if c in headers.columns]
    h = readable.select("segment", *name, "instance", "level", "prev", "h0").join(found, "segment", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "seals", "position", "sealed_through")]
    sealed = F.filter("changes", lambda c: c["at"] <= F.col("sealed_through"))
    return h.select(
        "segment", *name, "instance", "level", "prev", F.coalesce("seal_hash", "h0").alias("head"), *zero, "ended_at", "last_class", "successor",
        F.coalesce(F.transform("signs", lambda s: s["sig_alg"]), F.array().cast("array<string>")).alias("signed_with"), F.coalesce(sealed, F.array().cast(CHANGES)).alias("level_changes"),
        (F.coalesce(F.col("ended_at") == F.col("position"), F.lit(False)) & (F.coalesce(F.col("sealed_through") >= F.col("position"), F.lit(False)))).alias("finished"),
    )


def reported(lines: DataFrame, headers: DataFrame, v: Vocabulary) -> DataFrame:
    """Reports alone, from lines that are scanned once: counts and signatures both read what reports need of them, which is written."""
    needed = scanned(lines, noted(v)).select("segment", "line_no", "is_entry", "is_seal", "class", "fields", "seal", "position")
    return reports(written(needed, "scanned"), headers, v)


def unreadable(headers: DataFrame) -> DataFrame:
    """Findings of segments whose header, or file, can't be read."""
    return exploded(headers.where("h0 is null"), finding("Malformed", 1, x=F.col("error")))


def end_findings(report: DataFrame) -> DataFrame:
    """Entries after the end, ends that aren't marked, tails that aren't sealed."""
    end, at, sealed = F.col("ended_at"), F.col("position"), F.col("sealed_through")
    return exploded(
        report,
        F.when(end.isNotNull() & ((at > end) | (at > sealed)), finding("AfterTheEnd", end, F.least(end, sealed) + 1, at)),
        F.when(end.isNull(), finding("UnmarkedEnd", x=F.col("last_class"))),
        F.when(end.isNull() & (at > sealed), finding("UnsealedTail", sealed + 1, at)),
    )


def ranked_places(report: DataFrame) -> DataFrame:
    """segment, walked: places by their links of the segments of instances whose segments form one chain of all.

    Links are followed by doubling: in each round a segment knows the one twice as far before it, so a chain of n takes log2(n)
    rounds of one join each and no instance has to fit a task.  Forks and gaps show in the links' counts, cycles in segments that
    no first one is before.
    """
    r = report.select("instance", "segment", "prev", "head")
    heads = r.select("instance", F.col("head").alias("prev"), F.col("segment").alias("before"))
    once = heads.groupBy("instance", "prev").agg(F.min("before").alias("before"))
    linked = r.join(once, ["instance", "prev"], "left").withColumn("before", F.when(F.col("prev") != "genesis", F.col("before")))
    # Distinct heads and links, and one beginning: sums over hashed groups, so that an instance is counted in parts.
    salt = F.pmod(F.xxhash64("segment"), F.lit(64))
    counted = linked.groupBy("instance", salt.alias("salt")).agg(F.count("*").alias("n"), F.count_if(F.col("before").isNull()).alias("firsts")).groupBy("instance").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts"))
    distinct = once.groupBy("instance").agg(F.count("*").alias("heads"))
    prevs = r.where("prev <> 'genesis'").groupBy("instance", "prev").agg(F.count("*").alias("k")).groupBy("instance").agg(F.max("k").alias("followers"))
    fine = counted.join(distinct, "instance").join(prevs, "instance", "left").where("heads = n and firsts = 1 and coalesce(followers, 1) = 1").select("instance", "n")
    at = written(linked.join(fine, "instance").select("instance", "segment", F.col("before").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"), "n"), "ranks")
    most = at.agg(F.max("n")).first()[0] or 0
    for _ in range(max(0, int(most - 1).bit_length())):
        on = at.select("instance", F.col("segment").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        at = written(at.join(on, ["instance", "to"], "left").select("instance", "segment", F.col("further").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "n"), "ranks")
    lost = at.where("to is not null").select("instance").distinct()  # in a cycle, or behind one
    return at.join(lost, "instance", "left_anti").select("segment", (F.col("steps") + 1).alias("walked"))


def chain_order(report: DataFrame) -> DataFrame:
    """report with place: by the links of each instance if they form one chain of all its segments, else by name.

    Where names already follow the links no link is followed.
    """
    name = [c for c in ("name", "segment") if c in report.columns]
    by_name = W.partitionBy("instance").orderBy(*name)
    named = report.withColumns({"place": F.row_number().over(by_name).cast("long"), "linked": F.col("prev").eqNullSafe(F.lag("head").over(by_name)) | (F.row_number().over(by_name) == 1)})
    doubtful = named.groupBy("instance").agg(F.bool_and("linked").alias("ok")).where("not ok").select("instance")
    doubtful = written(doubtful, "doubtful")
    if doubtful.isEmpty():
        return named.drop("linked")
    places = ranked_places(report.join(doubtful, "instance", "left_semi"))
    return named.join(places, "segment", "left").withColumn("place", F.coalesce("walked", "place")).drop("walked", "linked")


def bracketed(before: Column, after: Column, changes: Column) -> Column:
    """Recorded changes lead from one level to the other; a path visits each change once at most."""

    def round_(reached: Column, _: Column) -> Column:
        return F.array_distinct(F.concat(reached, F.transform(F.filter(changes, lambda c: F.array_contains(reached, c["from"])), lambda c: c["to"])))

    return F.array_contains(F.aggregate(changes, F.array(before), round_), after)


def link_findings(report: DataFrame, whole: bool = True) -> DataFrame:
    """What neighbours in a chain tell of each other; whole: the last segment of the walk must not name a successor."""
    order = W.partitionBy("instance").orderBy("place")
    name = F.col("name" if "name" in report.columns else "segment")
    r = report.withColumns({"before": F.lag(F.struct(name.alias("segment"), "head", "level", "level_changes")).over(order), "after": F.lead(name).over(order)})
    b = F.col("before")
    missing = F.col("successor").isNotNull() & (F.col("successor") != F.col("after") if not whole else ~F.col("successor").eqNullSafe(F.col("after")))
    return exploded(
        r,
        F.when(b.isNotNull() & (F.col("prev") == "genesis"), finding("UnexpectedGenesis", x=b["segment"])),
        F.when(b.isNotNull() & (F.col("prev") != "genesis") & (F.col("prev") != b["head"]), finding("PrevMismatch", x=F.col("prev"), y=b["head"])),
        F.when(b.isNotNull() & (b["level"] != F.col("level")) & ~bracketed(b["level"], F.col("level"), F.concat(b["level_changes"], F.col("level_changes"))), finding("UnbracketedLevelChange", x=b["level"], y=F.col("level"))),
        F.when(missing, finding("MissingSuccessor", x=F.col("successor"))),
    )


def chain_findings(report: DataFrame, whole: bool = True) -> DataFrame:
    return link_findings(chain_order(report), whole)


def own_findings(rows: DataFrame, headers: DataFrame, report: DataFrame, mismatches: DataFrame | None = None) -> DataFrame:
    """What a segment tells by itself."""
    broken = seal_mismatches(rows, headers) if mismatches is None else mismatches
    return line_findings(rows).unionByName(broken).unionByName(end_findings(report))


def verify(headers: DataFrame, lines: DataFrame, v: Vocabulary, whole: bool = True, intervals: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of segments; unreadable ones have findings and no report.

    headers: segment, instance, level, prev, h0 (null: unreadable), error, and name, where segment isn't the name itself but a key
    (a file's path).  lines: segment, line_no, raw, kind, prefixes.  intervals: seals are checked by :func:`interval_mismatches`,
    for segments that are too long for a task.
    """
    rows = written(scanned(lines, noted(v)), "scanned")  # every rule below reads it
    report = written(reports(rows, headers, v), "reports")
    mismatches = interval_mismatches(lines, headers) if intervals else None
    found = own_findings(rows, headers, report, mismatches).unionByName(chain_findings(report, whole))
    return report, found.unionByName(unreadable(headers)) if "error" in headers.columns else found


def said(kind: Column) -> Column:
    """A finding as text."""
    return F.concat(kind, *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f" {c}="), F.col(c).cast("string"))).otherwise("") for c in ("a", "b", "c", "x", "y")])


def chain_broken(headers: DataFrame, lines: DataFrame, v: Vocabulary) -> DataFrame:
    """What a writer notes in the successor when it rotates: instance, segment (the successor), class, subject, fields.

    Each rotation verifies the segment that it sealed and that one's predecessor, as a window: the
    predecessor's own predecessor isn't asked for, nor the successor that opens only now.
    """
    rows = written(scanned(lines, noted(v)), "scanned")
    report = written(chain_order(written(reports(rows, headers, v), "reports")), "placed")
    own, links = own_findings(rows, headers, report), link_findings(report, whole=False)
    order = W.partitionBy("instance").orderBy("place")
    closed = report.withColumn("before", F.lag("segment").over(order)).where("successor is not null")
    pair = closed.select("instance", F.col("successor").alias("opened"), F.explode(F.array(F.struct(F.col("segment").alias("segment"), F.lit(True).alias("last")), F.struct(F.col("before").alias("segment"), F.lit(False).alias("last")))).alias("w"))
    pair = pair.select("instance", "opened", "w.segment", "w.last").where("segment is not null")
    each = own.withColumn("from", F.lit(None).cast("boolean")).unionByName(links.withColumn("from", F.col("kind") != "MissingSuccessor")).where("breaking")
    met = pair.join(each, "segment").where("from is null or from = last")  # links point back from the last, forward from the one before
    texts = met.groupBy("instance", "opened", "segment").agg(F.array_sort(F.collect_list(said(F.col("kind")))).alias("findings"))
    field = lambda k, c: F.struct(F.lit(k).alias("key"), c.alias("value"))
    fields = F.concat(F.array(field("expected", F.col("head")), field("stated", F.col("prev"))), F.transform("findings", lambda f: field("finding", f)))
    return texts.join(report.select("segment", "head", "prev"), "segment").select("instance", F.col("opened").alias("segment"), F.lit(LOG + "ChainBroken").alias("class"), F.col("segment").alias("subject"), fields.alias("fields"))


def chains(report: DataFrame, findings: DataFrame) -> DataFrame:
    """instance, segments, broken, ok of each chain."""
    broken = findings.where("breaking").select("segment").distinct().withColumn("is_broken", F.lit(1).cast("long"))
    each = report.join(broken, "segment", "left").groupBy("instance").agg(F.count("*").alias("segments"), F.coalesce(F.sum("is_broken"), F.lit(0)).alias("broken"))
    return each.withColumn("ok", F.col("broken") == 0)


def text_report(report: DataFrame, findings: DataFrame) -> DataFrame:
    """segment, ord, line, in order: a line for each segment of each chain, its findings below it; then unreadable ones; a total.

    The total has neither segment nor place in a segment.  Reports and findings with a column file are told apart by it.
    """
    if "file" in report.columns:
        report, findings = (x.withColumnsRenamed({"segment": "name", "file": "segment"}) for x in (report, findings))
    else:
        report, findings = (x.withColumn("name", F.col("segment")) for x in (report, findings))
    broken = findings.where("breaking").groupBy("segment").agg(F.count("*").alias("broken"))
    signed = F.when(F.size("signed_with") > 0, F.array_join("signed_with", ",")).otherwise("none")
    facts = [F.concat(F.lit(f" {n}="), X.shown(c.cast("string"))) for n, c in (("entries", F.col("entries")), ("seals", F.col("seals")), ("level", F.col("level")), ("prev", F.col("prev")), ("signed", signed), ("head", F.col("head")))]
    placed = chain_order(report).join(broken, "segment", "left")
    state = F.when(F.col("broken") > 0, "BROKEN").otherwise("OK")
    head = placed.select(F.lit(0).alias("part"), "instance", "place", "segment", "name", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("segment "), X.shown(F.col("name")), F.lit(" "), state, *facts).alias("line"), state.alias("state"))
    lost = findings.join(report.select("segment"), "segment", "left_anti").select("segment").distinct()
    none = lost.select(F.lit(1).alias("part"), F.lit("").alias("instance"), F.lit(0).cast("long").alias("place"), "segment", F.col("segment").alias("name"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("segment "), X.shown(F.col("segment")), F.lit(" BROKEN unreadable")).alias("line"), F.lit("BROKEN").alias("state"))
    tops = head.unionByName(none)
    nth = F.row_number().over(W.partitionBy("segment").orderBy("kind", "a", "b", "c", "x", "y")).cast("long")
    below = findings.select("segment", nth.alias("ord"), F.concat(F.lit("  "), X.shown(said(F.col("kind")))).alias("line")).join(tops.select("part", "instance", "place", "segment", "name"), "segment")
    total = tops.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "BROKEN").alias("b"))
    last = total.select(F.lit(2).alias("part"), F.lit("").alias("instance"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("ord"), F.format_string("verified %d segment(s), %d broken", "n", "b").alias("line"))
    order = ["part", "instance", "place", "segment", "ord"]
    return tops.drop("state").unionByName(below.select(*order, "name", "line")).unionByName(last).orderBy(*order).select(F.col("name").alias("segment"), "ord", "line")
