"""Segments from text files: whole-file reads, headers, lines, and files that can't be read.

Files are those of a folder that end in ``.log``, and the part files that
:func:`provlog.operators.writer.write_files` leaves in a folder for each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.sources import ranges
from provlog.sources.tables import written as cut
from provlog.vocabulary import MAGIC

#: Characters of a file that listing a folder reads; a header that doesn't end within them is read from the whole text.
PROBE = 8192
#: Bytes that a segment may have, and all files of a folder together, where a caller asks for the bounds.
SEGMENT_LIMIT, FOLDER_LIMIT = 16 << 20, 64 << 20
VERSION = MAGIC.rstrip("0123456789")
DIRECTIVES = ("name", "instance", "level", "started", "prev")
#: White space within a line, as members of a Java regex class.
BLANK = X.WS.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")


def header_end(text: Column) -> Column:
    """The place of the line break before the first blank line, or 0 where no line is blank."""
    return F.regexp_instr(text, F.lit(rf"(?:\A|\n)[{BLANK}]*(?:\n|\z)"))


def header_text(text: Column) -> Column:
    """What stands before the first blank line."""
    return X.bound(text, lambda t: X.bound(header_end(t), lambda at: F.when(at == 0, t).otherwise(F.substring(t, F.lit(1), at - 1))))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{X.WS}]+|[{X.WS}]+\z", "")


def last_bound(pairs: Column) -> Column:
    """A map of prefixes; the last binding of each counts."""
    once = F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs)
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.when(once, pairs).otherwise(kept))


def parse_header(text: Column) -> Column:
    """A struct of the header up to the first blank line, or the end.

    The last of repeated directives counts; comments may stand anywhere.  error says why it can't be
    used: no version line or another version, a line or directive that doesn't belong, a value
    that can't be, or a directive that is missing.  lines: how many lines it has.
    """

    def line(raw: Column, at: Column) -> Column:
        s = F.regexp_replace(raw, r"[\r\n]+\z", "")
        name = F.regexp_extract(s, rf"^@([^{X.WS}]*)", 1)
        kind = F.when(s.startswith(VERSION), "version").when(s.startswith("#") & ~s.startswith("#seal"), "comment").when(s.startswith("@"), name).otherwise("")
        value = F.when(s.startswith(VERSION), trimmed(F.substring(s, len(VERSION) + 1, 1 << 30))).otherwise(trimmed(F.substring(s, F.length(name) + F.lit(2), F.length(s))))
        return F.struct(kind.alias("kind"), value.alias("value"), at.alias("at"))

    def pair(x: Column) -> Column:
        parts = F.regexp_extract_all(x["value"], F.lit(rf"[^{X.WS}]+"), F.lit(0))
        return F.struct(F.regexp_replace(F.coalesce(F.get(parts, 0), F.lit("")), ":+$", "").alias("key"), F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), "^<+|>+$", "").alias("value"), x["at"].alias("at"))

    def header(lines: Column) -> Column:
        return X.bound(F.transform(F.filter(lines, lambda x: x["kind"] == "prefix"), pair), lambda pairs: directives(lines, pairs))

    def directives(lines: Column, pairs: Column) -> Column:
        last = lambda d: F.try_element_at(F.filter(lines, lambda x: x["kind"] == d), F.lit(-1))
        value = lambda d: last(d)["value"]
        plain = lambda some: last_bound(F.transform(some, lambda p: F.struct(p["key"], p["value"])))
        level = lambda x: X.bound(F.struct(x["value"].alias("v"), plain(F.filter(pairs, lambda p: p["at"] < x["at"])).alias("p")), lambda s: X.expand(s["v"], s["p"]))
        wrong = lambda x: (
            F.when(x["kind"] == "version", F.when(~x["value"].rlike(r"^\+?[0-9]{1,9}$"), "version"))
            .when(x["kind"].isin("name", "instance"), F.when(~X.is_iri(x["value"]), F.concat(x["kind"], F.lit(" is no IRI"))))
            .when(x["kind"] == "started", F.when(~X.is_time(x["value"]), "started is no time"))
            .when(x["kind"] == "prev", F.when(x["value"] == "", "empty prev"))
            .when(x["kind"] == "level", F.when(level(x).isNull() | ~F.coalesce(X.is_iri(level(x)), F.lit(False)), "level is no IRI"))
            .when(x["kind"].isin("comment", "prefix"), None)
            .when(x["kind"] == "", "not a header line")
            .otherwise("unknown directive")
        )
        line_error = F.get(F.filter(F.transform(lines, wrong), lambda e: e.isNotNull()), 0)
        pair_error = F.when(F.exists(pairs, lambda p: (p["key"] == "") | (p["value"] == "")), "prefix")
        version = value("version").try_cast("int")
        missing = F.get(F.filter(F.array(*[F.when(last(d).isNull(), d) for d in DIRECTIVES]), lambda d: d.isNotNull()), 0)
        error = F.coalesce(line_error, pair_error, F.when(F.coalesce(version != 1, F.lit(True)), "version"), F.concat(F.lit("missing "), missing))
        return F.struct(
            version.alias("version"), plain(pairs).alias("prefixes"), value("name").alias("name"), value("instance").alias("instance"), level(last("level")).alias("level"),
            value("started").alias("started"), value("prev").alias("prev"), error.alias("error"), F.size(lines).cast("long").alias("lines"),
        )

    lines = F.transform(F.filter(F.split(header_text(text), "\n"), lambda s: s != ""), line)
    return F.when(text.isNotNull(), X.bound(lines, header))


def read(spark: SparkSession, directory: str, limit: int | None = None, budget: int | None = None) -> DataFrame:
    """file, bytes, modified, text, error of each segment's file; files beyond limit bytes or not UTF-8 have an error and no text.

    budget: all files of the folder together may have so many bytes; where they have more, nothing is read.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "{*.log,part-*.txt}").option("recursiveFileLookup", True).load(directory)
    if budget is not None and (raw.agg(F.sum("length")).first()[0] or 0) > budget:
        raise ValueError(f"over budget: {directory} has more than {budget} bytes")
    size = F.lit(False) if limit is None else F.col("length") > limit
    return decoded(raw, size)


def decoded(raw: DataFrame, size: Column) -> DataFrame:
    """What :func:`read` gives of files (path, modificationTime, length, content); size: whether one is too large."""
    error = F.when(size, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    return raw.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), error.alias("error"), F.when(error.isNull(), F.col("content").cast("string")).alias("text"))


def probed(text: Column) -> Column:
    """The beginning of a text if a header ends in it, else the text."""
    head = F.substring(text, 1, PROBE)
    return F.when(F.regexp_instr(head, F.lit(rf"\n[{BLANK}]*\n")) > 0, head).otherwise(text)


def catalog(files: DataFrame) -> DataFrame:
    """One row for each file with its header; error tells why a file can't be used."""
    h = X.once(files, "h", parse_header(probed(F.col("text"))))
    return h.select("file", "bytes", F.coalesce("error", "h.error").alias("error"), F.col("h.name").alias("segment"), "h.instance", "h.level", "h.started", "h.prev", "h.prefixes", "h.version")


def damaged(files: DataFrame) -> DataFrame:
    """Files that can't be read, and why, by path."""
    return catalog(files).where("error is not null").select("file", "error").orderBy("file")


def listing(files: DataFrame) -> DataFrame:
    """Readable segments by name."""
    return catalog(files).where("error is null").orderBy("segment")


def canonical_hash(h: Column) -> Column:
    """The hash of a header as it would be written."""
    from provlog.sources.derived import header_text as rendered

    return X.tagged_hash(rendered(MAGIC, h["prefixes"], h["name"], h["instance"], X.shorten(h["level"], h["prefixes"]), h["started"], h["prev"]))


def opened(files: DataFrame, by_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of files.

    headers: segment, name, file, instance, level, started, prev, prefixes, error, h0, head_lines; a file that can't be
    read has its path as segment, and an error.  lines: segment, line_no (from 1, of the file), raw, kind, prefixes, of
    the others.  Files are read whole, so nothing is shuffled.  by_file: the path is the segment of readable files too, so that
    files that state one name, as copies do, are told apart.
    """
    each = X.once(files, "h", parse_header(F.col("text"))).withColumn("why", F.coalesce("error", "h.error"))
    key = F.col("file") if by_file else F.col("h.name")
    name = F.when(F.col("why").isNull(), F.col("h.name")).otherwise(F.col("file"))
    headers = each.select(
        F.when(F.col("why").isNull(), key).otherwise(F.col("file")).alias("segment"), name.alias("name"), "file", "h.instance", "h.level", "h.started", "h.prev", "h.prefixes", F.col("why").alias("error"),
        F.when(F.col("why").isNull(), canonical_hash(F.col("h"))).alias("h0"), F.col("h.lines").alias("head_lines"),
    )
    rows = each.where("why is null").select(key.alias("segment"), F.col("h.prefixes").alias("prefixes"), F.col("h.lines").alias("head"), F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("at", "raw"))
    return headers, body(rows.select("segment", "prefixes", "head", (F.col("at") + 1).cast("long").alias("line_no"), "raw"))


def body(rows: DataFrame) -> DataFrame:
    """segment, line_no, raw, kind, prefixes of the lines after the header; rows: the same with head, the header's lines."""
    rows = rows.where("line_no > head").withColumn("raw", F.when(F.col("raw").endswith("\r"), F.regexp_replace("raw", r"\r+\z", "")).otherwise(F.col("raw")))
    return rows.select("segment", "line_no", "raw", X.line_kind(F.col("raw")).alias("kind"), "prefixes")


def lines(files: DataFrame) -> DataFrame:
    """The lines of :func:`opened`."""
    return opened(files)[1]


def of_lines(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of segments given as rows (segment, line_no, line): h0 is the hash of the canonical header.

    headers: segment, instance, level, started, prev, prefixes, error, h0, head_lines.  lines: segment, line_no, raw, kind, prefixes.
    A header ends at the segment's first blank line, wherever that is.
    """
    order = W.partitionBy("segment").orderBy("line_no")
    blank = F.col("line").rlike(rf"^[{X.WS}]*\z")
    past = F.coalesce(F.sum(blank.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # Only lines down to the lowest place at which a header ends are brought together: with headers of a few lines, few of all.
    ends = written.groupBy("segment").agg(F.coalesce(F.min(F.when(blank, F.col("line_no"))), F.max("line_no")).alias("end"))
    lowest = ends.agg(F.max("end")).first()[0]
    top = written.where(F.col("line_no") <= F.lit(lowest)).select("segment", "line_no", "line").withColumn("past", past).where("past = 0")
    texts = F.array_sort(F.collect_list(F.when(~blank, F.struct("line_no", "line"))))
    h = top.groupBy("segment").agg(F.transform(texts, lambda x: x["line"]).alias("texts"), F.min(F.when(blank, F.col("line_no"))).alias("stop"))
    h = X.once(h, "h", parse_header(F.array_join("texts", "\n")))
    good = F.col("h.error").isNull()
    h0 = F.when(good, canonical_hash(F.col("h"))).alias("h0")
    h = cut(h.select("segment", "h.instance", "h.level", "h.started", "h.prev", "h.prefixes", "h.error", h0, F.col("h.lines").alias("head_lines"), "stop"), "headers")
    # Lines meet their headers in the exchange that brings together a segment; what is made of the lines comes after it.
    known = h.where("error is null and stop is not null").select("segment", "prefixes", F.col("head_lines").alias("head"), "stop").hint("shuffle_hash")
    rows = written.select("segment", "line_no", F.col("line").alias("raw")).join(known, "segment").where("line_no > stop")
    return h.drop("stop"), body(rows.select("segment", "prefixes", "head", "line_no", "raw"))


def exists(files: DataFrame, name: str) -> bool:
    """Whether a readable segment has that name, by its header and never by its file's name."""
    return bool(catalog(files).where((F.col("segment") == name) & F.col("error").isNull()).head(1))


def conflicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (file, bytes, modified) that were there and have changed, or gone: what was read of them can't be trusted."""
    now = after.select("file", F.col("bytes").alias("bytes_now"), F.col("modified").alias("modified_now"))
    each = before.select("file", "bytes", "modified").join(now, "file", "left")
    return each.where(~(F.col("bytes").eqNullSafe(F.col("bytes_now")) & F.col("modified").eqNullSafe(F.col("modified_now"))))


def manifest(spark: SparkSession, directory: str) -> DataFrame:
    """file, bytes, modified of a folder's segments, written down; contents aren't read.

    Folders are listed by tasks, a level at a time, so the driver holds no list of files; where Arrow doesn't know the file system, Spark lists them.
    """
    found = listed(spark, directory)
    if found is None:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "{*.log,part-*.txt}").option("recursiveFileLookup", True).load(directory)
        found = raw.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return cut(found.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))), "manifest")  # small rows, of many small files


def rooted(spark: SparkSession, directory: str) -> tuple[str, str] | None:
    """(what Spark calls a folder, the URI or path by which Arrow reaches it); None where Arrow doesn't, or where it is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    name = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    uri = name.removeprefix("file:") if name.startswith("file:") else name
    try:
        system, at = ranges.opened(uri)
        return (name, uri) if system.get_file_info(at).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def is_segment(name: str) -> bool:
    """Whether a file's name is a segment's: what Spark's filter {*.log,part-*.txt} takes of names that aren't hidden."""
    return not is_hidden(name) and (name.endswith(".log") or (name.startswith("part-") and name.endswith(".txt")))


def is_hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def listed(spark: SparkSession, directory: str) -> DataFrame | None:
    """file, bytes, modified of a folder's segments, each folder listed by a task; None where Arrow doesn't reach it."""
    root = rooted(spark, directory)
    if root is None:
        return None
    name, uri = root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = ranges.opened(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(top + folder))
                found = [f for f in found if not is_hidden(f.base_name) and (f.type == fs.FileType.Directory or (is_segment(f.base_name) and f.size))]  # Spark reads no empty files
                for i in range(0, len(found), ranges.ROWS):
                    some = found[i : i + ranges.ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{folder}/{f.base_name}" for f in some]), pa.array([f.type == fs.FileType.Directory for f in some]), pa.array([f.size for f in some], pa.int64()), pa.array([f.mtime_ns // 1_000_000 for f in some], pa.int64())],
                        ["at", "folder", "bytes", "ms"],
                    )

    parts, level = [], spark.createDataFrame([("",)], "at string")
    while True:
        found = cut(level.mapInArrow(run, "at string, folder boolean, bytes long, ms long"), "listed")
        parts.append(found.where("not folder"))
        folders = found.where("folder").select("at")
        if folders.isEmpty():
            break
        level = folders.repartition(4 * spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, parts).select(F.concat(F.lit(name), "at").alias("file"), "bytes", F.timestamp_millis("ms").alias("modified"))


#: Bytes of files that a task reads, and of a batch, about.
SHARE, BATCH = 64 << 20, 4 << 20


def read_listed(spark: SparkSession, directory: str, wanted: DataFrame) -> DataFrame | None:
    """What :func:`read` gives of the files that a manifest of a folder names, read by tasks by their names; None where Arrow doesn't reach it."""
    root = rooted(spark, directory)
    if root is None:
        return None
    name, uri = root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = ranges.opened(uri)
        kind = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for file, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(top + file[len(name) :]) as stream:
                    content = stream.read()
                rows.append((file, modified, len(content), content))
                held += len(content)
                if held > BATCH or len(rows) >= ranges.ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kind.types)], schema=kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kind.types)], schema=kind)

    size = wanted.agg(F.sum(F.col("bytes") + F.lit(ranges.OPENING))).first()[0] or 0  # one row
    shares = max(spark.sparkContext.defaultParallelism, size // SHARE)
    raw = wanted.select("file", "modified").repartition(int(shares)).mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")
    return decoded(raw, F.lit(False))


def settled(before: DataFrame, files: DataFrame, after: DataFrame) -> DataFrame:
    """files with hash, and with an error and no text where a file changed, came or went while it was read.

    before and after: what :func:`manifest` told of the folder before and after.  What was read must have as many bytes as both say.
    """
    tell = lambda m, x: m.select("file", F.col("bytes").alias(f"bytes_{x}"), F.col("modified").alias(f"modified_{x}"))
    each = files.withColumn("there", F.lit(True)).join(tell(before, "then"), "file", "full").join(tell(after, "now"), "file", "full")
    size = F.when(F.col("text").isNotNull(), F.octet_length("text")).otherwise(F.col("bytes"))
    same = F.col("there") & (size == F.col("bytes_then")) & (F.col("bytes_then") == F.col("bytes_now")) & (F.col("modified_then") == F.col("modified_now"))
    conflict = F.when(~F.coalesce(same, F.lit(False)), "changed while it was read")
    text = F.when(conflict.isNull(), F.col("text"))
    return each.select("file", F.coalesce("bytes", "bytes_then", "bytes_now").alias("bytes"), F.coalesce("modified", "modified_then", "modified_now").alias("modified"), F.coalesce(conflict, F.col("error")).alias("error"), text.alias("text"), X.tagged_hash(text).alias("hash"))


def read_pinned(spark: SparkSession, directory: str, limit: int | None = None, budget: int | None = None) -> DataFrame:
    """What :func:`read` gives, read once and written down, with hash: a file that changed meanwhile is an error and never half of each state."""
    before = manifest(spark, directory)
    files = cut(read(spark, directory, limit, budget), "pinned")
    return settled(before, files, manifest(spark, directory))


def bodies(files: DataFrame) -> DataFrame:
    """file, bytes, valid, hash of the content of each file."""
    return files.select("file", "bytes", F.col("text").isNotNull().alias("valid"), F.when(F.col("text").isNotNull(), X.tagged_hash(F.col("text"))).alias("hash"))
