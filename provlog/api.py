"""The addressable operations as functions that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlog import config as C
from provlog.functions import text as X
from provlog.operators import triples
from provlog.operators import verify as V
from provlog.operators.writer import Cadence, deliver, tails, write_lines
from provlog.sources import cache, segments
from provlog.sources.tables import written
from provlog.vocabulary import LOG, Vocabulary

# Columns that only the writer states.
RESERVED = ["seq", "principal", "worker", "span", "parent", "dur", "cap", "credential"]


def given(**arguments: str | None) -> None:
    """An argument that is stated but blank is an error, never left out."""
    for name, value in arguments.items():
        if value is not None and not value.strip():
            raise ValueError(f"{name}: blank")


def list_segments(spark: SparkSession, directory: str) -> DataFrame:
    return segments.listing(segments.read(spark, directory))


def exists(spark: SparkSession, directory: str, name: str) -> bool:
    return segments.exists(segments.read(spark, directory), name)


def segment(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """(segment, line_no, line) of one segment, found by its header and never by its file's name; of several files the first by path."""
    given(name=name)
    files = segments.read(spark, directory)
    found = segments.catalog(files).where((F.col("segment") == name) & F.col("error").isNull()).select("file").orderBy("file").limit(1)
    text = files.join(found, "file", "left_semi").select(F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("at", "line"))
    return text.select(F.lit(name).alias("segment"), (F.col("at") + 1).cast("long").alias("line_no"), "line")


def chosen(headers: DataFrame, lines: DataFrame, instance: str | None, segment: str | None) -> tuple[DataFrame, DataFrame]:
    """Those of one instance, or of the whole chain that holds a segment; unreadable files belong to no chain."""
    if instance is None and segment is None:
        return headers, lines
    if segment is not None:
        of = headers.where(F.col("name") == segment).select("instance").distinct()
        headers = headers.join(of, "instance", "left_semi")
    if instance is not None:
        headers = headers.where(F.col("instance") == instance)
    return headers, lines.join(headers.select("segment"), "segment", "left_semi")


def verify(
    spark: SparkSession, directory: str, instance: str | None = None, vocabulary: Vocabulary | None = None, segment: str | None = None, limit: int | None = None, budget: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of a folder, of one instance's chain, or of the chain that holds a segment; each with the file.

    Each file is verified by itself, whatever name it states.  Unreadable files have findings under their path.  limit and budget: bytes of a file, and of all files of the folder,
    whatever is chosen of them.
    """
    given(instance=instance, segment=segment)
    files = segments.read(spark, directory, limit, budget)
    headers, lines = segments.opened(files, by_file=True)
    headers, lines = chosen(written(headers, "headers"), lines, instance, segment)  # headers are parsed once, whatever asks for them
    report, found = V.verify(headers, lines, vocabulary or Vocabulary.built_in())
    names = headers.select(F.col("segment").alias("file"), "name")
    return report.withColumnsRenamed({"segment": "file", "name": "segment"}), found.withColumnRenamed("segment", "file").join(names, "file").withColumnRenamed("name", "segment")


def read_entries(lines: DataFrame, headers: DataFrame, since: str | None = None, until: str | None = None, first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, seals, unreadable lines) of segments.

    Times bound what starts with a digit by its first 24 characters, both ends in, before it is parsed; what they leave out
    can't be unreadable, and still counts in the ordinals.  first and last bound the sequence numbers, stated or counted.
    """
    at = F.substring("raw", 1, 24)
    inside = (F.lit(True) if since is None else at >= since) & (F.lit(True) if until is None else at <= until)
    judged = F.col("raw").rlike("^[0-9]") & (F.length("raw") >= 24)
    kept = triples.ordinals(lines).where(inside | ~judged)
    p = X.once(kept, "e", F.when(F.col("kind") == "entry", X.parse_entry(F.col("raw"), F.col("prefixes"))))
    p = X.once(p, "seal", F.when(F.col("kind") == "seal", X.parse_seal(F.col("raw"))))
    e = p.where("kind = 'entry'").where(X.is_entry(F.col("raw"), F.col("e"))).select("segment", "line_no", "ordinal", "e.*")
    seq = F.coalesce(X.stated_sequence(F.col("fields")), F.col("ordinal").cast("decimal(20,0)"))
    e = e.where((F.lit(True) if first is None else seq >= first) & (F.lit(True) if last is None else seq <= last))
    e = e.join(headers.select("segment", "instance"), "segment")
    seals = p.where("kind = 'seal'").where(X.is_seal(F.col("raw"), F.col("seal"))).select("segment", "seal.*")
    return e, seals, triples.unreadable(p)


def transrept(
    spark: SparkSession, directory: str, graphs: list[str] | None = None, since: str | None = None, until: str | None = None, vocabulary: Vocabulary | None = None,
    first: int | None = None, last: int | None = None, ordered: bool = False, strict: bool = True,
) -> DataFrame:
    """Triples of a folder's segments.  strict: a line that can't be read is an error; else the segment that holds it is left out."""
    given(since=since, until=until)
    v = vocabulary or Vocabulary.built_in()
    headers, lines = segments.opened(segments.read(spark, directory), by_file=True)
    headers = written(headers.where("error is null"), "headers")  # parsed once
    one = headers.groupBy("name").agg(F.min("segment").alias("segment"))  # of files that state one name the first by path
    headers = headers.join(one.select("segment"), "segment", "left_semi")
    lines = lines.join(one, "segment").drop("segment").withColumnRenamed("name", "segment")
    headers = headers.drop("segment").withColumnRenamed("name", "segment")
    if graphs is not None:
        headers, lines = headers.where(F.col("segment").isin(graphs)), lines.where(F.col("segment").isin(graphs))
    e, seals, wrong = read_entries(lines, headers, since, until, first, last)
    if strict:
        for r in wrong.orderBy("segment", "line_no").head(1):
            raise ValueError(f"{r['segment']}, line {r['line_no']}: {r['error']}")
    else:
        lost = wrong.select("segment").distinct()
        headers, e, seals = (x.join(lost, "segment", "left_anti") for x in (headers, e, seals))
    named = headers.withColumn("level", F.regexp_replace("level", f"^{LOG}", ""))
    return triples.all_triples(named, e, seals, v, ordered)


def finished(report: DataFrame) -> DataFrame:
    """The segments whose record is complete: only what is read of these may be kept and used again."""
    return report.where("finished").select("segment")


def kept(triples_of: DataFrame, report: DataFrame, name: str) -> DataFrame:
    """Triples of finished segments as a table that can be read again; those of others are worked out anew each time."""
    done = finished(report).withColumnRenamed("segment", "graph")
    return written(triples_of.join(done, "graph", "left_semi"), name).unionByName(triples_of.join(done, "graph", "left_anti"))


def cached(
    spark: SparkSession, directory: str, store: str, since: str | None = None, until: str | None = None, vocabulary: Vocabulary | None = None, ordered: bool = False
) -> DataFrame:
    """What :func:`transrept` gives, from a store of finished segments: their files are read once and never again."""
    given(since=since, until=until)
    v = vocabulary or Vocabulary.built_in()
    return triples.all_triples(*cache.tables(spark, directory, store, v, since, until), v, ordered, parsed=True)


def checked(requests: DataFrame, classes: DataFrame) -> DataFrame:
    """requests (class, subject, fields) with error: what a caller may not write."""
    always = classes.where("least_rank = -1").select("class", F.lit(True).alias("always"))
    r = requests.join(F.broadcast(always), "class", "left")  # as large as the vocabulary
    error = (
        F.when(F.col("always"), "class is the writer's own")
        .when(~X.is_writable_iri(F.col("subject")), "subject is no IRI")
        .when(F.exists("fields", lambda f: f["key"].isin(RESERVED)), "reserved key")
        .when(F.exists("fields", lambda f: ~X.is_key(f["key"])), "no key")
    )
    return r.withColumn("error", error).drop("always")


def requested(requests: DataFrame, prefix: str = "log") -> DataFrame:
    """Requests (instance, ms, class, subject, msg, fields; the last four may be null) as entries that :func:`write_entries` takes.

    Without a class an entry is a message, without a subject it is about the instance; msg becomes a field, before the others.
    """
    class_ = F.coalesce("class", F.lit(LOG + "Message"))
    own = F.when(F.col("msg").isNotNull(), F.array(F.struct(F.lit("msg").alias("key"), F.col("msg").alias("value"))))
    none = F.array().cast("array<struct<key: string, value: string>>")
    curie = F.when(class_.startswith(LOG), F.concat(F.lit(prefix + ":"), F.substring(class_, F.lit(len(LOG) + 1), F.length(class_)))).otherwise(F.concat(F.lit("<"), class_, F.lit(">")))
    r = requests.withColumns({"class": class_, "subject": F.coalesce("subject", "instance"), "fields": F.concat(F.coalesce(own, none), F.coalesce("fields", none)), "time": X.time_string(F.col("ms")), "curie": curie})
    return r.withColumn("tail", X.render_fields(F.col("fields")))


def denials(refusals: DataFrame, prefix: str = "log") -> DataFrame:
    """Refusals (instance, ms, capability, action, principal; the last may be null) as entries that :func:`write_entries` takes.

    A refused caller can't log its own refusal, so these are the log's, at every level: about the segment in which each lands, with
    the principal if it is known, what was lacking and what was asked for.  Other columns stay, to order by.
    """
    field = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
    fields = F.filter(F.array(field("principal", "principal"), field("denied", "capability"), field("reason", "action")), lambda f: f["value"].isNotNull())
    return refusals.withColumns({
        "time": X.time_string(F.col("ms")), "class": F.lit(LOG + "CapabilityDenied"), "curie": F.lit(prefix + ":CapabilityDenied"),
        "subject": F.lit(None).cast("string"), "fields": fields, "tail": X.render_fields(fields),
    })


def write_entries(
    entries: DataFrame, cadence: Cadence | None = None, order: list[str] | None = None, level: str = "info", classes: DataFrame | None = None,
    config: C.Config | None = None, predecessors: DataFrame | None = None, sink: Callable | None = None,
) -> DataFrame:
    """Lines of segments for entries (instance, time, ms, class, curie, subject, tail) that the level lets through.

    config: its level and cadences hold, and the lines are written to its destination.
    """
    v = Vocabulary.built_in()
    if config is not None:
        level = config.level
        cadence = cadence or Cadence(config.seal["entries"], config.seal["millis"], config.rotation["entries"], config.rotation["millis"])
    table = classes if classes is not None else v.class_table(entries.sparkSession)
    cadence = cadence or Cadence()
    found = entries.join(F.broadcast(table.select("class", "least_rank")), "class", "left")
    emits = F.coalesce(F.col("least_rank") <= v.ranks[LOG + level], F.lit(True))
    # The time of an entry that the level leaves out can still make a rotation due.
    found = found.where(emits) if cadence.max_millis is None else found.withColumns({c: F.when(emits, F.col(c)) for c in ("curie", "subject", "tail")})
    lines = write_lines(found, cadence, order or ["ms"], level, predecessors=predecessors)
    if config is None and sink is None:
        return lines
    lines = written(lines, "lines")  # delivered and returned, but made once
    deliver(lines, "sink" if sink is not None else config.destination, config.directory if config else None, sink)
    return lines


def resumed(spark: SparkSession, directory: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The chains of a folder that a restarted writer goes on from: instance, name, level, head, started."""
    headers, lines = segments.opened(segments.read(spark, directory))
    return tails(headers.where("error is null"), V.reported(lines, headers, vocabulary or Vocabulary.built_in()))


def config(spark: SparkSession, directory: str, app: str | None = None, face: str = "graph", segment: tuple[str, str] | None = None) -> DataFrame | str:
    """The effective configuration as a graph, or as the text of a file (face='toml')."""
    c = C.load(directory, app)
    if face == "toml":
        return C.to_toml(c)
    if face != "graph":
        raise ValueError(f"face: graph or toml, not {face!r}")
    return C.graph(spark, c, segment=segment)


def write_config(spark: SparkSession, directory: str, stated: dict, app: str | None = None) -> DataFrame:
    """State keys in a folder's topmost layer; (class, fields) of the entries that note what changed."""
    rows = [(LOG + c, f) for c, f in C.write_layer(directory, stated, app)[1]]
    return spark.createDataFrame(rows, "class string, fields array<struct<key: string, value: string>>")
