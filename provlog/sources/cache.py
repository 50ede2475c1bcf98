"""Finished segments kept as tables: what was parsed once is read again as columns, by its content's hash.

A segment whose record is complete never changes, so its header, entries and seals can be kept.  A store is a folder of three
tables, each row with the hash of the file's content and the batch that wrote it, and an index of files, which is written last: rows of
a batch that the index doesn't name are never seen, so a call that died half-way leaves nothing behind that counts.  Entries are laid
out by ranges of time and sorted by instance, so a time window prunes files, and their number doesn't grow with the instances.  Open segments are read anew each time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators import triples, verify
from provlog.sources import segments
from provlog.sources.tables import written
from provlog.vocabulary import LOG, Vocabulary

INDEX = "file string, bytes long, modified timestamp, content string, batch string, finished boolean"
KEYS = ["file", "bytes", "modified"]
#: By what rows of a store belong to what its index says of a file.
KEPT = ["file", "batch"]
#: Files that are read by their paths where Arrow doesn't reach them; where there are more, the folder is read and the others are left out.
PATHS = 1000
Tables = tuple[DataFrame, DataFrame, DataFrame]


def read_files(spark: SparkSession, directory: str, wanted: DataFrame) -> DataFrame | None:
    """What :func:`segments.read` gives of some files (file, bytes, modified) of a folder; None where there is none."""
    if wanted.isEmpty():
        return None
    read = segments.read_listed(spark, directory, wanted)
    if read is not None:
        return read
    paths = [r["file"] for r in wanted.select("file").head(PATHS + 1)]
    if len(paths) > PATHS:
        return segments.read(spark, directory).join(wanted.select("file"), "file", "left_semi")
    return segments.read(spark, paths)


def index(spark: SparkSession, store: str) -> DataFrame:
    """The files that a store knows; none where there is no store yet."""
    try:
        return spark.read.schema(INDEX).parquet(f"{store}/index")
    except AnalysisException:
        return spark.createDataFrame([], INDEX)


def parsed(headers: DataFrame, lines: DataFrame, v: Vocabulary) -> tuple[Tables, DataFrame]:
    """((headers, entries, seals), unreadable lines) of files, each with file, where segment is the key of both tables and a path.

    Entries have their ordinals, whatever a window leaves out later.
    """
    name = headers.where("error is null").select("segment", "name", "instance", "file")
    p = triples.ordinals(lines).withColumns({"e": F.when(F.col("kind") == "entry", X.parse_entry(F.col("raw"), F.col("prefixes"))), "seal": F.when(F.col("kind") == "seal", X.parse_seal(F.col("raw")))})
    p = written(p.select("segment", "line_no", "raw", "kind", "ordinal", "e", "seal"), "parsed")
    e = p.where("kind = 'entry'").where(X.is_entry(F.col("raw"), F.col("e"))).join(name, "segment").select("file", F.col("name").alias("segment"), "instance", "line_no", "ordinal", "e.*")
    s = p.where("kind = 'seal'").where(X.is_seal(F.col("raw"), F.col("seal"))).join(name, "segment").select("file", F.col("name").alias("segment"), "seal.*")
    level = F.regexp_replace("level", f"^{LOG}", "")
    h = headers.where("error is null").select("file", F.col("name").alias("segment"), "instance", level.alias("level"), "started", "prev")
    return (h, e, s), triples.unreadable(p)


def remember(spark: SparkSession, directory: str, store: str, v: Vocabulary) -> DataFrame:
    """Add to a store what it doesn't know of a folder; (file, bytes, modified, content, batch, finished) of the folder's readable files."""
    now = segments.manifest(spark, directory)
    fresh = written(now.join(index(spark, store), KEYS, "left_anti"), "fresh")
    read = read_files(spark, directory, fresh)
    if read is not None:
        after = segments.manifest(spark, directory).join(fresh, "file", "left_semi")
        files = written(segments.settled(fresh, read, after), "files")
        headers, lines = segments.opened(files, by_file=True)
        headers = written(headers, "headers")
        tables, wrong = parsed(headers, lines, v)
        whole = verify.reported(lines, headers, v).where("finished").select(F.col("segment").alias("file"))
        done = written(whole.join(wrong.select(F.col("segment").alias("file")), "file", "left_anti"), "finished")
        batch, kept = uuid.uuid4().hex, files.join(done, "file", "left_semi").select("file", F.col("hash").alias("content"))
        for part, table in zip(("headers", "entries", "seals"), tables):
            own = table.join(kept, "file").withColumn("batch", F.lit(batch))
            if part == "entries":
                own.repartitionByRange("time").sortWithinPartitions("instance", "time").write.mode("append").parquet(f"{store}/{part}")
            else:
                own.write.mode("append").parquet(f"{store}/{part}")
        state = files.where("hash is not null").join(done.withColumn("done", F.lit(True)), "file", "left")
        state.select(*KEYS, F.col("hash").alias("content"), F.lit(batch).alias("batch"), F.coalesce("done", F.lit(False)).alias("finished")).write.mode("append").parquet(f"{store}/index")
    return written(now.join(index(spark, store), KEYS), "known")


def tables(spark: SparkSession, directory: str, store: str, v: Vocabulary, since: str | None = None, until: str | None = None) -> Tables:
    """(headers, entries, seals) of a folder's segments: finished ones from the store, open ones from their files.

    since, until: bounds of entries' times, both ends in.  Of files that state one name the first by path counts.  An
    open file with a line that can't be read is an error.
    """
    known = remember(spark, directory, store, v)
    kept = known.where("finished").select("file", "batch")
    stored = [spark.read.parquet(f"{store}/{part}").drop("content") if not kept.isEmpty() else None for part in ("headers", "entries", "seals")]
    open_ = read_files(spark, directory, known.where("not finished"))
    fresh = None
    if open_ is not None:
        headers, lines = segments.opened(open_, by_file=True)
        fresh, wrong = parsed(written(headers, "headers"), lines, v)
        for r in wrong.orderBy("segment", "line_no").head(1):
            raise ValueError(f"{r['segment']}, line {r['line_no']}: {r['error']}")
    if fresh is None and stored[0] is None:
        raise ValueError(f"{directory}: no segment")
    inside = F.col("time").between(since if since is not None else "", until if until is not None else "￿")
    if since is not None or until is not None:
        stored[1] = stored[1].where(inside) if stored[1] is not None else None
        fresh = (fresh[0], fresh[1].where(inside), fresh[2]) if fresh is not None else None
    named = [t.select("segment", "file") for t in (stored[0].join(kept, KEPT) if stored[0] is not None else None, fresh[0] if fresh is not None else None) if t is not None]
    first = written(reduce(DataFrame.unionByName, named).groupBy("segment").agg(F.min("file").alias("file")), "first").select("file")
    chosen = kept.join(first, "file", "left_semi")
    out = []
    for i, old in enumerate(stored):
        each = [old.join(chosen, KEPT, "left_semi").drop(*KEPT)] if old is not None else []
        each += [fresh[i].join(first, "file", "left_semi").drop("file")] if fresh is not None else []
        out.append(reduce(DataFrame.unionByName, each))
    return tuple(out)
