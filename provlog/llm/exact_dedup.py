"""Exact deduplication with a log-structured merge index of text digests (native).

Writing side: tasks deal their rows to ``RUNS`` memtables; each is flushed as one run of level
0: an entry ``(digest, smallest, largest, n)`` for each of its digests, sorted, with a filter, a
bitmap over hashes of its digests.  Spark's partial aggregation merges the copies of a hot
digest before the shuffle.  Compaction merges ``FAN`` runs into one of the next level until one
is left.  It reads the filters first: an entry whose digest no other run's filter knows moves
on as it is, and only the others are shuffled and merged, which keeps the smallest and the
largest identifier and the number of rows.

Reading side: the same kind of filter over the digests that the index holds more than once is
read before any text is shuffled.  Rows that it knows and that the index confirms are hits.
The text of each hit is compared, byte by byte, with the text of its group's representative.
A large group is dealt to parts of about ``PART`` rows, each with a copy of that text, and so
are the rows of hot digests when they meet the index.  Hits
whose bytes differ (a digest collision) are grouped by the bytes themselves.

A filter has ``BITS`` bits for an entry, up to ``FILTER`` bits in all (8 MB), which bounds what
is broadcast; with more entries it lets more through, and results stay the same.

A null text counts as empty.  A null identifier sorts below every other.  Rows that repeat
both identifier and text count as members of their group, and one of them stays; so do ties.
Texts of any length are read whole.  An empty table gives no rows.  Columns other than the two
named ones are carried as one struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlog.llm.common import ascii_lower, whole_text, written

Digest = Callable[[Column], Column]
#: Memtables, and runs that one compaction merges.
RUNS, FAN = 4, 2
#: Bits of a filter for each entry, and at most; bits of one bitmap.
BITS, FILTER, BITMAP = 16, 1 << 26, 1 << 15
#: Rows of a group that are compared with one copy of its text, about.
PART = 1000
#: A digest is hot if it holds one of this many parts of all rows, so there are no more hot ones than this.
HOT = 10_000


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def bodies(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """(id, body, digest) of each row; body is the normalised text."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), ascii_lower(whole_text(text_col)).alias("body"))
    return slim.withColumn("digest", digest(F.col("body")))


@dataclass
class Run:
    """entries: (digest, smallest, largest, n), digests distinct.  filter: (bucket, bitmap) over bits hashes of them."""

    entries: DataFrame
    filter: DataFrame
    bits: int


def place(bits: int) -> Column:
    """The bit of a digest."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def filtered(entries: DataFrame, bits: int) -> DataFrame:
    """The filter over the digests of entries: at most FILTER / BITMAP rows of 4 KB."""
    at = entries.select(place(bits).alias("at"))
    return at.groupBy(F.floor(F.col("at") / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bitmap"))


def known(rows: DataFrame, run: Run, name: str) -> DataFrame:
    """rows (with a digest) and whether the filter of a run knows the digest; never false where the run has it."""
    at = place(run.bits)
    bit = F.expr(f"shiftright(cast(conv(hex(substring(bitmap, cast(_at % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int))").bitwiseAND(F.lit(1)) == 1
    with_at = rows.withColumns({"_at": at, "bucket": F.floor(at / BITMAP)})
    return with_at.join(F.broadcast(run.filter), "bucket", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("bucket", "bitmap", "_at")


def bits_for(entries: int) -> int:
    return max(BITMAP, min(FILTER, -(-BITS * entries // BITMAP) * BITMAP))


def merged(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys, "digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> tuple[DataFrame, list[Run]]:
    """(entry (digest, id, sha) of each row, runs of level 0)."""
    rows = bodies(docs, id_col, text_col, digest).select("digest", "id", sha256(F.col("body")).alias("sha"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"))
    rows = written(rows, "entries")
    own = rows.select("run", "digest", F.col("id").alias("smallest"), F.col("id").alias("largest"), F.lit(1).cast("long").alias("n"))
    level = written(merged(own, "run").sortWithinPartitions("run", "digest"), "runs")
    sizes = {r["run"]: r["count"] for r in level.groupBy("run").count().collect()}  # RUNS rows
    runs = []
    for run, size in sorted(sizes.items()):
        entries, bits = level.where(F.col("run") == run).drop("run"), bits_for(size)
        runs.append(Run(entries, written(filtered(entries, bits), "filter"), bits))
    return rows.drop("run"), runs


def compact(runs: list[Run]) -> DataFrame:
    """The entries of all runs, merged level by level."""
    while len(runs) > 1:
        level = []
        for some in (runs[i : i + FAN] for i in range(0, len(runs), FAN)):
            if len(some) == 1:
                level += some
                continue
            parts = []
            for own in some:
                others = [r for r in some if r is not own]
                rows = reduce(lambda x, j: known(x, others[j], f"_known{j}"), range(len(others)), own.entries)
                maybe = reduce(Column.__or__, [F.col(f"_known{j}") for j in range(len(others))])
                parts.append(rows.select("digest", "smallest", "largest", "n", maybe.alias("maybe")))
            every = reduce(DataFrame.unionByName, parts)
            moved = every.where(~F.col("maybe")).drop("maybe").unionByName(merged(every.where("maybe").drop("maybe")))
            entries = written(moved.sortWithinPartitions("digest"), "compacted")
            bits = bits_for(entries.count()) if len(runs) > FAN else BITMAP
            level.append(Run(entries, written(filtered(entries, bits), "filter") if len(runs) > FAN else entries.limit(0), bits))
        runs = level
    return runs[0].entries


@dataclass
class Index:
    """rows: (digest, id, sha) of each document.  many: a run of the entries with several rows."""

    rows: DataFrame
    many: Run

    @staticmethod
    def of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> Index:
        rows, runs = flush(docs, id_col, text_col, digest)
        many = written(compact(runs).where("n > 1") if runs else rows.select("digest", F.col("id").alias("smallest"), F.col("id").alias("largest"), F.lit(1).cast("long").alias("n")), "many")
        bits = bits_for(many.count())
        return Index(rows, Run(many, written(filtered(many, bits), "filter"), bits))

    def maybe(self, rows: DataFrame) -> DataFrame:
        """rows with maybe: whether the filter knows their digest as one of several rows."""
        return known(rows, self.many, "maybe")


def dealt(rows: DataFrame, groups: DataFrame, all_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (digest, n and others) by digest; the rows of hot digests are dealt to parts of about PART rows by their id.

    Hot digests are broadcast: at most HOT rows of 40 bytes, whatever the size of the tables.
    """
    hot = groups.where(F.col("n") >= max(2, -(-all_rows // HOT))).select("digest", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), "parts").cast("int"), F.lit(0))).drop("parts")
    each = groups.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(each, ["digest", "salt"], how).drop("salt")


def verified_hits(docs: DataFrame, index: Index, keep: str, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """(id, digest, body, same): every row of a group of several, and whether its bytes are the representative's."""
    many = index.many.entries.select("digest", F.col(keep).alias("keep_id"), "n")
    hits = dealt(index.maybe(bodies(docs, id_col, text_col, digest)).where("maybe").drop("maybe"), many, index.rows.count())
    hits = written(hits.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).drop("n"), "hits")
    hits = hits.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    kept = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "parts").agg(F.min("body").alias("kept_body"))
    kept = kept.select("digest", "kept_body", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return hits.join(kept, ["digest", "part"]).select("id", "digest", "body", (F.col("body") == F.col("kept_body")).alias("same"))


def exact_groups(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256
) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, sha (binary, of the normalised text).

    keep: ``smallest`` or ``largest``, the identifier that stays of each group of equal texts.
    """
    index = Index.of(docs, id_col, text_col, digest)
    checked = verified_hits(docs, index, keep, id_col, text_col, digest)
    rows = index.maybe(index.rows)
    single = rows.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    groups = index.many.entries.select("digest", F.col(keep).alias("keep_id"), "n")
    entries = rows.where("maybe").groupBy("digest", "id", "sha").agg(F.count("*").alias("rows"))
    alone = [F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size")]
    found = dealt(entries, groups, index.rows.count(), "left").select("digest", "id", "sha", "rows", *alone)
    if not checked.where("not same").isEmpty():
        # Collisions: such digests are grouped again, by bytes.
        torn = checked.where("not same").select("digest").distinct()
        pick = F.min if keep == "smallest" else F.max
        again = checked.join(torn, "digest").groupBy("body").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
        again = again.select(sha256(F.col("body")).alias("sha"), "keep_id", "group_size")
        found = found.join(torn, "digest", "left_anti").unionByName(entries.join(torn, "digest", "left_semi").join(again, "sha").select(*found.columns))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return single.unionByName(each.select("id", "keep_id", "group_size", stays.alias("kept"), "sha"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    groups = written(exact_groups(docs, keep, id_col, text_col).where("group_size > 1"), "groups")
    lost = groups.where("not kept").select("id", "sha").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), sha256(ascii_lower(whole_text(text_col))).alias("sha"))
    # Never broadcast: what is lost grows with the documents.
    stay = rows.join(lost.hint("merge"), rows.id.eqNullSafe(lost.id) & (rows.sha == lost.sha), "left_anti").select("row.*")
    # Where a row repeats identifier and text, the join above takes all its copies; one comes back.
    repeated = groups.where("kept").select("id", "sha").join(lost.withColumnsRenamed({"id": "i", "sha": "s"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left_semi")
    if repeated.isEmpty():
        return stay
    back = rows.join(repeated, rows.id.eqNullSafe(repeated.id) & (rows.sha == repeated.sha), "left_semi")
    return stay.unionByName(back.dropDuplicates(["id", "sha"]).select("row.*"))
