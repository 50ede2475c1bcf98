"""Hash chains and seals over ordered lines.

A chain is sequential: segments are dealt to tasks, rows are sorted within them, and one pass
folds them while it holds only the chain's state, so a segment may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators.writer import tagged

#: Rows of a batch that a pass returns.
ROWS = 10_000


def advance(head: Column, line: Column) -> Column:
    return X.tagged_hash(F.concat(head, F.lit("\n"), line))


def fold(h0: Column, lines: Column) -> Column:
    """The chain's head after all lines."""
    return F.aggregate(lines, h0, advance)


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a segment in one task, in the order of the columns by."""
    return rows.repartition("segment").sortWithinPartitions("segment", *by)


def with_header(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(segment, kind, at, first, text) of lines, kind 1, and of headers, kind 0 and before all lines."""
    head = headers.select("segment", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("first"), F.col("h0").alias("text"))
    return head.unionByName(lines.select("segment", F.lit(1).alias("kind"), F.col("line_no").cast("long").alias("at"), F.lit(None).cast("long").alias("first"), F.col("line").alias("text")))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(part, ROWS).columns))


def batched(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) >= ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), kind)], schema=kind)
            held = []


def heads(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """segment, head and number of entries; lines: (segment, line_no, line), headers: (segment, h0)."""

    def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment = head = None
        n = 0
        for now, kind, text in chain(rows, [(None, 0, None)]):
            if kind == 0 or now != segment:
                if segment is not None and n and head is not None:
                    yield segment, head, n
                segment, head, n = now, text if kind == 0 else None, 0
            if kind:
                head, n = tagged(head + "\n" + text) if head is not None else None, n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(folded(rows_of(batches)), pa.schema([("segment", pa.string()), ("head", pa.string()), ("entries", pa.int64())]))

    return in_order(with_header(lines, headers), "kind", "at").select("segment", "kind", "text").mapInArrow(run, "segment string, head string, entries long")


def seal_points(entries: DataFrame, every: int, millis: int) -> DataFrame:
    """segment, first, last of each seal that the cadence sets; what is left at the end stays unsealed.

    entries: (segment, line_no, ms).  A seal is due after ``every`` entries or ``millis`` since the last one (at first: since the first entry).
    """

    def points(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment, at, sealed, since = None, 0, 0, 0
        for now, ms in rows:
            if now != segment:
                segment, at, sealed, since = now, 0, 0, ms
            at += 1
            if at - sealed >= every or max(ms - since, 0) >= millis:
                yield segment, sealed + 1, at
                sealed, since = at, ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(points(rows_of(batches)), pa.schema([("segment", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    slim = entries.select("segment", "line_no", F.col("ms").cast("long").alias("ms"))
    return in_order(slim, "line_no", "ms").select("segment", "ms").mapInArrow(run, "segment string, first long, last long")


def sealed(lines: DataFrame, headers: DataFrame, points: DataFrame) -> DataFrame:
    """segment, first, last, hash: the chain's head after the last-th line of the segment, or after all where there are fewer."""
    place = points.select("segment", F.lit(2).alias("kind"), F.col("last").cast("long").alias("at"), F.col("first").cast("long").alias("first"), F.lit(None).cast("string").alias("text"))
    numbered = lines.select("segment", F.row_number().over(W.partitionBy("segment").orderBy("line_no", "line")).cast("long").alias("line_no"), "line")
    rows = with_header(numbered, headers).unionByName(place).withColumn("at", F.coalesce("at", F.lit(0).cast("long")))

    def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment = head = None
        for now, kind, at, first, text in rows:
            if kind == 0 or now != segment:
                segment, head = now, text if kind == 0 else None
            if head is None:
                continue
            if kind == 1:
                head = tagged(head + "\n" + text)
            elif kind == 2:
                yield segment, first, at, head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(folded(rows_of(batches)), pa.schema([("segment", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("hash", pa.string())]))

    return in_order(rows, "at", "kind").select("segment", "kind", "at", "first", "text").mapInArrow(run, "segment string, first long, last long, hash string")


def signed(seals: DataFrame, open_key: Callable[[], Callable[[str], str | None]], hash_col: str = "hash") -> DataFrame:
    """seals with signature: what a key says of each hash, null where it refuses.

    Seals are signed behind the chain, which never holds a signature: in batches, wherever they are.  open_key opens the key, once
    for a task, and returns what signs a hash as 'algorithm:value'.
    """

    @F.pandas_udf("string")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = open_key()
        for hashes in batches:
            yield pd.Series([None if h is None else key(h) for h in hashes], dtype=object)

    return seals.withColumn("signature", sign(F.col(hash_col)))


def seal_line(first: Column, last: Column, hash_: Column, signature: Column) -> Column:
    base = F.concat(F.lit("#seal "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" "), hash_)
    return F.concat(base, F.coalesce(F.concat(F.lit(" "), signature), F.lit("")))
