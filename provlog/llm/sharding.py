"""Sharding by a two-pass external shuffle.

Pass 1 scatters records: identifier and shard count decide the shard (a jump consistent
hash, so that one more shard takes rows only into itself), and a seeded hash of identifier
and text deals each shard's records uniformly into buckets sized to fit memory.  Pass 2
brings each bucket to one task, puts it in a defined order and shuffles it by Fisher-Yates
with a generator seeded by the bucket.  A record's slot is its place in the shuffled bucket
plus the sizes of the shard's buckets before it.

A null text counts as no bytes; a null identifier is hashed as -1.  Rows that repeat an
identifier go to the same shard, each with its own slot.  Texts of any length count with all
their bytes.  An empty table gives no rows.  Other columns are carried as one struct, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlog.llm.common import written

SEED = 17
#: Bytes of text in a bucket, and in the buckets that share a task, about.
BUCKET, TASK = 4 << 20, 16 << 20
#: Slots of a shard in a file.
FILE = 100_000


def mixed(key: Column, shard: int, seed: int) -> Column:
    """A uniform number in 0 to 1 for a key and a shard."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11) / F.lit(float(1 << 53))


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The largest shard s whose draw falls below 1 / (s + 1): shard s + 1 takes its share from all before it."""
    out = F.lit(0)
    for s in range(1, shards):
        out = F.when(mixed(key, s, seed) < 1.0 / (s + 1), s).otherwise(out)
    return out.cast("int")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0 to n - 1."""
    order = np.arange(n)
    draws = (np.random.default_rng(seed).random(max(0, n - 1)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    for i, j in zip(range(n - 1, 0, -1), draws):
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET) -> DataFrame:
    """row (a struct of the document's columns), size, shard, slot."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1).cast("long"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    rows = docs.select(
        F.struct("*").alias("row"), key.alias("key"), size.alias("size"), shard_of(key, shards, seed).alias("shard"),
        F.pmod(F.xxhash64(key, F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(-1).cast("long")), F.lit(seed + 1)), F.lit(buckets)).alias("bucket"),
    )

    column = docs.columns.index(text_col)

    def shuffle(table: pa.Table) -> pa.Table:
        n = table.num_rows
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        text = table.column("row").combine_chunks().field(column)
        by = pa.table({"key": table.column("key"), "text": text, "at": np.arange(n)})
        order = by.sort_by([("key", "ascending"), ("text", "ascending")]).column("at").to_numpy()
        order = order[fisher_yates(n, hash((seed, shard, bucket)) & 0x7FFFFFFFFFFFFFFF)]
        return table.take(pa.array(order)).append_column("place", pa.array(np.arange(n), pa.int64()))

    kinds = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])
    mixed_rows = rows.repartition(max(1, -(-total // TASK)), "shard", "bucket").groupBy("shard", "bucket").applyInArrow(shuffle, kinds)
    counts = written(rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "counts")
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return mixed_rows.join(bases, ["shard", "bucket"]).select("row", "size", "shard", (F.col("base") + F.col("place")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write the documents, one folder for each shard, in the order of their slots.

    A shard is written by as many tasks as it has files of FILE slots, so none moves through one task.
    """
    rows = shuffled(docs, shards, **options).withColumn("file", F.floor(F.col("slot") / FILE))
    rows = rows.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
    rows.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)
