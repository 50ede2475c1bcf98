"""From raw documents to packed training sequences: five stages, each an operator of provlog.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the shared folder and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provlog.llm import exact_dedup, packing, recompression, simhash, toxicity
from provlog.llm.common import documents, tokenizer_file, written

#: Rows that a task hands to Python at once, at most: with whole texts ten thousand of them, Spark's own measure, are
#: held some five times over by the JVM and Python together.
ROWS, ROWS_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(ROWS_KEY)) <= ROWS:
        spark.conf.set(ROWS_KEY, str(ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    in_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit_chain(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    in_small_batches(spark)
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words have a similarity of 0.8 or more, among what SimHash's Gray-order index links and more candidates."""
    in_small_batches(spark)
    return simhash.near_dedup(docs, width=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 13 words that documents with smaller doc_id hold."""
    in_small_batches(spark)
    return recompression.substring_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens at most."""
    in_small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
