"""What the operators share: text normalisation and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is right, and fast, where every character is one byte; ``translate`` does the rest.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


@cache
def own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="provlog-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a local session takes a temporary folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return own_dir(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The table outlives executors, so nothing before it is computed twice.  Tables lie under
    one folder for each application, which can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's vocabulary, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
