"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="provlog-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one takes a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return own_dir(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table, so that what several readers need is worked out once."""
    path = f"{shared_dir(df.sparkSession)}/log-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
