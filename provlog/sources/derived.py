"""Log tables derived from the event tables: entries, headers, seals, runs, traces, accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.vocabulary import LOG, PROV

LEVEL_OF = ["error", "warn", "info", "debug", "trace"]


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: scanning and rendering lines costs far more than dealing out the rows of a few small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def kv(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def present(*fields: Column) -> Column:
    """An array of the fields whose value isn't null."""
    return F.filter(F.array(*fields), lambda f: f["value"].isNotNull())


def prefixes() -> Column:
    return F.create_map(F.lit("log"), F.lit(LOG), F.lit("prov"), F.lit(PROV))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    # The number is stated, so that small partitions aren't joined: what follows is work on each line.
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    return e.withColumns({
        "segment": F.format_string("urn:log:u%d:all", "user_id"),
        "instance": F.format_string("urn:inst:u%d", "user_id"),
        "seq": F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"),
        "time": X.time_string(F.col("ms")),
        "name": F.when(F.col("event_type") == "click", "Resolution").when(F.col("event_type") == "view", "CacheHit").when(F.col("event_type") == "purchase", "Access").when(F.col("event_type") == "signup", "Message").otherwise("Error"),
        "subject": F.format_string("urn:event:%d", "event_id"),
    })


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment for each user: user_id, event_id, segment, instance, seq, ms, time, name, class, subject, fields, line."""
    e = events(spark, sf_dir)
    parent = F.floor(F.col("seq") / 2)
    fields = present(
        kv("seq", F.col("seq")),
        kv("principal", F.when(F.col("event_type") == "signup", "anon").otherwise(F.format_string("urn:agent:a%d", F.col("event_id") % 7))),
        kv("span", F.col("seq")),
        kv("parent", F.when(parent >= 1, parent)),
        kv("dur", F.floor("value")),
        kv("cap", F.concat(F.lit("urn:cap:"), F.col("event_type"))),
        kv("k", F.get_json_object("props", "$.k")),
        kv("msg", F.when(F.col("name").isin("Message", "Error"), F.format_string("event %d", "event_id"))),
    )
    e = e.withColumn("fields", fields).withColumn("class", F.concat(F.lit(LOG), F.col("name")))
    line = X.render_entry(F.col("time"), F.concat(F.lit("log:"), F.col("name")), F.col("subject"), F.col("fields"))
    return e.select("user_id", "event_id", "event_type", "segment", "instance", "seq", "ms", "time", "name", "class", "subject", "fields", line.alias("line"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries again, as read from their lines."""
    lines = entries(spark, sf_dir).select("user_id", "event_id", "segment", "instance", F.col("seq").alias("line_no"), "line")
    return X.once(lines, "e", X.parse_entry(F.col("line"), prefixes())).select("user_id", "event_id", "segment", "instance", "line_no", "e.*")


def header_text(version: str, prefix_map: Column, name: Column, instance: Column, level: Column, started: Column, prev: Column) -> Column:
    """The canonical header: prefixes sorted and aligned, directives in their order, a blank line."""
    pairs = F.array_sort(F.map_entries(prefix_map))
    wide = F.array_max(F.transform(pairs, lambda p: F.length(p["key"]))) + 1
    lines = F.transform(pairs, lambda p: F.concat(F.lit("@prefix "), F.rpad(F.concat(p["key"], F.lit(":")), wide, F.lit(" ")), F.lit(" <"), p["value"], F.lit("> .")))
    return F.concat(
        F.lit(version + "\n"), F.array_join(lines, "\n"), F.lit("\n@name     "), name, F.lit("\n@instance "), instance, F.lit("\n@level    "), level,
        F.lit("\n@started  "), started, F.lit("\n@prev     "), prev, F.lit("\n\n"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, segment, instance, level, started, prev, header (text), h0."""
    from provlog.vocabulary import MAGIC

    started = F.min("time").alias("started")
    h = events(spark, sf_dir).groupBy("user_id", "segment", "instance").agg(started)
    level = F.element_at(F.array(*[F.lit(x) for x in LEVEL_OF]), (F.col("user_id") % 5 + 1).cast("int"))
    h = h.withColumn("level", level).withColumn("prev", F.lit("genesis"))
    text = header_text(MAGIC, prefixes(), F.col("segment"), F.col("instance"), F.concat(F.lit("log:"), F.col("level")), F.col("started"), F.col("prev"))
    return h.withColumn("header", text).withColumn("h0", X.tagged_hash(F.col("header")))
