"""Registered queries: what is refused, named, damaged, chosen and reported, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog import api
from provlog.functions import text as X
from provlog.operators import verify
from provlog.operators.writer import Cadence, write_lines
from provlog.plans.registry import F1, F2, register
from provlog.plans.verification import GAPS, MAX_ENTRIES, ROTATED, filed, rotated, with_gaps
from provlog.sources import derived, segments
from provlog.sources.tables import written
from provlog.vocabulary import LOG, Vocabulary


@register(
    F1 + """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'class is the writer''s own' WHEN event_id % 7 = 0 THEN 'subject is no IRI' WHEN event_id % 5 = 0 THEN 'reserved key' WHEN event_id % 13 = 0 THEN 'no key' END AS refused,
    CASE WHEN event_id % 17 = 0 THEN 'no time' WHEN event_id % 7 = 0 THEN 'subject is no IRI' WHEN event_id % 5 <> 0 AND event_id % 13 = 0 THEN 'no key' END AS unwritable FROM f1"""
)
def refused_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller may not write, and what can't be written as a line, with the reason."""
    i = F.col("event_id")
    key = F.when(i % 5 == 0, "seq").when(i % 13 == 0, "bad key").otherwise("k")
    e = derived.entries(spark, sf_dir).select(
        "event_id", F.when(i % 17 == 0, F.concat(F.lit("x"), "time")).otherwise(F.col("time")).alias("time"), F.when(i % 11 == 0, LOG + "Seal").otherwise(F.col("class")).alias("class"),
        F.when(i % 7 == 0, "no colon").otherwise(F.col("subject")).alias("subject"), F.array(F.struct(key.alias("key"), F.lit("v").alias("value"))).alias("fields"),
    )
    r = api.checked(e, Vocabulary.built_in().class_table(spark))
    return r.select("event_id", F.col("error").alias("refused"), X.entry_error(F.col("time"), F.col("class"), F.col("subject"), F.col("fields")).alias("unwritable"))


@register(f"""SELECT c_custkey, regexp_replace(c_name || ' é/' || c_mktsegment, '[^A-Za-z0-9._-]', '-', 'g') AS slug, 'urn:inst:' || c_name AS instance,
    replace(strftime(make_timestamp(c_custkey * 12345678000), '%Y-%m-%dT%H:%M:%S'), ':', '-') || 'Z' AS stamp, ['{LOG}warn', '{LOG}debug', 'urn:x:y', NULL][CAST(c_custkey % 4 AS INT) + 1] AS level FROM customer""")
def names_and_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as parts of files and IRIs, instants as stamps, levels as IRIs."""
    k = F.col("c_custkey")
    given = F.when(k % 2 == 0, F.concat(F.lit("urn:inst:"), "c_name")).otherwise(F.col("c_name"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("warn", "log:debug", "urn:x:y", "loud")]), (k % 4 + 1).cast("int"))
    return derived.table(spark, sf_dir, "customer").select(
        "c_custkey", X.slug(F.concat("c_name", F.lit(" é/"), "c_mktsegment")).alias("slug"), X.instance_iri(given, "urn:inst:").alias("instance"),
        X.stamp(X.time_string(k.cast("long") * 12_345_678)).alias("stamp"), verify.level_iri(level).alias("level"),
    )


ODD = ["‎", "‮", "\u0085", " ", "\u0007", "⁦", "\u007f"]


@register("SELECT doc_id, '\"a\\u{' || ['200e', '202e', '85', '2028', '7', '2066', '7f'][CAST(doc_id % 7 AS INT) + 1] || '}' || coalesce(lang, '') || '\"' AS quoted, TRUE AS back FROM documents")
def escaped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with characters that a line never holds: controls, line separators, bidirectional marks; and whether they come back."""
    odd = F.element_at(F.array(*[F.lit(x) for x in ODD]), (F.col("doc_id") % 7 + 1).cast("int"))
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a"), odd, F.coalesce("lang", F.lit(""))).alias("v"))
    q = d.withColumn("quoted", X.render_value(F.col("v")))
    return q.select("doc_id", "quoted", (X.unquote(F.get(X.tokens(F.col("quoted")), 0)) == F.col("v")).alias("back"))


@register(F1 + f""", v AS (SELECT segment, seq, event_id, CASE WHEN event_id % 3 < 2 AND event_id % 7 <> 0 THEN seq || ':{LOG}info>{LOG}debug' END AS change FROM f1)
    SELECT segment, count(change) FILTER (WHERE seq <= 5 AND n >= 5) AS changes, coalesce(string_agg(change, ',' ORDER BY seq) FILTER (WHERE seq <= 5 AND n >= 5), '') AS told FROM v JOIN (SELECT segment, count(*) AS n FROM f1 GROUP BY segment) USING (segment) GROUP BY segment""")
def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the level that lines record: sealed ones, whose both sides are levels."""
    e, i = derived.events(spark, sf_dir), F.col("event_id")
    to = F.when(i % 7 == 0, "loud").otherwise("log:debug")
    class_ = F.when(i % 3 == 0, "log:LevelChange").when(i % 3 == 1, "log:ConfigChange").otherwise("log:Message")
    body = e.select("segment", "user_id", "seq", (F.col("seq") * 2).alias("line_no"), F.concat_ws(" ", "time", class_, "subject", F.concat(F.lit("seq="), F.col("seq").cast("string")), F.lit("key=level from=info"), F.concat(F.lit("to="), to)).alias("raw"))
    seal = body.where("seq = 5").select("segment", F.lit(11).cast("long").alias("line_no"), F.lit("#seal 1-5 sha256:0").alias("raw"))
    lines = body.select("segment", "line_no", "raw").unionByName(seal).withColumns({"kind": X.line_kind(F.col("raw")), "prefixes": derived.prefixes()})
    r = verify.reported(lines, derived.headers(spark, sf_dir), Vocabulary.built_in())
    told = F.transform("level_changes", lambda c: F.concat(c["at"].cast("string"), F.lit(":"), c["from"], F.lit(">"), c["to"]))
    return r.select("segment", F.size("level_changes").cast("long").alias("changes"), F.array_join(told, ",").alias("told"))


@register(F2 + "SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'not a header line' WHEN 1 THEN 'missing started' END AS error FROM f2")
def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of segments, and why some of them can't be read."""
    u = F.col("user_id") % 5
    top = derived.headers(spark, sf_dir).select("user_id", "segment", F.posexplode(F.split(F.regexp_replace("header", r"\n+\z", ""), "\n")).alias("at", "line"))
    top = top.where(~((u == 1) & F.col("line").startswith("@started"))).withColumn("line", F.when((u == 0) & (F.col("at") == 3), "no directive").otherwise(F.col("line")))
    c = segments.catalog(segments.read(spark, filed(top.select("segment", F.col("at").cast("long").alias("line_no"), "line"), "damaged")))
    return c.select(F.regexp_extract(F.regexp_extract("file", "part-([^/]*)$", 1), r"u(\d+)", 1).cast("long").alias("user_id"), "error")


@register(ROTATED + "SELECT segment, CAST(len(lines) AS BIGINT) AS entries FROM r WHERE user_id = (SELECT max_by(user_id, segment) FROM r)")
def chosen_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the chain that holds the last one by name, chosen by that one."""
    headers, lines = segments.of_lines(written(rotated(spark, sf_dir), "rotated"))
    last = headers.agg(F.max("segment")).first()[0]
    headers, lines = api.chosen(headers.withColumn("name", F.col("segment")), lines, None, last)
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return r.select("segment", "entries")


@register(GAPS + """, s AS (SELECT segment, (u = 1 AND ((n = 0 AND parts > 1) OR n = 2)) OR (u = 2 AND n = parts - 2) AS broken FROM o WHERE NOT ((u = 1 AND n = 1) OR (u = 2 AND n = parts - 1) OR (u = 3 AND n = 0)))
    SELECT segment, 'segment ' || segment || CASE WHEN broken THEN ' BROKEN' ELSE ' OK' END AS told FROM s UNION ALL SELECT NULL, 'verified ' || count(*) || ' segment(s), ' || count(*) FILTER (WHERE broken) || ' broken' FROM s""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of chains with gaps: a line for each segment, and the total."""
    headers, lines = with_gaps(spark, sf_dir)
    report, found = verify.verify(headers, lines, Vocabulary.built_in())
    t = verify.text_report(report, found).where("ord = 0 or segment is null")
    return t.select("segment", F.when(F.col("segment").isNull(), F.col("line")).otherwise(F.array_join(F.slice(F.split("line", " "), 1, 3), " ")).alias("told"))


@register(F1 + """, v AS (SELECT segment, user_id % 3 = 0 AS gap, user_id % 5 = 0 AS wide, CASE WHEN user_id % 2 = 0 THEN 18446744073709000000::HUGEINT ELSE 9223372036854775000::HUGEINT END AS base, max(seq) AS n,
        max(seq) FILTER (WHERE NOT (user_id % 3 = 0 AND seq = 3)) AS through FROM f1 GROUP BY segment, user_id)
    SELECT segment, 'SealRangeGap' AS kind, '0' AS a, CAST(base + 1 AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c FROM v
    UNION ALL SELECT segment, 'SealRangeMismatch', CAST(base + 1 AS VARCHAR), CAST(base + n + CAST(wide AS INT) AS VARCHAR), CAST(base + through AS VARCHAR) FROM v WHERE n + CAST(wide AS INT) <> through
    UNION ALL SELECT segment, 'SequenceGap', CAST(base + 2 AS VARCHAR), CAST(base + 4 AS VARCHAR), NULL FROM v WHERE gap AND n >= 4""")
def verify_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about sequences and bounds of seals on both sides of 2^63: all unsigned numbers of 64 bits are read."""
    e, u = derived.events(spark, sf_dir), F.col("user_id")
    base = F.when(u % 2 == 0, "18446744073709000000").otherwise("9223372036854775000").cast("decimal(20,0)")
    stated = (base + F.col("seq")).cast("decimal(20,0)").cast("string")
    body = e.where(~((u % 3 == 0) & (F.col("seq") == 3))).select("segment", F.col("seq").alias("line_no"), F.concat_ws(" ", "time", F.lit("log:Message"), "subject", F.concat(F.lit("seq="), stated)).alias("raw"))
    ends = e.groupBy("segment", "user_id").agg(F.max("seq").alias("n")).withColumns({"one": (base + 1).cast("string"), "last": (base + F.col("n") + (u % 5 == 0).cast("int")).cast("decimal(20,0)").cast("string")})
    seals = ends.select("segment", (F.col("n") + 1).alias("line_no"), F.concat(F.lit("#seal "), "one", F.lit("-"), "last", F.lit(" sha256:0")).alias("raw"))
    lines = body.unionByName(seals).withColumns({"kind": X.line_kind(F.col("raw")), "prefixes": derived.prefixes()})
    found = verify.line_findings(written(verify.scanned(lines), "scanned"))
    return found.select("segment", "kind", *[F.col(c).cast("string").alias(c) for c in "abc"])


@register(ROTATED + """, d AS (SELECT segment, i + 1 AS seq, r.time AS time, regexp_extract(r.t, ' principal=([^ ]+)', 1) AS principal, regexp_extract(r.t, ' cap=([^ ]+)', 1) AS cap
        FROM (SELECT segment, unnest(rows) AS r, generate_subscripts(rows, 1) AS i FROM k))
    SELECT segment, time || ' log:CapabilityDenied ' || segment || ' seq=' || seq || CASE WHEN principal <> 'anon' THEN ' principal=' || principal ELSE '' END || ' denied=' || cap || ' reason="read ' || time || '"' AS line FROM d""")
def denial_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals as the log notes them, each about the segment in which it lands, which rotation decides."""
    e = derived.entries(spark, sf_dir)
    principal = X.first_value(F.col("fields"), "principal")
    refused = e.select("instance", "ms", "seq", F.when(principal != "anon", principal).alias("principal"), X.first_value(F.col("fields"), "cap").alias("capability"), F.concat(F.lit("read "), "time").alias("action"))
    lines = api.write_entries(api.denials(refused), Cadence(None, None, MAX_ENTRIES, None), ["seq"], level="error")
    return lines.where(F.col("line").contains(" log:CapabilityDenied ")).select("segment", "line")


BLOCK = 130


@register(F1 + f""", k AS (SELECT 'urn:inst:' || event_type || '-' || user_id // 10 AS instance, row_number() OVER (PARTITION BY event_type, user_id // 10 ORDER BY ms, event_id) AS k FROM f1),
    b AS (SELECT instance, (k - 1) // {BLOCK} AS b, count(*) AS n FROM k GROUP BY ALL)
    SELECT instance, CAST(sum(CASE WHEN b = 0 THEN least(n + 1, 101) ELSE least(n, 101) END) AS BIGINT) AS segments, count(*) FILTER (WHERE n > CASE WHEN b = 0 THEN 100 ELSE 101 END) AS noted FROM b GROUP BY instance""")
def failed_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and noted failures where each entry makes a rotation due and 130 entries share a second, which has 101 names.

    When these are used up entries go on in the segment that is open, and one error notes it, until the next second has names again.
    """
    e = derived.entries(spark, sf_dir).withColumn("instance", F.concat(F.lit("urn:inst:"), "event_type", F.lit("-"), F.floor(F.col("user_id") / 10).cast("string")))
    e = e.withColumn("k", F.row_number().over(W.partitionBy("instance").orderBy("ms", "event_id")).cast("long"))
    ms = (F.floor((F.col("k") - 1) / BLOCK) + 1) * 1000
    rows = e.select("instance", X.time_string(ms).alias("time"), ms.alias("ms"), F.lit("log:Message").alias("curie"), "subject", F.lit("").alias("tail"), "k")
    lines = write_lines(rows, Cadence(None, None, 2, None), ["k"])
    noted = F.count_if(F.col("line").contains(" log:Error ") & F.col("line").contains(" reason=rotation-failed "))
    return lines.groupBy("instance").agg(F.countDistinct("segment").alias("segments"), noted.alias("noted"))
