"""Registered queries: writing, verification, mappers, encodings and streams, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators import chain, mappers, verify
from provlog.operators.writer import Cadence, write_lines
from provlog.plans import queries as base
from provlog.plans.queries import EVERY, F3, FOLD, MILLIS, SEALS
from provlog.plans.registry import F1, register
from provlog.sources import derived, segments
from provlog.sources.tables import written
from provlog.streaming import live
from provlog.vocabulary import LOG, MAGIC, PROV, RDF, SIG, Vocabulary

LAST_LINE = 1_000_000_000


def narrow(rows: DataFrame) -> DataFrame:
    """rows whose sequences and places, far below 2^63 in these tables, are longs."""
    return rows.select(*[F.col(c).cast("long").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in rows.dtypes])


def tampered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of one sealed segment for each user, changed in a way that user_id % 10 decides."""
    e = written(derived.entries(spark, sf_dir).select("user_id", "segment", "seq", "name", "line"), "entries")  # rendered once
    points = written(base.seal_points(spark, sf_dir), "points")
    e = e.join(points.groupBy("segment").agg(F.max("last").alias("n")), "segment", "left").withColumn("u", F.col("user_id") % 10)
    ends = F.col("u").isin(0, 5) & (F.col("seq") == F.col("n"))
    stop = F.replace(F.col("line"), F.concat(F.lit(" log:"), "name", F.lit(" ")), F.lit(" log:ProcessStop "))
    e = e.withColumn("line", F.when(ends, stop).otherwise(F.col("line"))).where(~F.coalesce((F.col("u") == 0) & (F.col("seq") > F.col("n")), F.lit(False)))
    headers = derived.headers(spark, sf_dir).withColumn("prefixes", derived.prefixes()).withColumn("level", F.concat(F.lit(LOG), "level"))
    seals = chain.sealed(e.select("segment", F.col("seq").alias("line_no"), "line"), headers, points)
    user = F.regexp_extract("segment", r"u(\d+)", 1).cast("long") % 10
    nth = F.row_number().over(W.partitionBy("segment").orderBy("last"))
    seals = seals.withColumns({"u": user, "r": nth, "n": F.max("last").over(W.partitionBy("segment")), "at": F.col("last")}).where(~((F.col("u") == 4) & (F.col("r") == 2)))
    seals = seals.withColumns({
        "last": F.when((F.col("u") == 3) & (F.col("last") == F.col("n")), F.col("last") + 2).otherwise(F.col("last")),
        "hash": F.when((F.col("u") == 8) & (F.col("r") == 1), "sha256:" + "0" * 64).otherwise(F.col("hash")),
    })
    changed = F.when((F.col("u") == 1) & (F.col("seq") == 2), F.replace(F.col("line"), F.lit(" dur="), F.lit(" dur=9"))).otherwise(F.col("line"))
    lines = e.where(~((F.col("u") == 2) & (F.col("seq") == 3))).select("segment", (F.col("seq") * 2).alias("line_no"), changed.alias("raw"))
    lines = lines.unionByName(seals.select("segment", (F.col("at") * 2 + 1).alias("line_no"), chain.seal_line(F.col("first"), F.col("last"), F.col("hash"), F.lit(None).cast("string")).alias("raw")))
    odd = headers.withColumn("u", F.col("user_id") % 10).where("u in (6, 7)").select("segment", F.lit(LAST_LINE).cast("long").alias("line_no"), F.when(F.col("u") == 6, "@name x").otherwise("no entry at all").alias("raw"))
    lines = lines.unionByName(odd)
    return headers, lines.select("segment", "line_no", "raw", X.line_kind(F.col("raw")).alias("kind"), derived.prefixes().alias("prefixes"))


TAMPERED = F3 + f""", n AS (SELECT segment, max("last") AS n FROM points GROUP BY segment),
    t1 AS (SELECT user_id % 10 AS u, segment, seq, n, CASE WHEN user_id % 10 IN (0, 5) AND seq = n THEN replace(line, ' log:' || name || ' ', ' log:ProcessStop ') ELSE line END AS line,
        CASE WHEN user_id % 10 IN (0, 5) AND seq = n THEN 'ProcessStop' ELSE name END AS name FROM f1 LEFT JOIN n USING (segment) WHERE NOT coalesce(user_id % 10 = 0 AND seq > n, FALSE)),
    l AS (SELECT segment, max(u) AS u, max(n) AS n, list(line ORDER BY seq) AS lines FROM t1 GROUP BY segment),
    s1 AS (SELECT segment, u, n, h0, first, "last" AS spot, row_number() OVER (PARTITION BY segment ORDER BY "last") AS r, {FOLD.format(list='lines[1:"last"]', init="h0")} AS hash FROM points JOIN l USING (segment) JOIN h USING (segment)),
    s2 AS (SELECT segment, h0, first, spot, CASE WHEN u = 3 AND spot = n THEN spot + 2 ELSE spot END AS "last", CASE WHEN u = 8 AND r = 1 THEN 'sha256:' || repeat('0', 64) ELSE hash END AS hash FROM s1 WHERE NOT (u = 4 AND r = 2)),
    t2 AS (SELECT u, segment, seq, name, CASE WHEN u = 1 AND seq = 2 THEN replace(line, ' dur=', ' dur=9') ELSE line END AS line FROM t1 WHERE NOT (u = 2 AND seq = 3)),
    s3 AS (SELECT s2.segment, h0, first, spot, "last", hash, list(t2.line ORDER BY seq) AS lines, max(seq) AS covered FROM s2 JOIN t2 ON t2.segment = s2.segment AND t2.seq <= s2.spot GROUP BY ALL),
    s4 AS (SELECT segment, first, "last", hash, covered, {FOLD.format(list="lines", init="h0")} AS head, coalesce(lag(covered) OVER (PARTITION BY segment ORDER BY spot), 0) AS through FROM s3),
    z AS (SELECT t2.segment, max(seq) AS position, min(seq) FILTER (WHERE name = 'ProcessStop') AS ended_at, '{LOG}' || max_by(name, seq) AS last_class, count(*) AS entries FROM t2 GROUP BY t2.segment),
    w2 AS (SELECT z.*, coalesce(q.sealed, 0) AS sealed, coalesce(q.seals, 0) AS seals, q.head FROM z LEFT JOIN (SELECT segment, max(covered) AS sealed, count(*) AS seals, max_by(hash, covered) AS head FROM s4 GROUP BY segment) q USING (segment)) """  # fmt: skip
NONE = "CAST(NULL AS BIGINT)"


@register(TAMPERED + f"""SELECT segment, 'Malformed' AS kind, TRUE AS breaking, CAST({LAST_LINE} AS BIGINT) AS a, {NONE} AS b, {NONE} AS c, CAST(NULL AS VARCHAR) AS x, CAST(NULL AS VARCHAR) AS y FROM l WHERE u IN (6, 7)
    UNION ALL SELECT segment, 'SealRangeGap', TRUE, through, first, NULL, NULL, NULL FROM s4 WHERE first <> through + 1
    UNION ALL SELECT segment, 'SealRangeMismatch', TRUE, first, "last", covered, NULL, NULL FROM s4 WHERE "last" <> covered
    UNION ALL SELECT segment, 'SealMismatch', TRUE, first, "last", NULL, hash, head FROM s4 WHERE hash <> head
    UNION ALL SELECT segment, 'SequenceGap', TRUE, p, seq, NULL, NULL, NULL FROM (SELECT segment, seq, lag(seq) OVER (PARTITION BY segment ORDER BY seq) AS p FROM t2) WHERE seq <> p + 1
    UNION ALL SELECT segment, 'AfterTheEnd', TRUE, ended_at, least(ended_at, sealed) + 1, position, NULL, NULL FROM w2 WHERE position > ended_at OR (ended_at IS NOT NULL AND position > sealed)
    UNION ALL SELECT segment, 'UnmarkedEnd', FALSE, NULL, NULL, NULL, last_class, NULL FROM w2 WHERE ended_at IS NULL
    UNION ALL SELECT segment, 'UnsealedTail', FALSE, sealed + 1, position, NULL, NULL, NULL FROM w2 WHERE ended_at IS NULL AND position > sealed""")  # fmt: skip
def verify_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in segments that were tampered with in ten ways."""
    headers, lines = tampered(spark, sf_dir)
    return narrow(verify.verify(headers, lines, Vocabulary.built_in())[1])


@register(TAMPERED + f"""SELECT segment, entries, seals, position, sealed, coalesce(w2.head, h0) AS head, last_class, coalesce(ended_at = position AND sealed >= position, FALSE) AS finished FROM w2 JOIN h USING (segment)""")
def segment_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tampered segment says of itself."""
    headers, lines = tampered(spark, sf_dir)
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return narrow(r.select("segment", "entries", "seals", "position", F.col("sealed_through").alias("sealed"), "head", "last_class", "finished"))


MAX_ENTRIES = 20


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of segments that rotate after twenty entries, the process start among them."""
    e = derived.entries(spark, sf_dir)
    tail = X.render_fields(F.filter("fields", lambda f: f["key"] != "seq"))
    e = e.select("instance", "time", "ms", F.concat(F.lit("log:"), "name").alias("curie"), "subject", tail.alias("tail"), "seq")
    return write_lines(e, Cadence(None, None, MAX_ENTRIES, None), ["seq"])


ROTATED = F1.replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS (SELECT user_id, seq, time, (seq - 1) // {MAX_ENTRIES - 1} AS n, log_subject, replace(line, time || log_subject || ' seq=' || seq, '') AS tail FROM (SELECT *, ' log:' || name || ' ' || subject AS log_subject FROM f1)),
    c AS (SELECT user_id, instance, count(*) AS total, min(time) AS t0, max(time) AS t1 FROM f1 GROUP BY ALL),
    g0 AS (SELECT *, unnest(range(0, total // {MAX_ENTRIES - 1} + 1)) AS n FROM c),
    b AS (SELECT user_id, n, list({{'s': log_subject, 't': tail, 'time': time}} ORDER BY seq) AS rows FROM e GROUP BY user_id, n),
    g AS (SELECT g0.*, coalesce(p.time, t0) AS started, z.time AS ended, coalesce(b.rows, []) AS rows FROM g0 LEFT JOIN e p ON p.user_id = g0.user_id AND p.seq = g0.n * {MAX_ENTRIES - 1}
        LEFT JOIN e z ON z.user_id = g0.user_id AND z.seq = (g0.n + 1) * {MAX_ENTRIES - 1} LEFT JOIN b ON b.user_id = g0.user_id AND b.n = g0.n),
    k0 AS (SELECT *, 'urn:log:u' || user_id || ':' || replace(started[1:19], ':', '-') || 'Z' AS segment FROM g),
    k AS (SELECT *, lead(segment) OVER (PARTITION BY user_id ORDER BY n) AS next, list_concat([started || ' log:ProcessStart ' || instance || ' seq=1'], list_transform(rows, lambda r, i: r.time || r.s || ' seq=' || (i + 1) || r.t)) AS body FROM k0),
    m AS (SELECT user_id, n, segment, instance, next, started, list_append(body, CASE WHEN next IS NULL THEN t1 || ' log:ProcessStop ' || instance || ' seq=' || (len(body) + 1) ELSE ended || ' log:Rotation ' || segment || ' seq=' || (len(body) + 1) || ' next=' || next END) AS lines FROM k),
    r AS (SELECT user_id, n, segment, instance, next, lines, 'genesis' AS prev, {FOLD.format(list="lines", init="'sha256:' || sha256(" + "{h}" + ")")} AS head FROM m WHERE n = 0
        UNION ALL SELECT m.user_id, m.n, m.segment, m.instance, m.next, m.lines, r.head AS prev, {FOLD.format(list="m.lines", init="'sha256:' || sha256(" + "{i}" + ")")} AS head FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n + 1) """  # fmt: skip


def _header_sql(of: str, prev: str) -> str:
    return (
        f"'{MAGIC}' || chr(10) || '@prefix log:  <{LOG}> .' || chr(10) || '@prefix prov: <{PROV}> .' || chr(10) || '@name     ' || {of}segment || chr(10) || '@instance ' || {of}instance || chr(10)"
        f" || '@level    log:trace' || chr(10) || '@started  ' || {of}started || chr(10) || '@prev     ' || {prev} || chr(10) || chr(10)"
    )


ROTATED = ROTATED.replace("{h}", _header_sql("", "'genesis'")).replace("{i}", _header_sql("m.", "r.head"))


@register(ROTATED + "SELECT instance, segment, prev, head, CAST(len(lines) AS BIGINT) AS entries, next AS successor FROM r")
def rotate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written with rotation: each names its successor and is chained to its predecessor's head."""
    headers, lines = segments.of_lines(written(rotated(spark, sf_dir), "rotated"))
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return r.select("instance", "segment", "prev", "head", "entries", "successor")


def with_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rotated segments: of some users the second is missing, of some the newest, of some the oldest."""
    lines = written(rotated(spark, sf_dir), "rotated")
    name = lines.select("instance", "segment").distinct()
    u = F.regexp_extract("instance", r"u(\d+)", 1).cast("long") % 4
    n = name.withColumns({"u": u, "n": F.row_number().over(W.partitionBy("instance").orderBy("segment")), "of": F.count("*").over(W.partitionBy("instance"))})
    lost = n.where("(u = 1 AND n = 2) OR (u = 2 AND n = of) OR (u = 3 AND n = 1)").select("segment")
    return segments.of_lines(lines.join(lost, "segment", "left_anti"))


GAPS = ROTATED + ", o AS (SELECT *, user_id % 4 AS u, count(*) OVER (PARTITION BY user_id) AS parts, lag(head) OVER (PARTITION BY user_id ORDER BY n) AS h1, lag(head, 2) OVER (PARTITION BY user_id ORDER BY n) AS h2 FROM r) "


@register(GAPS + f"""SELECT segment, 'MissingSuccessor' AS kind, TRUE AS breaking, {NONE} AS a, {NONE} AS b, {NONE} AS c, next AS x, CAST(NULL AS VARCHAR) AS y FROM o WHERE (u = 1 AND n = 0 AND parts > 1) OR (u = 2 AND n = parts - 2)
    UNION ALL SELECT segment, 'PrevMismatch', TRUE, NULL, NULL, NULL, h1, h2 FROM o WHERE u = 1 AND n = 2""")  # fmt: skip
def verify_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in chains of segments from which some are missing; a missing oldest one leaves no trace."""
    headers, lines = with_gaps(spark, sf_dir)
    return narrow(verify.verify(headers, lines, Vocabulary.built_in())[1])


@register(GAPS + "SELECT segment, row_number() OVER (PARTITION BY user_id ORDER BY n) AS place FROM o WHERE NOT ((u = 1 AND n = 1) OR (u = 2 AND n = parts - 1) OR (u = 3 AND n = 0))")
def chain_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of each instance's segments."""
    headers, lines = with_gaps(spark, sf_dir)
    r = written(verify.reported(lines, headers, Vocabulary.built_in()), "reports")
    return verify.chain_order(r).select("segment", "place")


@register(GAPS + "SELECT max_by(segment, n) AS segment, max_by(head, n) AS head FROM o GROUP BY user_id")
def chain_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest segment of each chain: the one whose head no other names as its predecessor."""
    headers, lines = segments.of_lines(written(rotated(spark, sf_dir), "rotated"))
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return r.join(r.select(F.col("prev").alias("head")), "head", "left_anti").select("segment", "head")


@register(SEALS + 'SELECT segment, first, "last", hash FROM s')
def stream_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals that a stateful stream writes: those of the batch writer."""
    headers = derived.headers(spark, sf_dir).select("segment", "h0")
    batch = derived.entries(spark, sf_dir).select("segment", "ms", "event_id", "line").join(headers, "segment")
    return live.drained(live.seal_stream(live.fed(batch, "entries"), EVERY, MILLIS), "seals")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a kernel's trace."""
    e = derived.events(spark, sf_dir)
    i = F.col("event_id")
    started = F.when((i % 13 == 0) | (i % 17 == 0), None).otherwise(F.col("ms"))
    note = lambda d, k, v: F.when(i % d == 0, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")))
    notes = F.filter(F.array(note(13, "denied", "urn:cap:x"), note(17, "depth", "9"), note(19, "limited", "urn:x:y"), note(23, "failed", "denied"), note(29, "failed", "not-found"), note(31, "bad key", "v")), lambda n: n.isNotNull())
    scopes = F.when(i % 11 == 0, None).when(i % 7 == 0, F.array(F.lit("urn:agent:a"), F.lit("urn:agent:b"))).otherwise(F.array(F.lit("urn:cap:read"), F.concat(F.lit("urn:agent:a"), (i % 5).cast("string"))))
    half = F.floor(F.col("seq") / 2)
    return e.select(
        "event_id", F.col("subject").alias("target"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("thread"), started.alias("started"), (started + F.floor("value")).alias("ended"),
        (F.col("event_type") == "view").alias("cache_hit"), F.col("seq").alias("span"), F.when(half >= 1, half).alias("parent"), scopes.alias("capability"), notes.alias("notes"),
    )


NOW = 1_767_225_600_000
TRACE = F1 + f""", x AS (SELECT event_id, event_id AS i, time, subject, user_id, value, seq, event_type, event_id % 13 = 0 OR event_id % 17 = 0 AS clockless FROM f1),
    tr AS (SELECT event_id, i % 31 <> 0 AS writable, CASE WHEN clockless THEN '2026-01-01T00:00:00.000Z' ELSE time END AS time,
    '{LOG}' || CASE WHEN i % 13 = 0 THEN 'CapabilityDenied' WHEN i % 17 = 0 THEN 'DepthExceeded' WHEN i % 19 = 0 THEN 'NotResolved' WHEN i % 23 = 0 THEN 'EndpointDenied' WHEN event_type = 'view' THEN 'CacheHit' ELSE 'Resolution' END AS class,
    ' principal=' || CASE WHEN i % 11 = 0 OR i % 7 = 0 THEN 'urn:agent:host' ELSE 'urn:agent:a' || (i % 5) END || ' worker=w' || (user_id % 3) || ' span=' || seq || CASE WHEN seq // 2 >= 1 THEN ' parent=' || (seq // 2) ELSE '' END
    || CASE WHEN clockless THEN '' ELSE ' dur=' || greatest(CAST(floor(value) AS BIGINT), 0) END || CASE WHEN i % 11 = 0 THEN '' WHEN i % 7 = 0 THEN ' cap=urn:agent:a cap=urn:agent:b' ELSE ' cap=urn:cap:read cap=urn:agent:a' || (i % 5) END
    || CASE WHEN i % 13 = 0 THEN ' denied=urn:cap:x' ELSE '' END || CASE WHEN i % 17 = 0 THEN ' depth=9' ELSE '' END || CASE WHEN i % 19 = 0 THEN ' limited=urn:x:y' ELSE '' END || CASE WHEN i % 23 = 0 THEN ' failed=denied' ELSE '' END
    || CASE WHEN i % 29 = 0 THEN ' failed=not-found' ELSE '' END || CASE WHEN i % 31 = 0 THEN ' bad key=v' ELSE '' END AS tail FROM x) """  # fmt: skip


@register(TRACE + "SELECT event_id, time, class, tail, writable FROM tr")
def trace_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events as entries: class by rule, columns in their order, principal carried or the host's."""
    e = mappers.trace_entries(trace_events(spark, sf_dir), F.lit(NOW).cast("long"), "urn:agent:host")
    return e.select("event_id", "time", "class", X.render_fields(F.col("fields")).alias("tail"), "writable")


@register(TRACE + "SELECT 'unwritable' AS reason, count(*) AS count FROM tr WHERE NOT writable HAVING count(*) > 0")
def drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tracer lost, by reason."""
    return mappers.drop_ledger(mappers.trace_entries(trace_events(spark, sf_dir), F.lit(NOW).cast("long"), "urn:agent:host"))


@register(TRACE + "SELECT class, count(*) AS entries, count(*) FILTER (WHERE NOT writable) AS lost FROM tr GROUP BY class")
def trace_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many trace events became entries of each class."""
    e = mappers.trace_entries(trace_events(spark, sf_dir), F.lit(NOW).cast("long"))
    return e.groupBy("class").agg(F.count("*").alias("entries"), F.count_if(~F.col("writable")).alias("lost"))


def encoded(c: str) -> str:
    """url_encode keeps letters, digits and -._~; the grammar keeps a few more."""
    out = f"url_encode({c})"
    for ch in ":/@!$'()*+,;":
        out = f"replace({out}, '%{ord(ch):02X}', '{ch * (2 if ch == chr(39) else 1)}')"
    return out


@register(f"SELECT doc_id, e AS encoded, CASE WHEN strlen(e) > 256 THEN regexp_replace(e[1:256], '%.?$', '') || '…' ELSE e END AS cut FROM (SELECT doc_id, {encoded('text')} AS e FROM documents)")
def percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts percent-encoded by byte, and cut without breaking an escape."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", X.encode_text(F.col("text")).alias("encoded"))
    return d.withColumn("cut", X.cut(F.col("encoded")))


@register(r"""SELECT page_id, iri, url_encode(iri) AS plain FROM (SELECT page_id, 'urn:x:' || page_id || '/' || ['a b', 'é', 'a%20b', 'a%zz', '{x}'][CAST(page_id % 5 AS INT) + 1] AS iri FROM pages) WHERE FALSE
    UNION ALL SELECT page_id, 'urn:x:' || page_id || '/' || ['a b', 'é', 'a%20b', 'a%zz', '{x}'][CAST(page_id % 5 AS INT) + 1], 'urn:x:' || page_id || '/' || ['a%20b', '%C3%A9', 'a%20b', 'a%25zz', '%7Bx%7D'][CAST(page_id % 5 AS INT) + 1] FROM pages""")
def encode_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRIs as URIs; a percent sign that starts no escape is encoded too."""
    tail = F.element_at(F.array(*[F.lit(x) for x in ("a b", "é", "a%20b", "a%zz", "{x}")]), (F.col("page_id") % 5 + 1).cast("int"))
    p = derived.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("urn:x:"), F.col("page_id").cast("string"), F.lit("/"), tail).alias("iri"))
    return p.withColumn("plain", X.encode_iri(F.col("iri")))


@register(f"""SELECT o_orderkey, ' door=' || ['web', 'wire', 'cli'][CAST(o_orderkey % 3 AS INT) + 1] || ' verb=' || CASE o_orderpriority[1] WHEN '1' THEN 'GET' WHEN '2' THEN 'POST' ELSE 'SOURCE' END || ' outcome=' || oc || ' bytes=' || CAST(floor(o_totalprice) AS BIGINT)
    || ' dur=' || (o_orderkey % 1000) || ' principal=' || CASE WHEN o_custkey % 5 = 0 THEN 'anon' ELSE 'urn:agent:c' || o_custkey END || ' credential={LOG}' || CASE WHEN o_custkey % 5 = 0 THEN 'None' ELSE ['Token', 'Session', 'Peer'][CAST(o_custkey % 3 AS INT) + 1] END
    || CASE WHEN oc = 'ok' THEN ' grant=urn:grant:' || o_custkey ELSE '' END || ' q=segment=' || {encoded('c_mktsegment')} || '&name=' || {encoded('c_name')} || CASE WHEN oc = 'denied' THEN ' needs=urn:cap:order:read' ELSE '' END AS tail
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'not-found' ELSE 'denied' END AS oc FROM orders) JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
def access_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served requests as entries: secrets withheld, texts encoded."""
    o = derived.table(spark, sf_dir, "orders").join(derived.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    anonymous, first = F.col("o_custkey") % 5 == 0, F.substring("o_orderpriority", 1, 1)
    argument = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    outcome = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "not-found").otherwise("denied")
    r = o.select(
        "o_orderkey", F.format_string("urn:order:%d", "o_orderkey").alias("subject"), pick(F.col("o_orderkey"), "web", "wire", "cli").alias("door"), F.when(first == "1", "GET").when(first == "2", "POST").otherwise("SOURCE").alias("verb"),
        outcome.alias("outcome"), F.floor("o_totalprice").alias("bytes"), (F.col("o_orderkey") % 1000).alias("dur"), F.when(~anonymous, F.format_string("urn:agent:c%d", "o_custkey")).alias("caller"),
        F.concat(F.lit(LOG), F.when(anonymous, "None").otherwise(pick(F.col("o_custkey"), "Token", "Session", "Peer"))).alias("credential"), F.when(outcome == "ok", F.format_string("urn:grant:%d", "o_custkey")).alias("grant"),
        F.array(argument("segment", F.col("c_mktsegment")), argument("access_token", F.lit("x")), argument("name", F.col("c_name"))).alias("arguments"), F.array(F.lit("urn:cap:order:read")).alias("needs"),
    )
    return mappers.access_entries(r).where("error is null").select("o_orderkey", X.render_fields(F.col("fields")).alias("tail"))


@register(F1 + """, p AS (SELECT *, CASE WHEN seq // 2 >= 1 THEN seq // 2 END AS parent FROM f1) SELECT c.segment, p.name AS caller, c.name AS callee, count(*) AS calls FROM p c JOIN f1 p ON p.segment = c.segment AND p.seq = c.parent AND p.seq <> c.seq GROUP BY ALL""")
def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which classes of entries call which, over the graph of each segment."""
    from provlog.operators import triples

    e = written(derived.parsed(spark, sf_dir).select("segment", "line_no", "class", "fields"), "parsed")  # edges and names read it four times
    edges = triples.invoked(e).select(F.col("graph").alias("segment"), "s", "o")
    name = triples.node(e).select("id", F.regexp_replace("class", f"^{LOG}", "").alias("name"))
    both = edges.join(name.withColumnsRenamed({"id": "s", "name": "caller"}), "s").join(name.withColumnsRenamed({"id": "o", "name": "callee"}), "o")
    return both.groupBy("segment", "caller", "callee").agg(F.count("*").alias("calls"))


@register(F1 + "SELECT 'urn:cap:' || event_type AS subject, segment AS graph, count(*) AS entries FROM f1 GROUP BY ALL")
def across_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which graphs each capability was used, and how often."""
    from provlog.operators import triples

    t = triples.declared(derived.parsed(spark, sf_dir), Vocabulary.built_in()).where(F.col("p") == LOG + "capability")
    return t.groupBy(F.col("o").alias("subject"), "graph").agg(F.count("*").alias("entries"))


PATH = ["info", "warn", "error", "debug", "urn:l:1", "urn:l:2", "urn:l:3", "urn:l:4", "urn:l:5", "urn:l:6", "urn:l:7", "trace"]


def leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three segments for each user, whose levels change: recorded or not, on a long path, and with a second start of the chain."""
    iri = lambda x: x if ":" in x else LOG + x
    change = lambda a, b: F.struct(F.lit(1).cast("long").alias("at"), F.lit(iri(a)).alias("from"), F.lit(iri(b)).alias("to"))
    none = F.array().cast(verify.CHANGES)
    u = derived.events(spark, sf_dir).select("user_id").distinct().withColumn("k", F.col("user_id") % 5)
    long_way = F.array(*[change(a, b) for a, b in reversed(list(zip(PATH, PATH[1:])))])
    n = F.col("n")
    recorded = F.when((n == 2) & (F.col("k") == 0), F.array(change("info", "debug"))).when((n == 3) & (F.col("k") == 0), F.array(change("debug", "trace"))).when((n == 2) & (F.col("k") == 2), long_way).when((n == 3) & (F.col("k") == 2), F.array(change("trace", "trace"))).otherwise(none)
    level = F.when(n == 1, LOG + "info").when(n == 2, F.when(F.col("k") == 2, LOG + "trace").otherwise(LOG + "debug")).otherwise(LOG + "trace")
    name = lambda i: F.format_string("urn:log:u%d:%d", "user_id", i)
    rows = u.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    prev = F.when((n == 1) | ((F.col("k") == 3) & (n == 2)), F.lit("genesis")).otherwise(F.format_string("head%d-%d", "user_id", n - 1))
    return rows.select(
        name(n).alias("segment"), F.format_string("urn:inst:u%d", "user_id").alias("instance"), level.alias("level"), prev.alias("prev"), F.format_string("head%d-%d", "user_id", n).alias("head"),
        F.when(n < 3, name(n + 1)).when(F.col("k") == 4, F.lit("urn:log:gone")).alias("successor"), recorded.alias("level_changes"),
    )


@register(f"""WITH u AS (SELECT DISTINCT user_id, user_id % 5 AS k, 'urn:log:u' || user_id || ':' AS s FROM events) SELECT s || n AS segment, 'UnbracketedLevelChange' AS kind, TRUE AS breaking, {NONE} AS a, {NONE} AS b, {NONE} AS c, '{LOG}' || CASE n WHEN 2 THEN 'info' ELSE 'debug' END AS x, '{LOG}' || CASE n WHEN 2 THEN 'debug' ELSE 'trace' END AS y
    FROM u, (SELECT unnest([2, 3]) AS n) WHERE k IN (1, 3, 4)
    UNION ALL SELECT s || 2, 'UnexpectedGenesis', TRUE, NULL, NULL, NULL, s || 1, NULL FROM u WHERE k = 3 UNION ALL SELECT s || 3, 'MissingSuccessor', TRUE, NULL, NULL, NULL, 'urn:log:gone', NULL FROM u WHERE k = 4""")  # fmt: skip
def verify_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes that nothing records, however long the recorded path, and chains that begin anew."""
    return narrow(verify.chain_findings(written(leveled(spark, sf_dir), "leveled")))


@register(F1 + """, u AS (SELECT DISTINCT user_id, user_id % 5 AS k FROM f1) SELECT 'urn:inst:u' || user_id AS instance, CAST(3 AS BIGINT) AS segments, CAST(CASE k WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS broken, k IN (0, 2) AS ok FROM u""")
def chain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of each chain are broken."""
    r = written(leveled(spark, sf_dir), "leveled")
    return verify.chains(r, verify.chain_findings(r))


@register(SEALS + """SELECT segment, count(*) AS seals, CASE WHEN bool_or(contains(coalesce(signature, ''), ':')) THEN 'Ed25519' ELSE '' END AS signed_with FROM f3 GROUP BY segment""")
def signed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each segment's seals are signed with."""
    e = written(derived.entries(spark, sf_dir).select("segment", "seq", "line"), "entries")  # rendered once
    s = base.seals(spark, sf_dir, e).select("segment", (F.col("last") * 2 + 1).alias("line_no"), F.col("line").alias("raw"))
    lines = e.select("segment", (F.col("seq") * 2).alias("line_no"), F.col("line").alias("raw")).unionByName(s).select("segment", "line_no", "raw", X.line_kind(F.col("raw")).alias("kind"), derived.prefixes().alias("prefixes"))
    r = verify.reported(lines, derived.headers(spark, sf_dir), Vocabulary.built_in())
    return r.where("seals > 0").select("segment", "seals", F.array_join("signed_with", ",").alias("signed_with"))


@register(GAPS + """SELECT instance, next AS segment, unnest([s0, segment]) AS subject, unnest([h0, head]) AS expected, unnest([p0, prev]) AS stated, unnest(['MissingSuccessor x=' || n0, 'PrevMismatch x=' || h1 || ' y=' || h2]) AS finding
    FROM (SELECT *, first_value(segment) OVER w AS s0, first_value(head) OVER w AS h0, first_value(prev) OVER w AS p0, first_value(next) OVER w AS n0 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY n)) WHERE u = 1 AND n = 2 AND next IS NOT NULL""")  # fmt: skip
def chain_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rotation notes of the two segments before it."""
    headers, lines = with_gaps(spark, sf_dir)
    b = verify.chain_broken(headers, lines, Vocabulary.built_in())
    of = lambda k: X.first_value(F.col("fields"), k)
    return b.select("instance", "segment", "subject", of("expected").alias("expected"), of("stated").alias("stated"), of("finding").alias("finding"))


@register(ROTATED + "SELECT instance, max_by(segment, n) AS name, '" + LOG + "trace' AS level, max_by(head, n) AS head FROM r GROUP BY instance")
def restart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a restarted writer goes on: the newest segment of each chain, by its links."""
    from provlog.operators.writer import tails

    headers, lines = segments.of_lines(written(rotated(spark, sf_dir), "rotated"))
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return tails(headers, r).select("instance", "name", "level", "head")


@register(ROTATED + "SELECT r.instance, r.segment, r.prev, CASE WHEN r.next IS NULL THEN 'sha256:' || sha256(" + _header_sql("m.", "r.prev") + ") ELSE r.head END AS head, CAST(len(r.lines) - CASE WHEN r.next IS NULL THEN 1 ELSE 0 END AS BIGINT) AS entries, r.next AS successor FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n")
def stream_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that a stateful stream writes and rotates: those of the batch writer, but the last of each chain stays open."""
    e = derived.entries(spark, sf_dir)
    tail = X.render_fields(F.filter("fields", lambda f: f["key"] != "seq"))
    e = e.select("instance", "time", "ms", "class", F.concat(F.lit("log:"), "name").alias("curie"), "subject", tail.alias("tail"), "seq")
    stream = live.write_stream(live.fed(e, "entries"), Cadence(None, None, MAX_ENTRIES, None), ["seq"], "trace", Vocabulary.built_in())
    headers, lines = segments.of_lines(live.drained(stream, "writer"))
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return r.select("instance", "segment", "prev", "head", "entries", "successor")


@register(ROTATED + "SELECT r.instance, r.segment, r.prev, CASE WHEN r.next IS NULL THEN 'sha256:' || sha256(" + _header_sql("m.", "r.prev") + ") ELSE r.head END AS head, CAST(len(r.lines) - CASE WHEN r.next IS NULL THEN 1 ELSE 0 END AS BIGINT) AS entries, r.next AS successor FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream writes where entries come in six batches and late, but not later than the watermark: what the batch writer does."""
    e = derived.entries(spark, sf_dir)
    tail = X.render_fields(F.filter("fields", lambda f: f["key"] != "seq"))
    e = e.select("instance", "time", "ms", "class", F.concat(F.lit("log:"), "name").alias("curie"), "subject", tail.alias("tail"), "event_id")
    span = e.agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    delay = 3_600_000
    e = e.join(F.broadcast(span), F.lit(True))  # one row
    late = F.pmod(F.xxhash64("event_id"), F.lit(delay))
    batch = F.floor((F.col("ms") + late - F.col("low")) * 5 / (F.col("high") - F.col("low") + delay))
    # The last batch has a single entry, of an instance of its own, that lets the watermark pass all others.
    last = span.select(F.lit("urn:inst:end").alias("instance"), X.time_string(F.col("high") + 2 * delay).alias("time"), (F.col("high") + 2 * delay).alias("ms"), F.lit(LOG + "Message").alias("class"), F.lit("log:Message").alias("curie"), F.lit("urn:x:end").alias("subject"), F.lit("").alias("tail"), F.lit(-1).cast("long").alias("event_id"), F.lit(5).cast("long").alias("_n"))
    rows = e.withColumn("_n", batch.cast("long")).drop("low", "high").unionByName(last)
    stream = live.fed(rows, "late", F.col("_n"), 6).drop("_n")
    written_ = live.drained(live.write_stream(stream, Cadence(None, None, MAX_ENTRIES, None), ["ms", "event_id"], "trace", Vocabulary.built_in(), f"{delay} milliseconds"), "late")
    headers, lines = segments.of_lines(written_.where("instance <> 'urn:inst:end'"))
    r = verify.reported(lines, headers, Vocabulary.built_in())
    return r.select("instance", "segment", "prev", "head", "entries", "successor")


STOPPED = F1 + """, n AS (SELECT segment, max(seq) AS n FROM f1 GROUP BY segment), p AS (SELECT f1.*, CASE WHEN seq // 2 >= 1 THEN seq // 2 END AS parent FROM f1) """


@register(STOPPED + f"""SELECT segment AS graph, segment || ':' || parent AS s, '{LOG}invoked' AS p, segment || ':' || seq AS o FROM p WHERE parent IS NOT NULL AND parent <> seq
    UNION ALL SELECT DISTINCT segment, principal, '{RDF}type', '{PROV}Agent' FROM p WHERE principal <> 'anon'
    UNION ALL SELECT segment, segment || ':' || seq, '{RDF}type', '{LOG}' || name FROM p UNION ALL SELECT segment, segment || ':' || (n + 1), '{RDF}type', '{LOG}ProcessStop' FROM n
    UNION ALL SELECT segment, segment || ':' || seq, '{LOG}capability', 'urn:cap:' || event_type FROM p UNION ALL SELECT segment, segment || ':' || seq, '{LOG}undeclaredKey', 'k' FROM p WHERE k IS NOT NULL
    UNION ALL SELECT segment, segment || ':seal:1-' || (n + 1), '{SIG}contentHash', 'sha256:0' FROM n""")  # fmt: skip
def stream_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of lines says: its entries, call-tree edges, agents and seals, as the batch operator tells it."""
    p = derived.entries(spark, sf_dir).select("segment", "instance", "seq", "time", "line")
    last = p.groupBy("segment", "instance").agg(F.max("seq").alias("n"), F.max("time").alias("time"))
    stop = last.select("segment", "instance", (F.col("n") + 1).alias("line_no"), F.concat("time", F.lit(" log:ProcessStop "), "instance").alias("raw"))
    seal = last.select("segment", "instance", (F.col("n") + 2).alias("line_no"), F.concat(F.lit("#seal 1-"), (F.col("n") + 1).cast("string"), F.lit(" sha256:0")).alias("raw"))
    rows = p.select("segment", "instance", F.col("seq").alias("line_no"), F.col("line").alias("raw")).unionByName(stop).unionByName(seal)
    rows = rows.select("segment", "instance", "line_no", "raw", X.line_kind(F.col("raw")).alias("kind"), derived.prefixes().alias("prefixes"))
    # In five batches, a tenth of the lines ahead of their turn.
    n = F.floor((F.col("line_no") - 1) * 5 / (F.max("line_no").over(W.partitionBy("segment")) + 1))
    batch = F.when(F.pmod(F.xxhash64("segment", "line_no"), F.lit(10)) == 0, F.greatest(n - 1, F.lit(0))).otherwise(n)
    t = live.drained(live.triples_stream(live.fed(rows, "lines", batch, 5), Vocabulary.built_in()), "triples")
    agent = (F.col("p") == RDF + "type") & F.col("o").isin(PROV + "Agent") | (F.col("p") == RDF + "type") & F.col("o").startswith(LOG) & (F.col("o") != LOG + "Seal")
    return t.where(agent | F.col("p").isin(LOG + "invoked", LOG + "capability", LOG + "undeclaredKey", SIG + "contentHash")).select("graph", "s", "p", "o")


@register(F1 + f""", w AS (SELECT max(segment) AS sg, max_by(instance, segment) AS ins FROM f1) SELECT replace(replace(s, 'urn:inst:serve-9', ins), 'urn:log:s', sg) AS s, p, replace(replace(o, 'urn:inst:serve-9', ins), 'urn:log:s', sg) AS o, o_kind FROM w, (VALUES ('urn:log:config', '{RDF}type', '{LOG}Config', 'iri'), ('urn:log:config', '{LOG}level', '{LOG}debug', 'iri'), ('urn:log:config', '{LOG}destination', '{LOG}console', 'iri'), ('urn:log:config', '{LOG}directory', '.', 'literal'),
    ('urn:log:config', '{LOG}instance', 'urn:inst:serve', 'iri'), ('urn:log:config', '{LOG}sealCadence', 'urn:log:config#seal', 'iri'), ('urn:log:config', '{LOG}rotationCadence', 'urn:log:config#rotation', 'iri'), ('urn:log:config#seal', '{RDF}type', '{LOG}Cadence', 'iri'),
    ('urn:log:config#seal', '{LOG}everyEntries', '5', 'literal'), ('urn:log:config#seal', '{LOG}unbounded', '{LOG}everyMillis', 'iri'), ('urn:log:config#rotation', '{RDF}type', '{LOG}Cadence', 'iri'), ('urn:log:config#rotation', '{LOG}everyEntries', '100000', 'literal'),
    ('urn:log:config#rotation', '{LOG}everyMillis', '86400000', 'literal'), ('urn:log:config', '{LOG}currentSegment', 'urn:log:s', 'iri'), ('urn:inst:serve', '{RDF}type', '{LOG}Instance', 'iri'), ('urn:log:s', '{RDF}type', '{LOG}Segment', 'iri'),
    ('urn:log:s', '{LOG}level', '{LOG}debug', 'iri'), ('urn:log:s', '{PROV}wasAttributedTo', 'urn:inst:serve-9', 'iri'), ('urn:inst:serve-9', '{RDF}type', '{LOG}Instance', 'iri'), ('urn:inst:serve-9', '{LOG}configuredInstance', 'urn:inst:serve', 'iri')) AS t(s, p, o, o_kind)""")  # fmt: skip
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of two layers as a graph, with the last segment of the events as the one that is open."""
    from provlog import config

    c = config.merged(config.merged(config.Config(), {"level": "warn", "instance": "serve", "seal": {"entries": 5}}), {"level": "debug", "destination": "console", "seal": {"millis": "never"}})
    last = derived.events(spark, sf_dir).agg(F.max(F.struct("segment", "instance")).alias("s")).select("s.*").first()  # one row
    return config.graph(spark, c, segment=tuple(last)).select("s", "p", "o", "o_kind")


@register(TRACE + ", d AS (SELECT CASE WHEN event_id % 41 = 0 THEN 'write-failed' WHEN event_id % 43 = 0 THEN 'reentrant' WHEN event_id % 47 = 0 THEN 'panicked' WHEN NOT writable THEN 'unwritable' END AS reason FROM tr) SELECT '2026-01-01T00:00:00.000Z' AS time, '" + LOG + "Dropped' AS class, ' count=' || count(*) || ' reason=' || reason AS tail FROM d WHERE reason IS NOT NULL GROUP BY reason")
def drop_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that tell what was lost, one for each of the four reasons."""
    i = F.col("event_id")
    lost = F.when(i % 41 == 0, "write-failed").when(i % 43 == 0, "reentrant").when(i % 47 == 0, "panicked")
    e = mappers.trace_entries(trace_events(spark, sf_dir).withColumn("lost", lost), F.lit(NOW).cast("long"), "urn:agent:host")
    m = mappers.drop_markers(mappers.drop_ledger(e), "urn:log:s", F.lit(NOW).cast("long"))
    return m.select("time", "class", X.render_fields(F.col("fields")).alias("tail"))


def filed(lines: DataFrame, name: str) -> str:
    """A folder of the shared one with a file for each segment of lines."""
    import uuid

    from provlog.operators.writer import write_files
    from provlog.sources.tables import shared_dir

    path = f"{shared_dir(lines.sparkSession)}/files-{name}-{uuid.uuid4().hex}"
    write_files(lines, path)
    return path


@register(F1 + "SELECT segment, instance, seq AS place, line AS raw FROM f1")
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of segment files, as a stream that reads what is appended tells them."""
    from provlog.sources import ranges

    top = derived.headers(spark, sf_dir).select("segment", F.posexplode(F.split(F.regexp_replace("header", r"\n+\z", ""), "\n")).alias("at", "line"))
    body = derived.entries(spark, sf_dir).select("segment", (F.col("seq") + 100).alias("line_no"), "line")
    blank = top.groupBy("segment").agg(F.lit(50).cast("long").alias("line_no"), F.lit("").alias("line"))
    path = filed(top.select("segment", F.col("at").cast("long").alias("line_no"), "line").unionByName(blank).unionByName(body), "tail")
    rows = live.drained(ranges.tail(spark, path, ".txt").select("segment", "instance", "line_no", "raw"), "tail")
    place = F.row_number().over(W.partitionBy("segment").orderBy("line_no")).cast("long")
    return rows.select("segment", "instance", place.alias("place"), "raw")


@register(ROTATED + "SELECT segment, instance, prev, head FROM r")
def probe_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of segment files, read from their headers and last seals alone."""
    from provlog.sources import ranges

    lines = rotated(spark, sf_dir).select("segment", "line_no", "line")
    return ranges.heads(spark, filed(lines, "heads"), ".txt").select("segment", "instance", "prev", "head")


@register(TAMPERED + f"""SELECT segment, 'SealMismatch' AS kind, TRUE AS breaking, first AS a, "last" AS b, {NONE} AS c, hash AS x, head AS y FROM s4 WHERE hash <> head""")
def verify_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals that don't state their chain's head, found by folding what stands between seals by itself."""
    headers, lines = tampered(spark, sf_dir)
    return narrow(verify.interval_mismatches(written(lines, "lines"), headers))


@register(F1 + """, n AS (SELECT user_id, count(*) AS n FROM f1 GROUP BY user_id) SELECT user_id, seq, CASE user_id % 4 WHEN 0 THEN seq WHEN 1 THEN n - seq + 1
    ELSE row_number() OVER (PARTITION BY user_id ORDER BY 'urn:log:' || lpad(CAST((seq * 7919) % 10007 AS VARCHAR), 5, '0') || ':' || user_id || ':' || seq) END AS place FROM f1 JOIN n USING (user_id)""")
def rank_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each event in a chain of its user's events, whose links are shuffled against their names.

    Of every four users one has its links in order of time, one backwards, one a cycle and one a fork, whose events go by name.
    """
    e = derived.events(spark, sf_dir).select("user_id", "seq")
    u, n = F.col("user_id") % 4, F.count("*").over(W.partitionBy("user_id"))
    before = F.when(u == 1, F.col("seq") + 1).when((u == 2) & (F.col("seq") == 1), n).when((u == 3) & (F.col("seq") == 3), F.lit(1).cast("long")).otherwise(F.col("seq") - 1)
    name = F.concat(F.lit("urn:log:"), F.lpad(((F.col("seq") * 7919) % 10007).cast("string"), 5, "0"), F.lit(":"), F.col("user_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))
    first = (before == 0) | (before > n)
    rows = e.withColumns({"segment": name, "instance": F.format_string("urn:inst:u%d", "user_id"), "head": F.format_string("h%d", "seq"), "prev": F.when(first, "genesis").otherwise(F.format_string("h%d", before))})
    placed = verify.chain_order(written(rows, "links"))
    return placed.select("user_id", "seq", "place")


def keyed() -> Callable[[str], str | None]:
    """A signer for tests: a keyed hash, which refuses hashes that end in 0."""
    import hashlib

    return lambda h: None if h.endswith("0") else "keyed:" + hashlib.sha256(f"k{h}".encode()).hexdigest()


@register(SEALS + """SELECT segment, first, "last", hash, CASE WHEN hash NOT LIKE '%0' THEN 'keyed:' || sha256('k' || hash) END AS signature,
    '#seal ' || first || '-' || "last" || ' ' || hash || CASE WHEN hash NOT LIKE '%0' THEN ' keyed:' || sha256('k' || hash) ELSE '' END AS line FROM s""")
def sign_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals with what a key says of their hashes, and without where it refuses."""
    s = chain.signed(base.seals(spark, sf_dir).select("segment", "first", "last", "hash"), keyed)
    return s.withColumn("line", chain.seal_line(F.col("first"), F.col("last"), F.col("hash"), F.col("signature")))


@register(ROTATED + f"""SELECT segment AS graph, segment || ':' || i AS s, '{LOG}subject' AS p, split_part(line, ' ', 3) AS o FROM (SELECT segment, t0, t1, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM r JOIN c USING (user_id, instance))
    WHERE line[1:24] >= (SELECT min(time) FROM f1 WHERE event_id >= (SELECT max(event_id) // 2 FROM f1))""")
def cached_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of the entries since a time, of segments that were read, kept and are read again from what was kept."""
    import uuid

    from provlog import api
    from provlog.sources.tables import shared_dir

    path = filed(rotated(spark, sf_dir).select("segment", "line_no", "line"), "cached")
    store = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    e = derived.events(spark, sf_dir).select("event_id", "time")
    since = e.join(F.broadcast(e.agg(F.max("event_id").alias("m"))), F.col("event_id") >= F.floor(F.col("m") / 2)).agg(F.min("time")).first()[0]  # one row
    api.cached(spark, path, store, since)
    t = api.cached(spark, path, store, since)
    return t.where(F.col("p") == LOG + "subject").select("graph", "s", "p", "o")
