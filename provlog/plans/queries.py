"""Registered queries over segments, triples and chains, each with DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.operators import chain, triples
from provlog.plans.registry import F1, F2, register
from provlog.sources import derived
from provlog.sources.tables import written
from provlog.vocabulary import KEY, LOG, PROV, RDF, SIG, XSD, Vocabulary

ID = ["user_id", "event_id"]


def classes_of(spark: SparkSession) -> DataFrame:
    return Vocabulary.built_in().class_table(spark)


@register(F1 + "SELECT user_id, event_id, seq, line FROM f1")
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as lines."""
    return derived.entries(spark, sf_dir).select(*ID, "seq", "line")


@register(F1 + "SELECT user_id, event_id, CAST(generate_subscripts(kvs, 1) - 1 AS BIGINT) AS pos, unnest(kvs) AS token FROM f1")
def tokenize_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line after the third, without quotes."""
    e = derived.entries(spark, sf_dir)
    tail = X.bound(X.tokens(F.col("line")), lambda t: F.transform(F.slice(t, F.lit(4), F.size(t)), X.unquote))
    return e.select(*ID, F.posexplode(tail).alias("pos", "token")).select(*ID, F.col("pos").cast("long").alias("pos"), "token")


@register(F1 + f"SELECT user_id, event_id, time, '{LOG}' || name AS class, subject, seq AS seq_stated, CAST(len(kvs) AS BIGINT) AS n_fields, principal, CASE WHEN name IN ('Message', 'Error') THEN 'event ' || event_id END AS msg FROM f1")
def parse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parsed back to columns."""
    p, f = derived.parsed(spark, sf_dir), F.col("fields")
    return p.select(*ID, "time", "class", "subject", X.stated_sequence(f).cast("long").alias("seq_stated"), F.size("fields").cast("long").alias("n_fields"), X.first_value(f, "principal").alias("principal"), X.first_value(f, "msg").alias("msg"))


QUOTED = r"""CASE WHEN text <> '' AND NOT regexp_matches(text, '["\\\s]') THEN text ELSE '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' END"""


@register(f"SELECT doc_id, {QUOTED} AS quoted FROM documents")
def quote_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as values of a line."""
    return derived.table(spark, sf_dir, "documents").select("doc_id", X.render_value(F.col("text")).alias("quoted"))


@register("SELECT doc_id, sha256(text) AS text_hash, CAST(1 AS BIGINT) AS n_tokens, TRUE AS scannable FROM documents")
def quote_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts quoted, scanned and unquoted are themselves."""
    d = derived.table(spark, sf_dir, "documents").withColumn("q", X.render_value(F.col("text"))).withColumn("t", X.tokens(F.col("q")))
    return d.select("doc_id", F.sha2(X.unquote(F.get("t", 0)), 256).alias("text_hash"), F.size("t").cast("long").alias("n_tokens"), X.is_scannable(F.col("q")).alias("scannable"))


@register(F1 + "SELECT user_id, seq, 'entry' AS kind FROM f1 UNION ALL SELECT user_id, seq, ['blank', 'comment', 'directive', 'seal', 'seal'][CAST(seq % 5 AS INT) + 1] FROM f1")
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of lines, by their beginning."""
    e = derived.entries(spark, sf_dir).select("user_id", "seq", "line")
    odd = F.element_at(F.array(*[F.lit(x) for x in ("  ", "# a note", "@name x", "#seal 1-2 x", "#sealx")]), (F.col("seq") % 5 + 1).cast("int"))
    both = e.unionByName(e.withColumn("line", odd))
    return both.select("user_id", "seq", X.line_kind(F.col("line")).alias("kind"))


@register(F2 + "SELECT user_id, segment, instance, level, started, header, 'sha256:' || sha256(header) AS h0 FROM f2")
def render_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical headers and the hash that a chain starts from."""
    return derived.headers(spark, sf_dir).select("user_id", "segment", "instance", "level", "started", "header", "h0")


@register(F2 + f"SELECT user_id, segment AS name, instance, '{LOG}' || level AS level, started, 'genesis' AS prev, CAST(2 AS BIGINT) AS prefixes, CAST(1 AS BIGINT) AS version FROM f2")
def parse_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers parsed back from their text."""
    from provlog.sources.segments import parse_header

    h = derived.headers(spark, sf_dir).select("user_id", parse_header(F.col("header")).alias("h"))
    return h.select("user_id", "h.name", "h.instance", "h.level", "h.started", "h.prev", F.size("h.prefixes").cast("long").alias("prefixes"), F.col("h.version").cast("long").alias("version"))


@register(
    r"""SELECT page_id, url, contains(url, ':') AND NOT regexp_matches(url, '[<>"\s]') AS is_iri, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(url, '[<>"{}|\\^`\s]') AND NOT regexp_matches(regexp_replace(url, '%[0-9A-Fa-f]{2}', '', 'g'), '%') AS is_rdf_iri
    FROM (SELECT page_id, url FROM pages UNION ALL SELECT -page_id - 1, ['no colon', 'urn:x:{a}', 'urn:x:a b', 'urn:x:%zz'][CAST(page_id % 4 AS INT) + 1] FROM pages)"""
)
def iri_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar's loose IRI test and RDF's strict one."""
    p = derived.table(spark, sf_dir, "pages").select("page_id", "url")
    odd = F.element_at(F.array(*[F.lit(x) for x in ("no colon", "urn:x:{a}", "urn:x:a b", "urn:x:%zz")]), (F.col("page_id") % 4 + 1).cast("int"))
    both = p.unionByName(p.select((-F.col("page_id") - 1).alias("page_id"), odd.alias("url")))
    return both.select("page_id", "url", X.is_iri(F.col("url")).alias("is_iri"), X.is_rdf_iri(F.col("url")).alias("is_rdf_iri"))


@register(F1 + "SELECT event_id, time, TRUE AS valid, ms FROM f1 UNION ALL SELECT -event_id - 1, ['2024-02-30T00:00:00.000Z', '2024-13-01T00:00:00.000Z', '2024-01-01T24:00:00.000Z', '2024-01-01T00:00:00Z', '2024-01-01T00:00:00.000+01:00'][CAST(event_id % 5 AS INT) + 1], FALSE, NULL FROM f1")
def timestamp_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real calendar times of 24 characters, and near misses."""
    e = derived.events(spark, sf_dir).select("event_id", "time")
    bad = ("2024-02-30T00:00:00.000Z", "2024-13-01T00:00:00.000Z", "2024-01-01T24:00:00.000Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.000+01:00")
    odd = F.element_at(F.array(*[F.lit(x) for x in bad]), (F.col("event_id") % 5 + 1).cast("int"))
    both = e.unionByName(e.select((-F.col("event_id") - 1).alias("event_id"), odd.alias("time")))
    return both.select("event_id", "time", X.is_time(F.col("time")).alias("valid"), X.time_millis(F.col("time")).alias("ms"))


@register(F1 + "SELECT user_id, event_id, time, seq FROM f1 WHERE time BETWEEN (SELECT min(time) FROM f1 WHERE event_id >= (SELECT max(event_id) // 2 FROM f1)) AND (SELECT max(time) FROM f1)")
def window_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time window, judged on the line's first 24 characters before it is parsed."""
    e = derived.entries(spark, sf_dir)
    bounds = e.agg(F.max("event_id").alias("m"), F.max("time").alias("until"))
    since = e.join(F.broadcast(bounds), F.col("event_id") >= F.floor(F.col("m") / 2)).agg(F.min("time").alias("since"), F.max("until").alias("until")).first()
    kept = e.where(F.substring("line", 1, 24).between(since["since"], since["until"])) if since["since"] else e.limit(0)
    p = kept.withColumn("e", X.parse_entry(F.col("line"), derived.prefixes()))
    return p.select(*ID, "e.time", X.stated_sequence(F.col("e.fields")).cast("long").alias("seq"))


@register(F1 + "SELECT user_id, event_id, seq FROM f1 WHERE seq BETWEEN 10 AND 20")
def window_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of stated sequence numbers, both ends in."""
    p = derived.parsed(spark, sf_dir).withColumn("seq", X.stated_sequence(F.col("fields")).cast("long"))
    return p.where(F.col("seq").between(10, 20)).select(*ID, "seq")


RANKS = "CASE name WHEN 'Resolution' THEN 3 WHEN 'CacheHit' THEN 4 WHEN 'Access' THEN 2 WHEN 'Message' THEN 2 ELSE 0 END"


@register(F1 + f"SELECT user_id, event_id, name FROM f1 WHERE {RANKS} <= user_id % 5")
def level_dial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that each segment's level lets through."""
    classes = classes_of(spark)
    e = derived.entries(spark, sf_dir).select(*ID, "name", "class")
    rank = F.col("user_id") % 5  # error, warn, info, debug, trace
    return e.join(F.broadcast(classes), "class", "left").where(F.coalesce(F.col("least_rank") <= rank, F.lit(True))).select(*ID, "name")


def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class with all it is a kind of, and how many entries of the events are of it."""
    entries = derived.events(spark, sf_dir).groupBy(F.concat(F.lit(LOG), "name").alias("class")).agg(F.count("*").alias("entries"))
    closure = F.broadcast(Vocabulary.built_in().closure_table(spark))  # as large as the vocabulary
    return entries.join(closure, "class", "right").select("class", "ancestor", "distance", F.coalesce("entries", F.lit(0)).alias("entries"))


def _closure_sql() -> str:
    rows = ", ".join(f"('{c}', '{p}')" for c, ps in Vocabulary.built_in().parents.items() for p in ps)
    return F1.replace("WITH ", "WITH RECURSIVE ", 1) + f""", n AS (SELECT '{LOG}' || name AS class, count(*) AS entries FROM f1 GROUP BY ALL), up(class, parent) AS (VALUES {rows}), walk(class, ancestor, distance) AS (
        SELECT class, class, CAST(0 AS BIGINT) FROM up UNION SELECT w.class, u.parent, w.distance + 1 FROM walk w JOIN up u ON u.class = w.ancestor)
        SELECT class, ancestor, distance, coalesce(entries, 0) AS entries FROM walk LEFT JOIN n USING (class)"""


register(_closure_sql())(class_closure)

T3 = "graph, s, p, o, o_kind, o_type"


@register(F2 + f"""SELECT segment AS graph, unnest([segment, segment, segment, segment, segment, instance, instance]) AS s,
    unnest(['{RDF}type', '{LOG}level', '{PROV}startedAtTime', '{PROV}wasAttributedTo', '{LOG}prevSeal', '{RDF}type', '{RDF}type']) AS p,
    unnest(['{LOG}Segment', '{LOG}' || level, started, instance, 'genesis', '{LOG}Instance', '{PROV}SoftwareAgent']) AS o,
    unnest(['iri', 'iri', 'literal', 'iri', 'literal', 'iri', 'iri']) AS o_kind, unnest([NULL, NULL, '{XSD}dateTime', NULL, '{XSD}string', NULL, NULL]) AS o_type FROM f2""")  # fmt: skip
def triples_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment and instance nodes."""
    return triples.of_header(derived.headers(spark, sf_dir))


@register(F1 + f"""SELECT segment AS graph, segment || ':' || seq AS s, unnest(['{RDF}type', '{LOG}segment', '{PROV}startedAtTime', '{PROV}wasAssociatedWith', '{LOG}subject']) AS p,
    unnest(['{LOG}' || name, segment, time, instance, subject]) AS o, unnest(['iri', 'iri', 'literal', 'iri', 'iri']) AS o_kind, unnest([NULL, NULL, '{XSD}dateTime', NULL, NULL]) AS o_type FROM f1
    UNION ALL SELECT segment, segment || ':' || seq, CASE name WHEN 'Access' THEN '{LOG}requested' ELSE '{LOG}resolved' END, subject, 'iri', NULL FROM f1 WHERE name IN ('Access', 'Resolution', 'CacheHit')""")  # fmt: skip
def triples_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, segment, time, instance and subject of each entry."""
    classes = classes_of(spark)
    return triples.core(derived.parsed(spark, sf_dir), classes)


DECLARED = f"""(VALUES ('seq', '{LOG}sequence', '{XSD}integer'), ('principal', '{LOG}onBehalfOf', NULL), ('span', '{LOG}span', '{XSD}integer'), ('parent', '{LOG}parentSpan', '{XSD}integer'),
    ('dur', '{LOG}durationMs', '{XSD}integer'), ('cap', '{LOG}capability', NULL), ('msg', '{LOG}text', '{XSD}string')) AS k(key, p, o_type)"""


@register(F1 + f"""SELECT segment AS graph, segment || ':' || seq AS s, k.p, value AS o, CASE WHEN k.o_type IS NULL AND contains(value, ':') THEN 'iri' ELSE 'literal' END AS o_kind,
    CASE WHEN k.o_type IS NULL AND NOT contains(value, ':') THEN '{XSD}string' ELSE k.o_type END AS o_type
    FROM (SELECT segment, seq, split_part(kv, '=', 1) AS key, substr(kv, strpos(kv, '=') + 1) AS value FROM (SELECT segment, seq, unnest(kvs) AS kv FROM f1)) JOIN {DECLARED} USING (key)""")  # fmt: skip
def triples_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose keys the vocabulary binds."""
    return triples.declared(derived.parsed(spark, sf_dir), Vocabulary.built_in())


@register(F1 + f"SELECT segment AS graph, segment || ':' || seq AS s, unnest(['{KEY}k', '{LOG}undeclaredKey']) AS p, unnest([CAST(k AS VARCHAR), 'k']) AS o, 'literal' AS o_kind, '{XSD}string' AS o_type FROM f1 WHERE k IS NOT NULL")
def triples_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no property claims, flagged."""
    return triples.undeclared(derived.parsed(spark, sf_dir), Vocabulary.built_in())


@register(F1 + f"""SELECT segment AS graph, unnest([instance, d, d, d]) AS s, unnest(['{PROV}qualifiedDelegation', '{RDF}type', '{PROV}agent', '{PROV}hadActivity']) AS p,
    unnest([d, '{PROV}Delegation', principal, id]) AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_type FROM (SELECT *, segment || ':' || seq AS id, segment || ':' || seq || ':delegation' AS d FROM f1 WHERE principal <> 'anon')
    UNION ALL SELECT segment, unnest([principal, instance]), unnest(['{RDF}type', '{PROV}actedOnBehalfOf']), unnest(['{PROV}Agent', principal]), 'iri', NULL FROM (SELECT DISTINCT segment, instance, principal FROM f1 WHERE principal <> 'anon')""")  # fmt: skip
def triples_delegation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who acted for whom."""
    return triples.delegation(derived.parsed(spark, sf_dir))


def runs_and_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose spans repeat within and across process runs."""
    e = derived.entries(spark, sf_dir).select("user_id", "segment", "seq")
    span = (F.col("seq") - 1) % 10 + 1
    parent = F.when(F.col("seq") % 37 == 0, span).otherwise(F.when(span > 1, span - 1))
    name = F.when(F.col("seq") % 20 == 1, "ProcessStart").otherwise("Resolution")
    return e.select("user_id", "segment", F.col("seq").alias("line_no"), F.concat(F.lit(LOG), name).alias("class"), derived.present(derived.kv("seq", F.col("seq")), derived.kv("span", span), derived.kv("parent", parent)).alias("fields"))


F4 = F1 + ", f4 AS (SELECT user_id, segment, seq, (seq - 1) % 10 + 1 AS span, CASE WHEN seq % 37 = 0 THEN (seq - 1) % 10 + 1 WHEN (seq - 1) % 10 > 0 THEN (seq - 1) % 10 END AS parent, (seq - 1) // 20 AS run FROM f1) "


@register(F4 + f"""SELECT c.segment AS graph, c.segment || ':' || p.seq AS s, '{LOG}invoked' AS p, c.segment || ':' || c.seq AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_type
    FROM f4 c JOIN (SELECT segment, run, span, max(seq) AS seq FROM f4 GROUP BY ALL) p ON p.segment = c.segment AND p.run = c.run AND p.span = c.parent WHERE p.seq <> c.seq""")  # fmt: skip
def span_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-tree edges within a process run."""
    return triples.invoked(runs_and_spans(spark, sf_dir))


@register(F4 + "SELECT user_id, seq, run FROM f4")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process run of each entry."""
    return triples.runs(runs_and_spans(spark, sf_dir)).select("user_id", F.col("line_no").alias("seq"), "run")


@register(F1 + f"SELECT segment AS graph, segment || ':' || seq AS s, '{LOG}resolved' AS p, '{LOG}Resolution' AS domain FROM f1 WHERE name = 'Access'")
def family_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates used on subjects outside their domain: accesses that also state what they resolved."""
    classes = classes_of(spark)
    e = derived.parsed(spark, sf_dir)
    wrong = triples.core(e.where(F.col("class") == LOG + "Access"), classes).where(F.col("p") == LOG + "requested").withColumn("p", F.lit(LOG + "resolved"))
    every = triples.core(e, classes).unionByName(wrong)
    domains = spark.createDataFrame([(LOG + "resolved", LOG + "Resolution"), (LOG + "requested", LOG + "Access"), (LOG + "subject", LOG + "Entry")], "p string, domain string")
    return triples.family_traps(every, domains, Vocabulary.built_in().closure_table(spark)).select("graph", "s", "p", "domain").distinct()


HEADS = F2 + ", h AS (SELECT segment, 'sha256:' || sha256(header) AS h0 FROM f2) "
FOLD = "list_reduce({list}, lambda a, x: 'sha256:' || sha256(a || chr(10) || x), {init})"


@register(HEADS + ", l AS (SELECT segment, list(line ORDER BY seq) AS lines FROM f1 GROUP BY segment) SELECT segment, " + FOLD.format(list="lines", init="h0") + " AS head, CAST(len(lines) AS BIGINT) AS entries FROM l JOIN h USING (segment)")
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash chain of each segment, folded to its head."""
    lines = derived.entries(spark, sf_dir).select("segment", F.col("seq").alias("line_no"), "line")
    return chain.heads(lines, derived.headers(spark, sf_dir))


EVERY, MILLIS = 5, 6 * 3600 * 1000
F3 = HEADS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", w AS (SELECT user_id, segment, seq, ms, CAST(0 AS BIGINT) AS sealed, ms AS since, CAST(0 AS BIGINT) AS first, FALSE AS due FROM (SELECT * FROM f1 WHERE seq = 1)
    UNION ALL SELECT n.user_id, n.segment, n.seq, n.ms, CASE WHEN w.due THEN w.seq ELSE w.sealed END, CASE WHEN w.due THEN w.ms ELSE w.since END, CASE WHEN w.due THEN w.seq ELSE w.sealed END + 1,
        n.seq - CASE WHEN w.due THEN w.seq ELSE w.sealed END >= {EVERY} OR n.ms - CASE WHEN w.due THEN w.ms ELSE w.since END >= {MILLIS} FROM w JOIN f1 n ON n.segment = w.segment AND n.seq = w.seq + 1),
    points AS (SELECT segment, first, seq AS "last" FROM w WHERE due) """  # fmt: skip


def seal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.seal_points(derived.events(spark, sf_dir).select("segment", F.col("seq").alias("line_no"), "ms"), EVERY, MILLIS)


@register(F3 + 'SELECT segment, first, "last" FROM points')
def seal_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where seals fall due: after five entries or six hours."""
    return seal_points(spark, sf_dir)


def seals(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """segment, first, last, hash, signature and seal's line; some signed, some with an untagged signature.  e: the entries, where they are there already."""
    e = derived.entries(spark, sf_dir) if e is None else e
    s = chain.sealed(e.select("segment", F.col("seq").alias("line_no"), "line"), derived.headers(spark, sf_dir), seal_points(spark, sf_dir))
    user = F.regexp_extract("segment", r"u(\d+)", 1).cast("long")
    sign = F.when(user % 3 == 0, F.concat(F.lit("Ed25519:SIG"), F.right("hash", F.lit(8)))).when(user % 10 == 7, "legacy")
    return s.withColumn("signature", sign).withColumn("line", chain.seal_line(F.col("first"), F.col("last"), F.col("hash"), F.col("signature")))


SEALS = F3 + """, l AS (SELECT segment, list(line ORDER BY seq) AS lines FROM f1 GROUP BY segment), s AS (SELECT segment, CAST(regexp_extract(segment, 'u([0-9]+)', 1) AS BIGINT) AS u, first, "last", """ + FOLD.format(list='lines[1:"last"]', init="h0") + """ AS hash
    FROM points JOIN l USING (segment) JOIN h USING (segment)), f3 AS (SELECT segment, first, "last", hash, CASE WHEN u % 3 = 0 THEN 'Ed25519:SIG' || right(hash, 8) WHEN u % 10 = 7 THEN 'legacy' END AS signature FROM s) """  # fmt: skip


@register(SEALS + """SELECT segment, first, "last", '#seal ' || first || '-' || "last" || ' ' || hash || coalesce(' ' || signature, '') AS line FROM f3""")
def seal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals with the chain's head at their place."""
    return seals(spark, sf_dir).select("segment", "first", "last", "line")


SIGNED = """CASE WHEN contains(signature, ':') THEN split_part(signature, ':', 1) END AS sig_alg, CASE WHEN contains(signature, ':') THEN split_part(signature, ':', 2) ELSE signature END AS sig_value"""


@register(SEALS + f"""SELECT segment, first, "last", hash, signature, {SIGNED} FROM f3""")
def parse_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals parsed back from their lines."""
    return seals(spark, sf_dir).select("segment", X.parse_seal(F.col("line")).alias("s")).select("segment", F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last"), "s.hash", "s.signature", "s.sig_alg", "s.sig_value")


@register(SEALS + f""", n AS (SELECT *, segment || ':seal:' || first || '-' || "last" AS s, {SIGNED} FROM f3), t AS (SELECT segment AS graph, s, unnest(['{RDF}type', '{LOG}segment', '{LOG}first', '{LOG}last', '{SIG}contentHash', '{SIG}algorithm', '{SIG}value']) AS p,
    unnest(['{LOG}Seal', segment, CAST(first AS VARCHAR), CAST("last" AS VARCHAR), hash, sig_alg, sig_value]) AS o, unnest(['iri', 'iri', 'literal', 'literal', 'literal', 'literal', 'literal']) AS o_kind,
    unnest([NULL, NULL, '{XSD}integer', '{XSD}integer', '{XSD}string', '{XSD}string', '{XSD}string']) AS o_type FROM n) SELECT * FROM t WHERE o IS NOT NULL""")  # fmt: skip
def triples_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seal nodes."""
    return triples.of_seals(seals(spark, sf_dir).select("segment", X.parse_seal(F.col("line")).alias("s")).select("segment", "s.*"))


@register(F1 + "SELECT segment, count(*) AS entries, count(*) FILTER (WHERE name = 'Message') AS messages, count(*) FILTER (WHERE name = 'Message') / count(*) AS ratio FROM f1 GROUP BY segment")
def unstructured_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of entries that are prose only."""
    message = F.count_if(F.col("class") == LOG + "Message")
    return derived.parsed(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("entries"), message.alias("messages"), (message / F.count("*")).alias("ratio"))


@register(F1 + "SELECT segment, 'k' AS key, count(*) AS entries FROM f1 WHERE k IS NOT NULL GROUP BY segment")
def undeclared_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each segment uses keys that no property claims."""
    t = triples.undeclared(derived.parsed(spark, sf_dir), Vocabulary.built_in()).where(F.col("p") == LOG + "undeclaredKey")
    return t.groupBy(F.col("graph").alias("segment"), F.col("o").alias("key")).agg(F.count("*").alias("entries"))


@register(F1 + "SELECT principal, count(*) AS entries, count(DISTINCT segment) AS segments, min(time) AS first_time, max(time) AS last_time FROM f1 WHERE principal <> 'anon' GROUP BY principal")
def principal_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each principal did across all segments."""
    p = derived.parsed(spark, sf_dir).withColumn("principal", X.first_value(F.col("fields"), "principal")).where("principal != 'anon'")
    return p.groupBy("principal").agg(F.count("*").alias("entries"), F.countDistinct("segment").alias("segments"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@register(f"""SELECT '{LOG}' || CASE WHEN l_linestatus = 'O' THEN 'Access' ELSE 'Resolution' END AS class, l_suppkey AS supplier, count(*) AS entries, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS total
    FROM lineitem GROUP BY ALL""")  # fmt: skip
def lines_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as lines, scanned and counted: the grammar's throughput."""
    li = derived.table(spark, sf_dir, "lineitem")
    time = X.time_string(F.unix_millis(F.col("l_shipdate").cast("timestamp")))
    fields = F.array(derived.kv("supplier", F.col("l_suppkey")), derived.kv("dur", F.floor("l_quantity")), derived.kv("flag", F.concat("l_returnflag", F.lit(" "), "l_linestatus")))
    name = F.when(F.col("l_linestatus") == "O", "log:Access").otherwise("log:Resolution")
    lines = li.select(X.render_entry(time, name, F.format_string("urn:order:%d:%d", "l_orderkey", "l_linenumber"), fields).alias("line"))
    p = lines.select(X.parse_entry(F.col("line"), derived.prefixes()).alias("e"))
    f = F.col("e.fields")
    return p.groupBy(F.col("e.class").alias("class"), X.first_value(f, "supplier").cast("long").alias("supplier")).agg(F.count("*").alias("entries"), F.sum(X.first_value(f, "dur").cast("long")).alias("total"))


HEADER_ODD = """WITH h AS (SELECT page_id, page_id % 9 AS k FROM pages) SELECT page_id, k IN (0, 1, 2, 3, 4) AS good,
    CASE k WHEN 5 THEN 'missing level' WHEN 6 THEN 'unknown directive' WHEN 7 THEN 'version' WHEN 8 THEN 'not a header line' END AS error,
    CASE WHEN k IN (5, 6, 7, 8) THEN NULL WHEN k = 3 THEN 'urn:log:again' ELSE 'urn:log:p' || page_id END AS name,
    CASE WHEN k IN (5, 6, 7, 8) THEN NULL WHEN k = 4 THEN 'urn:other#info' ELSE '{log}info' END AS level, CAST(CASE k WHEN 4 THEN 406 WHEN 1 THEN 7 WHEN 3 THEN 9 WHEN 5 THEN 6 WHEN 6 THEN 8 WHEN 8 THEN 8 ELSE 7 END AS BIGINT) AS lines FROM h"""


@register(HEADER_ODD.replace("{log}", LOG))
def parse_headers_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written by hand: Windows line ends, a blank line with blanks, tabs, repeated directives, 400 prefixes, and damaged ones."""
    from provlog.sources.segments import parse_header
    from provlog.vocabulary import MAGIC

    p = derived.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 9).alias("k"))
    name, level = F.concat(F.lit("@name urn:log:p"), F.col("page_id").cast("string")), F.lit("@level log:info")
    plain = [F.lit(MAGIC), F.lit(f"@prefix log: <{LOG}> ."), name, F.lit("@instance urn:inst:i"), level, F.lit("@started 2024-01-01T00:00:00.000Z"), F.lit("@prev genesis")]
    many = [F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("@prefix p"), i.cast("string"), F.lit(": <urn:other#> ."))), "\n")]
    text = lambda lines, end="\n", blank="": F.concat(F.concat_ws(end, *lines), F.lit(end + blank + end + "2024-01-01T00:00:00.000Z log:Message urn:x:y" + end))
    forms = [
        text(plain), text(plain, "\r\n"), text([plain[0], *[F.regexp_replace(c, "^(@[a-z]+) ", "$1\t") for c in plain[1:]]], blank=" \u00a0\t"),
        text([*plain[:2], F.lit("# a comment"), F.lit("@name urn:log:first"), *plain[3:], F.lit("@name urn:log:again")]), text([*plain[:1], *many, *plain[2:4], F.lit("@level p400:info"), *plain[5:]]),
        text([c for c in plain if c is not level]), text([*plain, F.lit("@colour red")]), text([F.lit(MAGIC + "9"), *plain[1:]]), text([*plain, F.lit("what is this")]),
    ]
    chosen = F.element_at(F.array(*forms), (F.col("k") + 1).cast("int"))
    h = p.select("page_id", parse_header(chosen).alias("h"))
    good = F.col("h.error").isNull()
    return h.select("page_id", good.alias("good"), F.col("h.error").alias("error"), F.when(good, F.col("h.name")).alias("name"), F.when(good, F.col("h.level")).alias("level"), F.col("h.lines").alias("lines"))


def unsequenced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of segments whose entries state no sequence, with comments, seals and blank lines between them."""
    e = derived.entries(spark, sf_dir).select("segment", "instance", "seq", "name", "time", "subject")
    class_ = F.when(F.col("seq") % 50 == 1, F.lit("log:Started")).otherwise(F.concat(F.lit("log:"), "name"))
    line = F.concat("time", F.lit(" "), class_, F.lit(" "), "subject", F.when(F.col("seq") % 4 == 0, F.lit(" seq=18446744073709551615")).when(F.col("seq") % 4 == 1, F.lit(" seq=x")).otherwise(""))
    odd = F.element_at(F.array(*[F.lit(x) for x in ("# a note", "", "#seal 1-2 sha256:0", "  ")]), (F.col("seq") % 4 + 1).cast("int"))
    both = F.array(*[F.struct((F.col("seq") * 2 + at).alias("line_no"), raw.alias("raw")) for at, raw in ((10, line), (11, odd))])
    rows = e.select("segment", F.inline(both))  # one pass gives both
    lines = rows.select("segment", "line_no", "raw", X.line_kind(F.col("raw")).alias("kind"), derived.prefixes().alias("prefixes"))
    return e.select("segment", "instance").distinct(), lines


@register(F1 + f"""SELECT segment AS graph, segment || ':' || CASE WHEN seq % 4 = 0 THEN '18446744073709551615' ELSE CAST(seq AS VARCHAR) END AS s, '{RDF}type' AS p, '{LOG}' || CASE WHEN seq % 50 = 1 THEN 'Started' ELSE name END AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_type
    FROM f1 WHERE time >= '2024-01-10T00:00:00.000Z'""")  # fmt: skip
def triples_unsequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of entries that are named by their ordinal, which a time window doesn't move."""
    from provlog import api

    headers, lines = unsequenced(spark, sf_dir)
    e = api.read_entries(lines, headers, since="2024-01-10T00:00:00.000Z")[0]
    return triples.core(e, classes_of(spark)).where(F.col("p") == RDF + "type")


@register(F1 + "SELECT segment, seq, greatest((seq - 1) // 50, 0) AS run FROM f1")
def run_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process runs, where the start is of a class that an extension of the vocabulary declares."""
    from provlog import api

    headers, lines = unsequenced(spark, sf_dir)
    v = Vocabulary.built_in().extend(f"@prefix log: <{LOG}> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\nlog:Started rdfs:subClassOf log:ProcessStart .\n")
    e = api.read_entries(lines, headers)[0]
    return triples.runs(e, v.below(LOG + "ProcessStart")).select("segment", F.col("ordinal").alias("seq"), "run")


@register(F1 + "SELECT segment, seq * 2 + 10 AS line_no, 'no entry' AS error FROM f1 WHERE seq % 10 = 3 UNION ALL SELECT segment, seq * 2 + 11, CASE seq % 2 WHEN 0 THEN 'directive after the header' ELSE 'no seal' END FROM f1 WHERE seq % 10 IN (4, 5)")
def unreadable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at which a segment can't be read further."""
    from provlog import api

    headers, lines = unsequenced(spark, sf_dir)
    n = F.col("line_no") % 20  # entries stand at 2 seq + 10, what is between them at 2 seq + 11
    lines = lines.withColumn("raw", F.when(n == 16, "not an entry").when(n == 19, "@name x").when(n == 1, "#sealed 1-2").otherwise(F.col("raw")))
    lines = lines.withColumn("kind", X.line_kind(F.col("raw")))
    return api.read_entries(lines, headers)[2].select("segment", "line_no", "error")


@register(F1 + f"""SELECT segment AS graph, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, 'sha256:' || sha256(string_agg(line, chr(10) ORDER BY n) || chr(10)) AS hash FROM (
    SELECT segment, n, ['@prefix log: <{LOG}> .', '@prefix prov: <{PROV}> .', '@prefix sig: <{SIG}> .', '@prefix xsd: <{XSD}> .'][n] AS line FROM (SELECT DISTINCT segment FROM f1), (SELECT unnest([1, 2, 3, 4]) AS n)
    UNION ALL SELECT segment, 100 + 10 * seq + j, '<' || segment || ':' || seq || '> ' || ['a log:' || name, 'log:segment <' || segment || '>', 'prov:startedAtTime "' || time || '"^^xsd:dateTime', 'prov:wasAssociatedWith <' || instance || '>', 'log:subject <' || subject || '>'][j] || ' .' FROM f1, (SELECT unnest([1, 2, 3, 4, 5]) AS j)
    UNION ALL SELECT segment, 106 + 10 * seq, '<' || segment || ':' || seq || '> log:' || CASE name WHEN 'Access' THEN 'requested' ELSE 'resolved' END || ' <' || subject || '> .' FROM f1 WHERE name IN ('Access', 'Resolution', 'CacheHit')) GROUP BY segment""")  # fmt: skip
def turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and hash of each segment's entries as a document, in the order of its lines."""
    e = derived.parsed(spark, sf_dir).withColumn("at", F.lpad(F.col("line_no").cast("string"), 20, "0"))
    t = triples.core(e, classes_of(spark)).withColumn("part", F.lit(1))
    return triples.digests(triples.turtle(t))


@register(F1 + "SELECT CAST(0 AS BIGINT) AS terms FROM f1 LIMIT 1")
def terms_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of the vocabulary's namespace triples use that it doesn't declare: none."""
    v = Vocabulary.built_in()
    t = triples.all_triples(derived.headers(spark, sf_dir), derived.parsed(spark, sf_dir), None, v)
    return triples.undeclared_terms(t, v).agg(F.count("*").alias("terms"))


@register(F1 + """, g AS (SELECT DISTINCT principal, segment, name FROM f1 WHERE principal <> 'anon' AND name IN ('Error', 'Access')), e AS (SELECT principal, segment FROM g WHERE name = 'Error'), a AS (SELECT principal, segment FROM g WHERE name = 'Access')
    SELECT e.principal, e.segment AS graph, count(*) AS others FROM e JOIN a ON a.principal = e.principal AND a.segment <> e.segment GROUP BY ALL""")  # fmt: skip
def cross_graph_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each principal and graph in which it met an error, in how many other graphs it was served."""
    v = Vocabulary.built_in()
    e = derived.parsed(spark, sf_dir).where(F.col("class").isin(LOG + "Error", LOG + "Access"))  # all that is asked for below
    e = written(e, "parsed")  # types and principals both read it
    t = triples.core(e, v.class_table(spark)).where(F.col("p") == RDF + "type").unionByName(triples.declared(e, v).where((F.col("p") == LOG + "onBehalfOf") & (F.col("o_kind") == "iri")))
    # One row for each principal, graph and class: what is joined are these, not entries.
    of = t.groupBy("graph", "s").agg(F.max(F.when(F.col("p") == RDF + "type", F.col("o"))).alias("class"), F.max(F.when(F.col("p") != RDF + "type", F.col("o"))).alias("principal"))
    g = of.where("principal is not null").select("principal", "graph", "class").distinct()
    errors = g.where(F.col("class") == LOG + "Error").select("principal", "graph")
    served = g.where(F.col("class") == LOG + "Access").groupBy("principal").agg(F.count("*").alias("n"))
    both = g.where(F.col("class") == LOG + "Access").select("principal", "graph", F.lit(1).alias("own"))
    each = errors.join(served, "principal").join(both, ["principal", "graph"], "left").withColumn("others", F.col("n") - F.coalesce("own", F.lit(0)))
    return each.where("others > 0").select("principal", "graph", "others")


# Fixed values of the test: names of arguments, some of which are withheld.
NAMES = ["content", "my_token", "Pass-Word", "contents", "body", "somebody", "q", "cookie_jar", "SESSION", "page", "form"]


@register(f"SELECT page_id, name, name IN ('content', 'my_token', 'Pass-Word', 'body', 'cookie_jar', 'SESSION', 'form') AS withheld FROM (SELECT page_id, {NAMES!r}[CAST(page_id % {len(NAMES)} AS INT) + 1] AS name FROM pages)")
def withheld_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arguments of requests are never written."""
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("page_id") % len(NAMES) + 1).cast("int"))
    return derived.table(spark, sf_dir, "pages").select("page_id", name.alias("name"), X.is_withheld(name).alias("withheld"))


@register(f"""SELECT page_id, CASE WHEN k = 0 THEN '<urn:log:x>' WHEN k = 1 THEN 'log:Message' WHEN k = 2 THEN 'long:b' ELSE '<{LOG}a/b>' END AS curie FROM (SELECT page_id, page_id % 4 AS k FROM pages)""")
def shorten_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRIs by the longest prefix that leaves a plain name."""
    bound = F.create_map(F.lit("log"), F.lit(LOG), F.lit("long"), F.lit(LOG + "a-"))
    iri = F.element_at(F.array(F.lit("urn:log:x"), F.lit(LOG + "Message"), F.lit(LOG + "a-b"), F.lit(LOG + "a/b")), (F.col("page_id") % 4 + 1).cast("int"))
    return derived.table(spark, sf_dir, "pages").select("page_id", X.shorten(iri, bound).alias("curie"))


@register(r"""SELECT doc_id, replace(replace(replace(text, chr(10), '\u{a}'), chr(13), '\u{d}'), chr(9), '\u{9}') AS shown FROM documents""")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as reports show them, on one printable line."""
    return derived.table(spark, sf_dir, "documents").select("doc_id", X.shown(F.col("text")).alias("shown"))
