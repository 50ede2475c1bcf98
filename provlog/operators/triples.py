"""Entries, headers and seals as PROV-O aligned triples (graph, s, p, o, o_kind, o_type).

What an entry says is one array, a set within the entry, that is exploded in place: making
triples of entries shuffles nothing.  Only what needs other entries (call-tree edges, agents of
a segment) does.  Where a table has a column at, triples keep the place of their line, by which
a document is put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.sources.tables import written
from provlog.vocabulary import KEY, LOG, PROV, RDF, SIG, XSD, Vocabulary

TYPE = RDF + "type"
TRIPLE = "struct<s: string, p: string, o: string, o_kind: string, o_type: string>"
COLUMNS = ["graph", "s", "p", "o", "o_kind", "o_type"]


def triple(s: Column, p: Column | str, o: Column, kind: Column | str = "iri", type_: Column | str | None = None) -> Column:
    """A statement; a predicate that is no IRI degrades to one that says so."""
    as_col = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    predicate = F.lit(p) if isinstance(p, str) else F.when(X.is_rdf_iri(p), p).otherwise(LOG + "undeclaredKey")
    return F.struct(s.alias("s"), predicate.alias("p"), o.cast("string").alias("o"), as_col(kind).alias("o_kind"), as_col(type_).cast("string").alias("o_type")).cast(TRIPLE)


def array(*triples: Column) -> Column:
    """Those that aren't null, each once."""
    return F.array_distinct(F.filter(F.array(*triples), lambda t: t.isNotNull()))


def exploded(rows: DataFrame, triples: Column) -> DataFrame:
    """One row for each triple; rows must have a column graph."""
    if "at" in rows.columns:
        return rows.select("graph", "at", F.posexplode(triples).alias("pos", "t")).select("graph", "at", "pos", "t.*")
    return rows.select("graph", F.explode(triples).alias("t")).select("graph", "t.*")


def ordinals(lines: DataFrame) -> DataFrame:
    """Lines with ordinal: the number of each entry in its segment, whatever is left out later."""
    order = W.partitionBy("segment").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("ordinal", F.sum((F.col("kind") == "entry").cast("long")).over(order))


def node(rows: DataFrame) -> DataFrame:
    """rows with graph, and id: the entry's IRI, by the sequence it states, else by its ordinal (line_no where there is none)."""
    seq = F.coalesce(X.stated_sequence(F.col("fields")).cast("string"), F.col("ordinal" if "ordinal" in rows.columns else "line_no").cast("string"))
    return X.once(rows.withColumn("graph", F.col("segment")), "id", F.concat("segment", F.lit(":"), seq))  # named by each triple


def of_header(headers: DataFrame) -> DataFrame:
    h = headers.withColumn("graph", F.col("segment"))
    s, i = F.col("segment"), F.col("instance")
    return exploded(
        h,
        F.array(
            triple(s, TYPE, F.lit(LOG + "Segment")), triple(s, LOG + "level", F.concat(F.lit(LOG), F.col("level"))), triple(s, PROV + "startedAtTime", F.col("started"), "literal", XSD + "dateTime"),
            triple(s, PROV + "wasAttributedTo", i), triple(s, LOG + "prevSeal", F.col("prev"), "literal", XSD + "string"), triple(i, TYPE, F.lit(LOG + "Instance")), triple(i, TYPE, F.lit(PROV + "SoftwareAgent")),
        ),
    )


def core_array(predicate: Column) -> Column:
    """Type, segment, time, instance and subject of an entry; columns that RDF can't read degrade to literals."""
    s, ok, fine = F.col("id"), X.is_rdf_iri(F.col("class")), X.is_rdf_iri(F.col("subject"))
    return array(
        triple(s, TYPE, F.when(ok, F.col("class")).otherwise(LOG + "Entry")),
        F.when(~ok, triple(s, LOG + "unreadableIri", F.concat(F.lit("class="), "class"), "literal", XSD + "string")),
        triple(s, LOG + "segment", F.col("segment")),
        triple(s, PROV + "startedAtTime", F.col("time"), "literal", XSD + "dateTime"),
        triple(s, PROV + "wasAssociatedWith", F.col("instance")),
        triple(s, LOG + "subject", F.col("subject"), F.when(fine, "iri").otherwise("literal"), F.when(~fine, XSD + "string")),
        F.when(fine & predicate.isNotNull() & (predicate != LOG + "subject"), triple(s, predicate, F.col("subject"))),
        F.when(~fine, triple(s, LOG + "unreadableIri", F.concat(F.lit("subject="), "subject"), "literal", XSD + "string")),
    )


def declared_triple(v: Vocabulary, f: Column) -> Column:
    """A field whose key binds a property, typed by its range; values that can't be IRIs stay literals.  Null for other fields."""

    def of(bound: Column) -> Column:
        literal = bound["range"].startswith(XSD)
        iri = ~literal & X.is_rdf_iri(f["value"])
        kind, type_ = F.when(iri, "iri").otherwise("literal"), F.when(literal, bound["range"]).when(~iri, XSD + "string")
        return F.when(bound.isNotNull(), triple(F.col("id"), bound["property"], f["value"], kind, type_))

    return X.bound(F.try_element_at(v.key_map(), f["key"]), of)


def undeclared_triples(v: Vocabulary, f: Column) -> Column:
    """A field that no property claims: a literal under the reserved namespace, and a flag for its key."""
    s = F.col("id")
    own = triple(s, F.concat(F.lit(KEY), f["key"]), f["value"], "literal", XSD + "string")
    flag = triple(s, LOG + "undeclaredKey", f["key"], "literal", XSD + "string")
    return F.when(F.try_element_at(v.key_map(), f["key"]).isNull(), F.array(own, flag)).otherwise(F.array().cast(f"array<{TRIPLE}>"))


def core(entries: DataFrame, classes: DataFrame) -> DataFrame:
    e = node(entries).join(F.broadcast(classes.select("class", "predicate")), "class", "left")  # as large as the vocabulary
    return exploded(e, core_array(F.col("predicate")))


def declared(entries: DataFrame, v: Vocabulary) -> DataFrame:
    """Fields whose key binds a property, each statement of an entry once."""
    return exploded(node(entries), F.array_distinct(F.filter(F.transform("fields", lambda f: declared_triple(v, f)), lambda t: t.isNotNull())))


def undeclared(entries: DataFrame, v: Vocabulary) -> DataFrame:
    """Fields that no property claims, and one flag for each key of an entry."""
    return exploded(node(entries), F.array_distinct(F.flatten(F.transform("fields", lambda f: undeclared_triples(v, f)))))


def principals() -> Column:
    """Values of an entry's principals that are IRIs, in order."""
    return F.filter(X.all_values(F.col("fields"), "principal"), X.is_rdf_iri)


def delegation_array() -> Column:
    """A delegation node for each principal of an entry that is an IRI."""

    def of(value: Column, i: Column) -> Column:
        d = F.concat("id", F.lit(":delegation"), F.when(i > 0, F.concat(F.lit(":"), (i + 1).cast("string"))).otherwise(""))
        return F.array(
            triple(F.col("instance"), PROV + "qualifiedDelegation", d), triple(d, TYPE, F.lit(PROV + "Delegation")), triple(d, PROV + "agent", value), triple(d, PROV + "hadActivity", F.col("id"))
        )

    return F.flatten(F.transform(principals(), of))


def agents(entries: DataFrame) -> DataFrame:
    """graph, instance, value of the principals of each segment, each once."""
    return entries.select(F.col("segment").alias("graph"), "instance", F.explode(principals()).alias("value")).distinct()


def agent_array() -> Column:
    return F.array(triple(F.col("value"), TYPE, F.lit(PROV + "Agent")), triple(F.col("instance"), PROV + "actedOnBehalfOf", F.col("value")))


def delegation(entries: DataFrame) -> DataFrame:
    """Delegation nodes of the entries; agents of each segment."""
    return exploded(node(entries), delegation_array()).unionByName(exploded(agents(entries), agent_array()))


def seal_array(seal: Column) -> Column:
    """What a seal (first, last, hash, signature, sig_alg, sig_value) of the column segment says."""
    s = F.concat("segment", F.lit(":seal:"), seal["first"].cast("string"), F.lit("-"), seal["last"].cast("string"))
    return array(
        triple(s, TYPE, F.lit(LOG + "Seal")), triple(s, LOG + "segment", F.col("segment")),
        triple(s, LOG + "first", seal["first"], "literal", XSD + "integer"), triple(s, LOG + "last", seal["last"], "literal", XSD + "integer"),
        triple(s, SIG + "contentHash", seal["hash"], "literal", XSD + "string"),
        F.when(seal["sig_alg"].isNotNull(), triple(s, SIG + "algorithm", seal["sig_alg"], "literal", XSD + "string")),
        F.when(seal["signature"].isNotNull(), triple(s, SIG + "value", seal["sig_value"], "literal", XSD + "string")),
    )


def of_seals(seals: DataFrame) -> DataFrame:
    """seals: segment, first, last, hash, signature, sig_alg, sig_value."""
    whole = seals.withColumns({"graph": F.col("segment"), "seal": F.struct("first", "last", "hash", "signature", "sig_alg", "sig_value")})
    return exploded(whole, seal_array(F.col("seal")))


def runs(entries: DataFrame, starts: list[str] | None = None) -> DataFrame:
    """entries with run: how many process starts came before, the first not counted.  starts: the classes that are one."""
    started = F.sum(F.col("class").isin(starts or [LOG + "ProcessStart"]).cast("long")).over(W.partitionBy("segment").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return entries.withColumn("run", F.greatest(started - 1, F.lit(0).cast("long")))


def invoked(entries: DataFrame, starts: list[str] | None = None) -> DataFrame:
    """Call-tree edges, parent to child, within a run; of equal spans the last one counts."""
    e = runs(node(entries), starts).withColumns({"span": X.first_value(F.col("fields"), "span"), "parent": X.first_value(F.col("fields"), "parent")})
    spans = e.where("span is not null").groupBy("segment", "run", "span").agg(F.max_by("id", "line_no").alias("parent_id"))
    children = e.where("parent is not null").select("graph", "segment", "run", F.col("parent").alias("span"), "id", *[c for c in ("at",) if c in e.columns])
    edges = children.join(spans, ["segment", "run", "span"]).where("id != parent_id")
    return exploded(edges, F.array(triple(F.col("parent_id"), LOG + "invoked", F.col("id"))))


def family_traps(triples: DataFrame, domains: DataFrame, closure: DataFrame) -> DataFrame:
    """Statements whose subject's types lie outside the predicate's domain.  domains: (p, domain)."""
    types = triples.where(F.col("p") == TYPE).select("graph", "s", F.col("o").alias("class")).join(F.broadcast(closure), "class").select("graph", "s", F.col("ancestor").alias("domain"))
    stated = triples.join(F.broadcast(domains), "p").select("graph", "s", "p", "domain")
    return stated.join(types, ["graph", "s", "domain"], "left_anti")


def undeclared_terms(triples: DataFrame, v: Vocabulary) -> DataFrame:
    """(term) of this vocabulary's namespace that triples use and the vocabulary doesn't declare."""
    spark = triples.sparkSession
    used = triples.select(F.explode(F.array("p", F.when(F.col("p") == TYPE, F.col("o")))).alias("term")).where(F.col("term").startswith(LOG)).distinct()
    return used.join(F.broadcast(spark.createDataFrame([(t,) for t in sorted(v.terms())], "term string")), "term", "left_anti")


def unreadable(lines: DataFrame) -> DataFrame:
    """segment, line_no, raw, error of the lines that make a segment unreadable: no entry, no seal, or a directive after the header.

    lines: segment, line_no, raw, kind, e (parsed), seal (parsed).
    """
    error = (
        F.when(F.col("kind") == "directive", "directive after the header")
        .when((F.col("kind") == "entry") & ~X.is_entry(F.col("raw"), F.col("e")), "no entry")
        .when((F.col("kind") == "seal") & ~X.is_seal(F.col("raw"), F.col("seal")), "no seal")
    )
    return lines.select("segment", "line_no", "raw", error.alias("error")).where("error is not null")


def all_triples(headers: DataFrame, entries: DataFrame, seals: DataFrame | None, v: Vocabulary, ordered: bool = False, parsed: bool = False) -> DataFrame:
    """Everything that segments say, as one table; the entries are parsed once and written, because what they say by themselves, agents and both sides of edges read them.

    parsed: entries are columns of tables already, and aren't written again.

    ordered: with part, at and pos, by which a graph's triples are in document order: the segment, its entries, agents
    by name, edges by the child's line, seals by their range.
    """
    starts = v.below(LOG + "ProcessStart")
    spark = headers.sparkSession
    entries = entries if entries.isStreaming or parsed else written(entries, "entries")
    at = (lambda rows, c: rows.withColumn("at", c)) if ordered else (lambda rows, c: rows)
    number, text = F.col("line_no").cast("string"), F.lit("")
    padded = F.lpad(number, 20, "0")
    e = node(at(entries, padded)).join(F.broadcast(v.class_table(spark).select("class", "predicate")), "class", "left")
    fields = F.flatten(F.transform("fields", lambda f: F.concat(F.array(declared_triple(v, f)), undeclared_triples(v, f))))
    said = F.concat(core_array(F.col("predicate")), F.filter(F.array_distinct(fields), lambda t: t.isNotNull()), delegation_array())
    parts = [
        of_header(at(headers, text)), exploded(e, said), exploded(at(agents(entries), F.col("value")), agent_array()), invoked(at(entries, padded), starts),
        *([of_seals(at(seals, F.lpad(F.col("first").cast("string"), 20, "0")))] if seals is not None else []),
    ]
    if ordered:
        parts = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)


# What a document of triples binds; the last one only where it is used.
PREFIXES = {"log": LOG, "prov": PROV, "sig": SIG, "xsd": XSD}
KEY_PREFIX = "logkey"


def escaped(c: Column) -> Column:
    """The inside of a string of Turtle."""
    for char, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(char), F.lit(name))
    control = r"[\x{0}-\x{1f}\x{7f}-\x{9f}]"
    code = lambda ch: F.when(ch.rlike(control), F.concat(F.lit("\\u"), F.right(F.hex(F.encode(ch, "UTF-32")), F.lit(4)))).otherwise(ch)
    return F.when(c.rlike(control), F.array_join(F.transform(F.split(c, ""), code), "")).otherwise(c)


def term(iri: Column) -> Column:
    """An IRI by a bound prefix where the rest is a plain name, else in brackets."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for prefix, namespace in [*PREFIXES.items(), (KEY_PREFIX, KEY)]:
        local = F.substring(iri, F.lit(len(namespace) + 1), F.length(iri))
        out = F.when(iri.startswith(namespace) & local.rlike("^[A-Za-z][A-Za-z0-9_-]*$"), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def turtle(triples: DataFrame) -> DataFrame:
    """graph, n, line of a document for each graph: prefixes, then one line for each triple; by graph and n it is in order.

    Triples with part, at and pos (see :func:`all_triples`) come in document order, others in that of their terms.
    """
    order = ["part", "at", "pos", "s"] if "part" in triples.columns else ["s", "p", "o"]
    quoted = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    typed = F.when(F.col("o_type").isNull() | (F.col("o_type") == XSD + "string"), quoted).otherwise(F.concat(quoted, F.lit("^^"), term(F.col("o_type"))))
    line = F.concat(F.concat(F.lit("<"), "s", F.lit(">")), F.lit(" "), F.when(F.col("p") == TYPE, "a").otherwise(term(F.col("p"))), F.lit(" "), F.when(F.col("o_kind") == "iri", term(F.col("o"))).otherwise(typed), F.lit(" ."))
    many = len(PREFIXES) + 1
    graph = W.partitionBy("graph")
    nth = F.row_number().over(graph.orderBy(*order))
    rows = triples.select("graph", nth.alias("nth"), line.alias("line"), F.bool_or(F.col("p").startswith(KEY)).over(graph).alias("undeclared"))
    # The first line brings the prefixes with it: a union of two tables by graph would have their partitions meet by number.
    each = [F.struct(F.lit(i + 1).cast("long").alias("n"), F.lit(f"@prefix {p}: <{ns}> .").alias("line")) for i, (p, ns) in enumerate(PREFIXES.items())]
    bound = F.when(F.col("undeclared"), F.struct(F.lit(many).cast("long").alias("n"), F.lit(f"@prefix {KEY_PREFIX}: <{KEY}> .").alias("line")))
    head = F.when(F.col("nth") == 1, F.filter(F.array(*each, bound), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<n: bigint, line: string>>"))
    own = F.array(F.struct((F.col("nth") + many).cast("long").alias("n"), F.col("line")))
    rows = rows.select("graph", F.inline(F.concat(head, own)))
    return rows.orderBy("graph", "n")


def digests(document: DataFrame) -> DataFrame:
    """graph, bytes, hash of each document of :func:`turtle`: one pass over its lines in order."""
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, size, digest, out = None, 0, hashlib.sha256(), []
        for batch in batches:
            for g, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != graph:
                    if graph is not None:
                        out.append((graph, size, "sha256:" + digest.hexdigest()))
                    graph, size, digest = g, 0, hashlib.sha256()
                raw = (line + "\n").encode()
                size += len(raw)
                digest.update(raw)
        if graph is not None:
            out.append((graph, size, "sha256:" + digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["graph", "bytes", "hash"])

    return document.repartition("graph").sortWithinPartitions("graph", "n").select("graph", "line").mapInArrow(run, "graph string, bytes long, hash string")
