"""Trace events and served requests as entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlog.functions import text as X
from provlog.vocabulary import LOG

# Notes of resolutions that never ran.
NOT_RUN = ["limited", "alias-unresolved", "scope-unresolved", "sealed"]
# Why a fact can be lost.
DROP_REASONS = ["write-failed", "unwritable", "reentrant", "panicked"]
PROBE = 512
FIELDS = "array<struct<key: string, value: string>>"


def field(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def stated(*fields: Column) -> Column:
    return F.filter(F.array(*fields), lambda f: f["value"].isNotNull())


def trace_class(notes: Column, cache_hit: Column) -> Column:
    """The class of a trace event; the first rule that holds decides."""
    has = lambda *keys: F.exists(notes, lambda n: n["key"].isin(*keys))
    denied = F.exists(notes, lambda n: (n["key"] == "failed") & (n["value"] == "denied"))
    name = F.when(has("denied"), "CapabilityDenied").when(has("depth"), "DepthExceeded").when(has(*NOT_RUN), "NotResolved").when(denied, "EndpointDenied").when(cache_hit, "CacheHit").otherwise("Resolution")
    return F.concat(F.lit(LOG), name)


def is_principal(scope: Column) -> Column:
    """A scope that names a principal: a bare, writable IRI of bounded length, without a wildcard."""
    return X.is_bare(scope) & X.is_writable_iri(scope) & X.is_rdf_iri(scope) & (F.octet_length(scope) <= PROBE)


def carried_principal(capability: Column, prefix: str = "urn:agent:") -> Column:
    """The single principal among a capability's scopes, or null."""
    named = F.filter(capability, lambda s: s.startswith(prefix) & ~F.contains(s, F.lit("*")) & is_principal(s))
    return F.when(F.size(named) == 1, F.get(named, 0))


def trace_entries(events: DataFrame, now: Column, principal: str | None = None) -> DataFrame:
    """events with class, time, fields and writable.

    events: target, thread, started, ended (milliseconds or null), cache_hit, span, parent, capability (array or null), notes (array of key and value).
    """
    caps = F.transform(F.coalesce("capability", F.array().cast("array<string>")), lambda s: F.struct(F.lit("cap").alias("key"), s.alias("value")))
    first = stated(
        field("principal", F.coalesce(carried_principal(F.col("capability")), F.lit(principal))), field("worker", F.col("thread")), field("span", F.col("span")),
        field("parent", F.col("parent")), field("dur", F.when((F.col("ended") - F.col("started")).isNotNull(), F.greatest(F.col("ended") - F.col("started"), F.lit(0)))),
    )
    fields = F.concat(first, caps, F.col("notes").cast(FIELDS))
    e = events.withColumns({"class": trace_class(F.col("notes"), F.col("cache_hit")), "time": X.time_string(F.coalesce("started", now)), "fields": fields})
    return e.withColumn("writable", X.is_writable_iri(F.col("target")) & F.forall("fields", lambda f: X.is_key(f["key"])))


def drop_ledger(entries: DataFrame) -> DataFrame:
    """reason, count of the events that were lost; one row for each reason that occurs.

    An event that can't be written as a line is unwritable; the host tells of the others in a column lost, where there is one.
    """
    told = F.col("lost") if "lost" in entries.columns else F.lit(None).cast("string")
    reason = F.when(told.isin(DROP_REASONS), told).when(~F.col("writable"), "unwritable")
    return entries.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("count"))


def drop_markers(ledger: DataFrame, segment: str, time: Column) -> DataFrame:
    """Entries (time, class, subject, fields) that tell a segment's readers what was lost; they name no principal."""
    fields = F.array(field("count", F.col("count")), field("reason", F.col("reason")))
    return ledger.where("count > 0").select(X.time_string(time).alias("time"), F.lit(LOG + "Dropped").alias("class"), F.lit(segment).alias("subject"), fields.alias("fields"))


def access_entries(requests: DataFrame) -> DataFrame:
    """requests with class, iri (the subject as written), fields and error.

    requests: subject, door, verb, outcome, caller (IRI, null: anonymous), credential, bytes, dur, grant, arguments (array of name and value), needs (array).
    """
    iri = X.cut(X.encode_iri(F.col("subject")))
    empty = [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"empty {c}") for c in ("door", "verb", "outcome")]
    served = F.array_join(F.transform(F.filter("arguments", lambda a: ~X.is_withheld(a["name"])), lambda a: F.concat(X.encode_text(a["name"]), F.lit("="), X.encode_text(a["value"]))), "&")
    needs = F.array_join(F.transform(F.filter("needs", lambda n: n != ""), X.encode_iri), " ")
    fields = stated(
        *[field(c, X.cut(X.encode_text(F.col(c)))) for c in ("door", "verb", "outcome")], field("bytes", F.col("bytes")), field("dur", F.col("dur")),
        field("principal", F.coalesce("caller", F.lit("anon"))), field("credential", F.col("credential")), field("grant", F.col("grant")),
        field("q", F.when(served != "", X.cut(served))), field("needs", F.when((F.col("outcome") == "denied") & (needs != ""), X.cut(needs))),
    )
    return requests.withColumns({"class": F.lit(LOG + "Access"), "iri": iri, "fields": fields, "error": F.coalesce(F.when(~X.is_iri(iri), "subject is no IRI"), *empty)})
