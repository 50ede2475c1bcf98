"""The vocabulary as data: keys, classes and levels; a small Turtle reader extends it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, KEY, SIG = "urn:provlog:ns#", "urn:provlog:ns/key#", "urn:provlog:sig#"
PROV, RDF, RDFS, XSD = "http://www.w3.org/ns/prov#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"
MAGIC = "# provlog v1"

# Keys and the properties they bind, by range.
INTEGER_KEYS = {
    "span": "span",
    "parent": "parentSpan",
    "dur": "durationMs",
    "depth": "depth",
    "scope-clock": "scopeClockMs",
    "bytes": "byteCount",
    "pid": "processId",
    "count": "count",
    "seq": "sequence",
}
STRING_KEYS = {
    "worker": "worker",
    "alias": "aliasHop",
    "scope": "scopeChain",
    "sealed": "sealViolation",
    "level": "levelPath",
    "uncached": "uncachedReason",
    "door": "door",
    "verb": "verb",
    "outcome": "outcome",
    "q": "servedQuery",
    "needs": "neededCapability",
    "msg": "text",
    "expected": "expectedSeal",
    "stated": "statedSeal",
    "finding": "finding",
    "failed": "failureKind",
    "file": "configLayer",
    "key": "changedKey",
    "from": "fromValue",
    "to": "toValue",
    "effective": "effective",
    "reason": "reason",
}
IRI_KEYS = {
    "cap": "capability",
    "alias-unresolved": "aliasUnresolved",
    "scope-unresolved": "scopeUnresolved",
    "limited": "limitedTarget",
    "answered-by": "answeredBy",
    "grant": "grant",
    "denied": "deniedScope",
    "principal": "onBehalfOf",
    "credential": "credentialKind",
    "next": "successor",
    "configured": "configuredInstance",
}
# Class, its superclass, its least level and its subject's predicate.
CLASSES = [
    ("Entry", "prov:Activity", None, None),
    ("Resolution", "Entry", "debug", "resolved"),
    ("CacheHit", "Resolution", "trace", None),
    ("NotResolved", "Entry", "debug", None),
    ("DepthExceeded", "NotResolved", "warn", "refused"),
    ("Access", "Entry", "info", "requested"),
    ("Message", "Entry", "info", None),
    ("Warning", "Message", "warn", None),
    ("Error", "Message", "error", None),
    ("ProcessStart", "Entry", "always", "prov:wasAssociatedWith"),
    ("ProcessStop", "Entry", "always", "prov:wasAssociatedWith"),
    ("ConfigChange", "Entry", "always", None),
    ("LevelChange", "ConfigChange", "always", None),
    ("LevelChangeRejected", "Entry", "always", None),
    ("Rotation", "Entry", "always", None),
    ("Seal", "Entry", "always", None),
    ("ChainBroken", "Entry", "always", None),
    ("Tombstone", "Entry", "always", None),
    ("Dropped", "Entry", "always", None),
    ("CapabilityDenied", "Entry", "always", "refused"),
    ("EndpointDenied", "CapabilityDenied", "always", None),
    ("KeyChange", "Entry", "always", None),
]
# The ladder of levels.
LEVELS = {"always": -1, "error": 0, "warn": 1, "info": 2, "debug": 3, "trace": 4}
DEFAULT_LEVEL = "info"
# Terms of triples that no key or class declares.
STATED = ["Segment", "Instance", "level", "prevSeal", "segment", "subject", "unreadableIri", "undeclaredKey", "invoked", "first", "last"]


def iri(name: str) -> str:
    return PROV + name[5:] if name.startswith("prov:") else LOG + name


@dataclass
class Vocabulary:
    """keys: key to (property, range).  parents: class to its superclasses, in order of declaration."""

    keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    parents: dict[str, list[str]] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    predicate: dict[str, str] = field(default_factory=dict)
    ranks: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def built_in() -> Vocabulary:
        v = Vocabulary(ranks={LOG + k: r for k, r in LEVELS.items()})
        for keys, range_ in ((INTEGER_KEYS, XSD + "integer"), (STRING_KEYS, XSD + "string"), (IRI_KEYS, RDFS + "Resource")):
            v.keys |= {k: (LOG + p, range_) for k, p in keys.items()}
        for name, parent, level, predicate in CLASSES:
            v.parents[iri(name)] = [iri(parent)]
            if level is not None:
                v.least[iri(name)] = LOG + level
            if predicate is not None:
                v.predicate[iri(name)] = iri(predicate)
        return v

    def walk(self, cls: str) -> list[tuple[str, int]]:
        """Ancestors, breadth first, each once, with their distance; the class itself first."""
        seen, queue = {cls: 0}, [cls]
        for c in queue:
            for p in self.parents.get(c, []):
                if p not in seen:
                    seen[p] = seen[c] + 1
                    queue.append(p)
        return [(c, seen[c]) for c in queue]

    def nearest(self, cls: str, facts: dict[str, str]) -> str | None:
        return next((facts[c] for c, _ in self.walk(cls) if c in facts), None)

    def extend(self, turtle: str) -> Vocabulary:
        """Merge Turtle: superclasses add up, other facts of later statements win."""
        prefixes = dict(re.findall(r"@prefix\s+([\w-]*):\s*<([^>]*)>\s*\.", turtle))
        body = re.sub(r"@prefix[^\n]*|(?m:^\s*#[^\n]*)", "", turtle)
        names = r'"(?:[^"\\]|\\.)*"(?:\^\^\S+)?|<[^>]*>|[\w-]*:[\w.-]*\w|\ba\b|-?\d+|[;,.]'
        full = lambda t: t[1:-1] if t[0] in '<"' else prefixes.get(t.split(":")[0], "") + t.split(":", 1)[1] if ":" in t else t
        subject = predicate = None
        ranges: dict[str, str] = {}
        bound: dict[str, str] = {}
        for token in re.findall(names, body):
            if token == ".":
                subject = predicate = None
            elif token == ";":
                predicate = None
            elif token == ",":
                pass
            elif subject is None:
                subject = full(token)
            elif predicate is None:
                predicate = RDF + "type" if token == "a" else full(token)
            else:
                value = full(token)
                if predicate == RDFS + "subClassOf":
                    own = self.parents.setdefault(subject, [])
                    own += [value] * (value not in own)
                elif predicate == LOG + "minLevel":
                    self.least[subject] = value
                elif predicate == LOG + "subjectPredicate":
                    self.predicate[subject] = value
                elif predicate == LOG + "rank":
                    self.ranks[subject] = int(value)
                elif predicate == RDF + "type" and value == LOG + "Level":
                    self.ranks.setdefault(subject, 0)
                elif predicate == RDFS + "range":
                    ranges[subject] = value
                elif predicate == LOG + "keyName":
                    bound[value] = subject
        for key, prop in bound.items():
            self.keys[key] = (prop, ranges.get(prop, self.keys.get(key, ("", XSD + "string"))[1]))
        return self

    def below(self, ancestor: str) -> list[str]:
        """A class and all that are a kind of it."""
        return [c for c in self.parents if any(a == ancestor for a, _ in self.walk(c))]

    def terms(self) -> set[str]:
        """Every class, property and level that is declared, and what triples use besides."""
        own = {LOG + t for t in STATED}
        return own | set(self.parents) | {p for p, _ in self.keys.values()} | set(self.predicate.values()) | set(self.ranks)

    def key_map(self) -> Column:
        """A literal map from each key to its property and range: as large as the vocabulary."""
        each = [(F.lit(k), F.struct(F.lit(p).alias("property"), F.lit(r).alias("range"))) for k, (p, r) in self.keys.items()]
        return F.create_map(*[x for pair in each for x in pair])

    def predicate_map(self) -> Column:
        """A literal map from each class that has one to the predicate of its subject."""
        found = [(c, self.nearest(c, self.predicate)) for c in self.parents]
        return F.create_map(*[F.lit(x) for pair in found if pair[1] is not None for x in pair])

    def key_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, p, r) for k, (p, r) in self.keys.items()], "key string, property string, range string")

    def class_table(self, spark: SparkSession) -> DataFrame:
        """class, least_rank, predicate: as resolved through the hierarchy."""
        rank = lambda c: self.ranks.get(self.nearest(c, self.least) or LOG + DEFAULT_LEVEL)
        return spark.createDataFrame([(c, rank(c), self.nearest(c, self.predicate)) for c in self.parents], "class string, least_rank int, predicate string")

    def closure_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, a, d) for c in self.parents for a, d in self.walk(c)], "class string, ancestor string, distance long")

    def level_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.ranks.items()), "level string, rank int")
