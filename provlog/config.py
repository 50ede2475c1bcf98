"""Configuration in layers: every key optional, merged key by key, errors name the key.

A configuration has two faces, a file that can be read back and a graph, and changes of a layer
are written into its file and noted as entries.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from provlog.vocabulary import LEVELS, LOG, PROV, RDF, XSD

NEVER = "never"
NAMESPACE = "urn:inst:"
#: When a changed key takes effect.
EFFECTIVE = {"level": "next segment", "seal": "next segment", "rotation": "next segment", "destination": "next process start", "directory": "next process start", "instance": "next process start"}


@dataclass(frozen=True)
class Config:
    """Bounds are positive integers, or None for never.  layers: the files that were read."""

    level: str = "info"
    destination: str = "file"
    directory: str = "."
    instance: str = "urn:inst:default"
    seal: dict[str, int | None] = field(default_factory=lambda: {"entries": 1000, "millis": 60_000})
    rotation: dict[str, int | None] = field(default_factory=lambda: {"entries": 100_000, "millis": 24 * 3600 * 1000})
    layers: tuple[str, ...] = ()


def bound(key: str, value: object) -> int | None:
    if value == NEVER:
        return None
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise ValueError(f"{key}: a positive integer or {NEVER!r}, not {value!r}")
    return value


def instance_iri(name: str) -> str:
    """The IRI of an instance, given by its name or by its IRI."""
    return name if name.startswith(NAMESPACE) else NAMESPACE + name


def merged(base: Config, layer: dict) -> Config:
    """base with what a layer states."""
    out = base
    for key, value in layer.items():
        if key in ("seal", "rotation"):
            if not isinstance(value, dict) or set(value) - {"entries", "millis"}:
                raise ValueError(f"{key}: only entries and millis")
            out = replace(out, **{key: getattr(out, key) | {k: bound(f"{key}.{k}", v) for k, v in value.items()}})
        elif key not in EFFECTIVE:
            raise ValueError(f"{key}: no such key")
        elif not isinstance(value, str) or not value.strip():
            raise ValueError(f"{key}: a text that isn't blank")
        elif key == "level" and value not in LEVELS:
            raise ValueError(f"level: one of {', '.join(LEVELS)}")
        elif key == "destination" and value not in ("file", "console", "off"):
            raise ValueError("destination: file, console or off")
        else:
            out = replace(out, **{key: instance_iri(value) if key == "instance" else value})
    return out


def files(directory: str, app: str | None = None) -> list[Path]:
    return [Path(directory) / name for name in ["log.toml", *([f"{app}.log.toml"] if app else [])]]


def load(directory: str, app: str | None = None) -> Config:
    """The layers of a folder: log.toml, then the application's own; an absent file is an empty layer."""
    out = Config()
    for path in files(directory, app):
        if path.exists():
            out = merged(out, tomllib.loads(path.read_text()))
            out = replace(out, layers=(*out.layers, str(path)))
    return out


def flat(c: Config) -> dict[str, str]:
    """Every key with its value as text; bounds as ``seal.entries``."""
    say = lambda v: NEVER if v is None else str(v)
    plain = {k: getattr(c, k) for k in ("level", "destination", "directory", "instance")}
    return plain | {f"{k}.{n}": say(v) for k in ("seal", "rotation") for n, v in getattr(c, k).items()}


def changes(before: Config, after: Config, file: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(class, fields) of an entry for each key that really changed."""
    old, new = flat(before), flat(after)
    return [
        ("LevelChange" if k == "level" else "ConfigChange", [("key", k), ("from", old[k]), ("to", new[k]), ("effective", EFFECTIVE[k.split(".")[0]]), ("file", file)])
        for k in new
        if old[k] != new[k]
    ]


def quoted(value: str) -> str:
    """A basic string of TOML; JSON's escapes are a part of its own."""
    return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")


def toml(layer: dict) -> str:
    """A layer as a file: single keys first, then tables."""

    def lines() -> Iterator[str]:
        say = lambda v: str(v) if isinstance(v, int) else quoted(NEVER if v is None else v)
        yield from (f"{k} = {say(v)}" for k, v in layer.items() if not isinstance(v, dict))
        for table, values in layer.items():
            if isinstance(values, dict) and values:
                yield from ("", f"[{table}]", *(f"{k} = {say(v)}" for k, v in values.items()))

    return "\n".join(lines()).lstrip("\n") + "\n"


def to_toml(c: Config) -> str:
    """The configuration as a file that, loaded, gives it again."""
    name = c.instance.removeprefix(NAMESPACE)
    return toml({"level": c.level, "destination": c.destination, "directory": c.directory, "instance": name, "seal": c.seal, "rotation": c.rotation})


def write_layer(directory: str, stated: dict, app: str | None = None) -> tuple[Config, list[tuple[str, list[tuple[str, str]]]]]:
    """State keys in the topmost layer of a folder: its file keeps its other keys.

    Returns the configuration that then holds and the entries of what changed.  Nothing is written if a key or value can't be.
    """
    path, before = files(directory, app)[-1], load(directory, app)
    merged(before, stated)
    own = tomllib.loads(path.read_text()) if path.exists() else {}
    for key, value in stated.items():
        own[key] = own.get(key, {}) | value if isinstance(value, dict) else value
    text = toml(own)
    path.write_text(text)
    after = load(directory, app)
    return after, changes(before, after, str(path))


def graph(spark: SparkSession, c: Config, subject: str = "urn:log:config", segment: tuple[str, str] | None = None) -> DataFrame:
    """The configuration as triples (graph, s, p, o, o_kind, o_type).  segment: name and instance of the segment that is open."""
    rows: list[tuple[str, str, str, str, str | None]] = []
    iri = lambda s, p, o: rows.append((s, p, o, "iri", None))
    text = lambda s, p, o, t="string": rows.append((s, p, str(o), "literal", XSD + t))
    iri(subject, RDF + "type", LOG + "Config")
    iri(subject, LOG + "level", LOG + c.level)
    iri(subject, LOG + "destination", LOG + c.destination)
    text(subject, LOG + "directory", c.directory)
    iri(subject, LOG + "instance", c.instance)
    for name, cadence in (("seal", c.seal), ("rotation", c.rotation)):
        node = f"{subject}#{name}"
        iri(subject, LOG + name + "Cadence", node)
        iri(node, RDF + "type", LOG + "Cadence")
        for key, value in cadence.items():
            term = LOG + "every" + key.capitalize()
            if value is None:
                iri(node, LOG + "unbounded", term)  # stated: a trigger that is off must not read like one left out
            else:
                text(node, term, value, "integer")
    for layer in c.layers:
        text(subject, LOG + "configLayer", layer)
    iri(subject, LOG + "currentSegment", segment[0] if segment else LOG + "none")
    iri(c.instance, RDF + "type", LOG + "Instance")
    if segment:
        name, instance = segment
        iri(name, RDF + "type", LOG + "Segment")
        iri(name, LOG + "level", LOG + c.level)
        iri(name, PROV + "wasAttributedTo", instance)
        if instance != c.instance:
            iri(instance, RDF + "type", LOG + "Instance")
            iri(instance, LOG + "configuredInstance", c.instance)
    return spark.createDataFrame([(subject, *r) for r in rows], "graph string, s string, p string, o string, o_kind string, o_type string")
