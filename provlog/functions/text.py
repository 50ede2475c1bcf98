"""The line grammar as Column expressions: tokens, values, entries, seals, IRIs, encodings.

Everything stays in the JVM; nothing here is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode White_Space, and the characters a line never holds as themselves
# (controls, line separators, bidirectional formatting), as members of a Java regex class.
WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ESCAPED = r"\x{0}-\x{1f}\x{7f}-\x{9f}\x{2028}\x{2029}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200e}\x{200f}\x{61c}"
# Unrolled and possessive: an alternation inside a star overflows the stack on long values.  Runs of printable ASCII come
# first: what they match the others match too, but a test against all white space costs ten times as much for each character.
TOKEN = rf'(?s)[!#-~]++(?=\x20|\z)|(?:[!#-~]++|[^{WS}"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")++'
PART = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++)'
PIECE = r"(?s)(\\u\{[0-9a-fA-F]{1,6}\}|\\.|[^\\]+)"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def time_string(millis: Column) -> Column:
    """The 24 characters of a time in milliseconds; the session's zone must be UTC."""
    return F.date_format(F.timestamp_millis(millis), TIME)


def is_time(c: Column) -> Column:
    """A real calendar time of exactly 24 characters."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    return F.coalesce(shape & (F.date_format(F.try_to_timestamp(c, F.lit(TIME)), TIME) == c), F.lit(False))


def time_millis(c: Column) -> Column:
    return F.when(is_time(c), F.unix_millis(F.try_to_timestamp(c, F.lit(TIME))))


def tokens(line: Column) -> Column:
    """The tokens of a line, still quoted."""
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def is_scannable(line: Column) -> Column:
    """Every quote is closed and every escape names a character."""
    rest = F.regexp_replace(line, TOKEN, "")
    wrong = line.rlike(r'\\u(?!\{[0-9a-fA-F]{1,6}\})')
    plain = ~line.rlike(r'["\\]')  # nothing opens, and nothing is escaped
    return plain | (rest.rlike(f"^[{WS}]*$") & ~wrong)


def character(hex_: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_, 8, "0")), "UTF-32")


def unquote(token: Column) -> Column:
    """A token without its quotes and escapes; quotes may open anywhere in it."""

    def piece(p: Column) -> Column:
        named = F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t")
        return (
            named.when(p.rlike(r"^\\u\{"), character(F.substring_index(F.substring(p, 4, 6), "}", 1)))
            .when(p.startswith("\\"), F.substring(p, F.lit(2), F.length(p)))
            .otherwise(p)
        )

    def part(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        pieces = F.transform(F.regexp_extract_all(inner, F.lit(PIECE), F.lit(1)), piece)
        return F.when(p.startswith('"'), F.array_join(pieces, "")).otherwise(p)

    plain = ~F.contains(token, F.lit('"'))
    return F.when(plain, token).otherwise(F.array_join(F.transform(F.regexp_extract_all(token, F.lit(PART), F.lit(1)), part), ""))


def is_bare(v: Column) -> Column:
    return (v != "") & (v.rlike(r"\A[!#-\[\]-~]+\z") | ~v.rlike(rf'["\\{WS}{ESCAPED}]'))  # printable ASCII first: most are, and its test is cheap


def quote(v: Column) -> Column:
    """A value in quotes, on one printable line."""
    out = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(name))

    def escape(c: Column) -> Column:
        code = F.hex(F.encode(c, "UTF-32"))
        return F.when(c.rlike(f"[{ESCAPED}]"), F.concat(F.lit("\\u{"), F.lower(F.regexp_replace(code, "^0+(?=.)", "")), F.lit("}"))).otherwise(c)

    rare = F.array_join(F.transform(F.split(out, ""), escape), "")
    return F.concat(F.lit('"'), F.when(out.rlike(f"[{ESCAPED}]"), rare).otherwise(out), F.lit('"'))


def render_value(v: Column) -> Column:
    return F.when(is_bare(v), v).otherwise(quote(v))


def render_fields(fields: Column) -> Column:
    """`` key=value`` for each field, in order."""
    return F.concat(F.lit(""), F.array_join(F.transform(fields, lambda f: F.concat(F.lit(" "), f["key"], F.lit("="), render_value(f["value"]))), ""))


def render_entry(time: Column, curie: Column, subject: Column, fields: Column) -> Column:
    return F.concat(time, F.lit(" "), curie, F.lit(" "), subject, render_fields(fields))


def entry_error(time: Column, class_: Column, subject: Column, fields: Column) -> Column:
    """Why an entry can't be written as a line, or null."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(is_time(time)), "no time")
        .when(no(is_writable_iri(class_)), "class is no IRI")
        .when(no(is_writable_iri(subject)), "subject is no IRI")
        .when(F.exists(fields, lambda f: no(is_key(f["key"]))), "no key")
    )


def shown(c: Column) -> Column:
    """A text for reports: characters that a line never holds are escaped, backslashes stay."""

    def escape(ch: Column) -> Column:
        code = F.lower(F.regexp_replace(F.hex(F.encode(ch, "UTF-32")), "^0+(?=.)", ""))
        return F.when(ch.rlike(f"[{ESCAPED}]"), F.concat(F.lit("\\u{"), code, F.lit("}"))).otherwise(ch)

    return F.when(c.rlike(f"[{ESCAPED}]"), F.array_join(F.transform(F.split(c, ""), escape), "")).otherwise(c)


def line_kind(line: Column) -> Column:
    """blank, seal, comment, directive or entry, by the first characters."""
    return (
        F.when(line.rlike(f"^[{WS}]*$"), "blank").when(line.startswith("#seal"), "seal").when(line.startswith("#"), "comment").when(line.startswith("@"), "directive").otherwise("entry")
    )


def is_iri(c: Column) -> Column:
    """The loose test of the grammar: a colon, no angle brackets or quotes, no white space."""
    return F.contains(c, F.lit(":")) & (c.rlike(r"\A[!#-;=?-~]+\z") | ~c.rlike(rf'[<>"{WS}]'))


def is_writable_iri(c: Column) -> Column:
    return is_iri(c) & ~c.rlike(f"[{ESCAPED}]")


def is_rdf_iri(c: Column) -> Column:
    """An absolute IRI: a scheme, and none of the characters that RFC 3987 leaves out."""
    plain = c.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:[!#$&-;=?-\[\]_a-z~]*\z")  # printable ASCII without escapes first: most are, and its test is cheap
    return plain | c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~c.rlike(rf'[<>"{{}}|\\^`{WS}{ESCAPED}]') & ~c.rlike("%(?![0-9A-Fa-f]{2})")


def is_key(c: Column) -> Column:
    return c.rlike("^[A-Za-z][A-Za-z0-9_.-]*$")


def expand(token: Column, prefixes: Column) -> Column:
    """``<iri>`` or ``prefix:local``; null where the prefix isn't bound."""
    local = F.substring(token, F.instr(token, ":") + F.lit(1), F.length(token))
    bound = F.concat(F.try_element_at(prefixes, F.substring_index(token, ":", 1)), local)
    return F.when(token.startswith("<"), F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(bound)


def shorten(iri: Column, prefixes: Column) -> Column:
    """The CURIE of the longest namespace that leaves a plain local part; else ``<iri>``."""
    entries = F.filter(F.map_entries(prefixes), lambda e: iri.startswith(e["value"]) & F.substring(iri, F.length(e["value"]) + 1, F.length(iri)).rlike("^[^:/#]+$"))
    best = F.element_at(F.array_sort(entries, lambda a, b: F.length(b["value"]) - F.length(a["value"])), 1)
    return F.when(F.size(entries) == 0, F.concat(F.lit("<"), iri, F.lit(">"))).otherwise(F.concat(best["key"], F.lit(":"), F.substring(iri, F.length(best["value"]) + 1, F.length(iri))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once, whatever reads it: conditions on it are judged after it, and never by working it out again."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def parse_entry(line: Column, prefixes: Column) -> Column:
    """A struct (time, class, subject, fields) of an entry's line."""

    def field(plain: Column) -> Column:
        at = F.instr(plain, "=")
        return F.struct(F.substring(plain, F.lit(1), at - 1).alias("key"), F.substring(plain, at + 1, F.length(plain)).alias("value"))

    def entry(found: Column) -> Column:
        fields = F.transform(F.transform(F.slice(found, 4, F.greatest(F.size(found) - 3, F.lit(0))), unquote), field)
        return F.struct(F.get(found, 0).alias("time"), bound(F.get(found, 1), lambda c: expand(c, prefixes)).alias("class"), F.get(found, 2).alias("subject"), fields.alias("fields"))

    return bound(tokens(line), entry)


def first_value(fields: Column, key: str) -> Column:
    """The first value of a key, or null."""
    return F.get(F.filter(fields, lambda f: f["key"] == key), 0)["value"]


def all_values(fields: Column, key: str) -> Column:
    return F.transform(F.filter(fields, lambda f: f["key"] == key), lambda f: f["value"])


def unsigned(digits: Column) -> Column:
    """An unsigned number of 64 bits; null where it is none."""
    n = F.when(digits.rlike(r"^\+?[0-9]+$"), digits.try_cast("decimal(38,0)"))
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n.cast("decimal(20,0)"))


def stated_sequence(fields: Column) -> Column:
    """The first seq as an unsigned number of 64 bits; null where it is none."""
    return unsigned(first_value(fields, "seq"))


def is_entry(line: Column, e: Column) -> Column:
    """Whether a line is an entry; e: what :func:`parse_entry` made of it."""
    good = is_scannable(line) & is_time(e["time"]) & is_iri(e["class"]) & is_iri(e["subject"]) & F.forall(e["fields"], lambda f: is_key(f["key"]))
    return F.coalesce(good, F.lit(False))


def parse_seal(line: Column) -> Column:
    """A struct (first, last, hash, signature, sig_alg, sig_value) of a seal's line; nulls where it isn't one."""
    parts = F.split(F.trim(line), r"\s+")
    bounds = F.split(F.get(parts, 1), "-")
    sign = F.get(parts, 3)
    tagged = sign.rlike("^[^:]+:.+$")
    return F.struct(
        unsigned(F.get(bounds, 0)).alias("first"), unsigned(F.get(bounds, 1)).alias("last"), F.get(parts, 2).alias("hash"), sign.alias("signature"),
        F.when(tagged, F.substring_index(sign, ":", 1)).alias("sig_alg"), F.when(tagged, F.substring(sign, F.instr(sign, ":") + F.lit(1), F.length(sign))).otherwise(sign).alias("sig_value"),
    )


def is_seal(line: Column, seal: Column) -> Column:
    """Whether a line is a seal; seal: what :func:`parse_seal` made of it."""
    return F.coalesce(line.rlike(r"^#seal\s+\d+-\d+\s+\S+") & seal["first"].isNotNull() & seal["last"].isNotNull(), F.lit(False))


def tagged_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "-")


def instance_iri(name: Column, namespace: str) -> Column:
    """The IRI of an instance, given by its name or by its IRI."""
    return F.when(name.startswith(namespace), name).otherwise(F.concat(F.lit(namespace), name))


def stamp(time: Column) -> Column:
    """The part of a time that names a segment: to the second, without colons."""
    return F.concat(F.translate(F.substring(time, 1, 19), ":", "-"), F.lit("Z"))


def percent(c: Column, kept: str) -> Column:
    """Percent-encode every byte of UTF-8 of the characters that aren't in the class kept, run by run."""
    other = "[^" + kept[1:]
    encoded = lambda run: F.when(run.rlike(f"^{kept}"), run).otherwise(F.regexp_replace(F.hex(F.encode(run, "UTF-8")), "(..)", "%$1"))
    runs = F.regexp_extract_all(c, F.lit(f"{kept}+|{other}+"), F.lit(0))
    return F.when(~c.rlike(other), c).otherwise(F.array_join(F.transform(runs, encoded), ""))


def encode_text(c: Column) -> Column:
    return percent(c, r"[A-Za-z0-9\-._~:/@!$'()*+,;]")


def encode_iri(c: Column) -> Column:
    """The URI of an IRI; a % that starts no escape is encoded too."""
    return percent(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"[!#-;=?-\[\]_a-z~]")


MAX_FIELD = 256


def cut(c: Column) -> Column:
    """At most 256 characters of an ASCII value, never within an escape, then an ellipsis."""
    head = F.regexp_replace(F.substring(c, 1, MAX_FIELD), "%.?$", "")
    return F.when(F.length(c) > MAX_FIELD, F.concat(head, F.lit("…"))).otherwise(c)


# Argument names that are never written; those from the fourth on also within a longer name.
WITHHELD = ["content", "body", "form", "cookie", "authorization", "session", "token", "password", "secret"]


def is_withheld(name: Column) -> Column:
    folded = F.lower(F.translate(name, "-_", ""))
    return folded.isin(WITHHELD) | folded.rlike("|".join(WITHHELD[3:]))
