"""License scans: an Aho-Corasick automaton over words, and licence expressions.

A text's words (digits, letters and code points beyond ASCII, A-Z lower-cased) are joined by
single blanks; one pass of the automaton finds every phrase at word boundaries, overlapping
ones included.  Where it finds the identifier tag, the rest of that line in the text is read
as a licence expression: a shunting-yard parser orders ``WITH`` before ``AND`` before ``OR``,
and the evaluation gives the licences named and whether the terms are permissive (all sides of
AND, any side of OR).  Names outside of ``LICENSES`` (and ``LicenseRef-``) are labelled as such, ``other:`` and the name, beside the known sides;
their terms are unknown, and so are those of the whole where they decide (null).  An expression that doesn't parse gives
no label.  A licence has one label, whether a phrase or a tag names it.

``score`` is the chance that one finding at least is a licence notice, if each errs by itself.

A null text counts as empty: no words, no labels, score 0.  Texts of any length are read whole.
Rows that repeat an identifier each have a row; null identifiers stay null.  Equal findings
give one label.  Other columns aren't read, so their names can't clash.  An empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "released into the public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Short identifiers of licences that a tag may name, and those whose terms are permissive.
PERMISSIVE = {"mit", "mit-0", "apache-2.0", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "0bsd", "unlicense", "cc0-1.0", "cc-by-4.0", "bsl-1.0", "python-2.0", "postgresql", "ncsa", "x11", "wtfpl"}
LICENSES = PERMISSIVE | {
    "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later",
    "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "eupl-1.2", "cddl-1.0", "artistic-2.0", "cc-by-3.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "ofl-1.1",
}
#: Identifiers whose licence a phrase labels otherwise.
SAME = {"apache-2.0": "apache-2"}
SURE = {"base": 0.9, "notice": 0.7, "tag": 0.95}
#: Marks the label of a name that isn't listed.
OTHER = "other:"
SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in the order of evaluation; None if it doesn't parse."""
    tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|\S", expression.rstrip("*/-> \t\r"))
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in (t.lower() for t in tokens):
        if token in RANK:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if operand_next or not waiting:
                return None
            waiting.pop()
        elif token[0].isalnum() and operand_next:
            out.append(token)
            operand_next = False
        else:
            return None
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], bool | None] | None:
    """Licences that an expression names, and whether its terms are permissive (None: unknown); None if it doesn't parse."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], bool | None]] = []
    for token in order:
        if token not in RANK:
            plain = token.rstrip("+")
            listed = plain in LICENSES or plain.startswith("licenseref-")
            stack.append(({SAME.get(token, token) if listed else f"{OTHER}{token}"}, plain in PERMISSIVE if listed else None))
            continue
        (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
        if token == "with":  # an exception belongs to one licence
            if len(left) != 1 or len(right) != 1:
                return None
            stack.append(({f"{min(left)} with {min(right).removeprefix(OTHER)}"}, left_ok))
        else:
            decides = token == "or"  # one side that is permissive decides OR, one that isn't AND
            ok = decides if decides in (left_ok, right_ok) else None if None in (left_ok, right_ok) else not decides
            stack.append((left | right, ok))
    return stack[0]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                self.automaton.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, permissive, score)"""
        raw = (text or "").encode()
        words = raw.translate(SEPARATORS).split()
        line = " " + b" ".join(words).decode() + " "
        starts, tags, verdicts, base, labels, doubt = [], [], [], set(), set(), 1.0
        for end, (kind, label, size) in self.automaton.iter(line):
            if kind == "tag":
                tags.append(end)
                continue
            if kind == "base":
                starts.append(end - size)
                base.add(label)
            else:
                labels.add(label)
            doubt *= 1 - SURE[kind]
        if tags:
            ends = [m.end() for m in WORD.finditer(raw)]
            for end in tags:  # the words up to the tag's last, then the rest of its line
                rest = raw[ends[line.count(" ", 0, end) - 1] :].split(b"\n", 1)[0]
                if found := evaluate(rest.decode().lstrip(": \t")):
                    labels |= found[0]
                    verdicts.append(found[1])
                    doubt *= 1 - SURE["tag"]
        permissive = False if False in verdicts else True if verdicts and None not in verdicts else None
        places = [line.count(" ", 0, s + 1) - 1 for s in (min(starts), max(starts))] if starts else [None, None]
        return (len(words), len(starts), *places, ",".join(sorted(base)), ",".join(sorted(base | labels)), permissive, 1 - doubt)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, permissive, score."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, permissive boolean, score double"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.bool_(), pa.float64()]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [(i, *scanner.scan(t.as_py())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * len(kinds), kinds)], names)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
