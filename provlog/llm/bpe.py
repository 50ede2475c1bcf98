"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays of code points, without a regular expression:

1. each code point gets a class from a table built from the Unicode database, refined by what
   follows it: white space by whether it ends its run, an apostrophe by whether ``s t m d`` or
   ``re ve ll`` comes next;
2. an automaton reads classes from left to right and says where tokens start.  Each class is a
   function from states to states.  Functions compose associatively and only a few
   are ever reached, so each is a number and composition a lookup in a table;
3. a scan composes the functions of all code points before each one: in blocks side by side,
   then over the blocks' totals in the same way, then from the totals back into the blocks.
   The first code point of a text has a constant function, so many texts go through one scan;
4. the state before a code point and its class tell whether a token starts there.

Slices between boundaries are merged by rank, each distinct slice once for a worker, and
looked up from then on.  Byte offsets of the ids are kept; decoding checks that each id's
bytes start at its offset and fails where they don't.

A null text counts as empty and has no ids; a text of any length is read whole.  Rows that
repeat an identifier each have a row; null identifiers stay null.  Other columns aren't read,
so their names can't clash.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes: letter, number, other; the last white space of a run, blank or not; white space before white space or the end; an apostrophe that one or two letters complete.
LETTER, NUMBER, OTHER, BLANK, LAST, WHITE, SHORT, LONG = range(8)
#: States: a token starts next, whatever comes; within letters, numbers, others, white space; after a blank; one or two letters complete the token.
FRESH, LETTERS, NUMBERS, OTHERS, SPACE, AFTER_BLANK, ONE, TWO = range(8)
#: Distinct slices kept by a Python worker; beyond it the cache starts anew.
CACHE = 800_000
#: Rows handled at once.
ROWS = 128
#: Places of a block of the scan.
BLOCK = 32
# The code points of Unicode's White_Space property.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point, before it is refined."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = WHITE
    return table


def step(state: int, kind: int) -> tuple[int, bool]:
    """The automaton: the next state, and whether a token starts."""
    if kind in (SHORT, LONG) and state not in (OTHERS, AFTER_BLANK):
        return (ONE if kind == SHORT else TWO), True
    if kind == LETTER and state in (ONE, TWO):
        return (FRESH if state == ONE else ONE), False
    if kind == BLANK:
        return AFTER_BLANK, True
    if kind == LAST:
        return FRESH, True
    within = {LETTER: LETTERS, NUMBER: NUMBERS, WHITE: SPACE}.get(kind, OTHERS)
    return within, not (state == within or (state == AFTER_BLANK and kind != WHITE))


class Automaton:
    """Transition functions as numbers.

    of: the number of each class' function; compose[f, g]: first f, then g; start: the function
    that a text begins with, before its first code point; state: where start and f lead.
    """

    def __init__(self):
        states, kinds = range(8), range(8)
        each = [tuple(step(s, k)[0] for s in states) for k in kinds]
        begin = (FRESH,) * 8
        known = {f: i for i, f in enumerate(dict.fromkeys([*each, begin]))}
        for f in (found := list(known)):  # grows while it is read
            for g in each:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    found.append(h)
        size = len(found)
        self.compose = np.zeros((size, size), np.uint16)
        for i, f in enumerate(found):
            for j, g in enumerate(found):
                self.compose[i, j] = known[tuple(g[s] for s in f)]
        self.of, self.begin = np.array([known[f] for f in each], np.uint16), known[begin]
        self.state = np.array([f[FRESH] for f in found], np.uint8)
        self.starts = np.array([[step(s, k)[1] for k in kinds] for s in states])

    def scan(self, f: np.ndarray) -> np.ndarray:
        """The composition of all functions up to each place."""
        n = len(f)
        if n <= BLOCK:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.compose[out[i - 1], out[i]]
            return out
        x = np.concatenate((f, np.zeros(-n % BLOCK, f.dtype))).reshape(-1, BLOCK).T.copy()
        for i in range(1, BLOCK):
            x[i] = self.compose[x[i - 1], x[i]]
        total = self.scan(x[-1])
        x[:, 1:] = self.compose[total[:-1], x[:, 1:]]
        return x.T.reshape(-1)[:n]

    def boundaries(self, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Places in an array of code points at which tokens start; begin: those at which texts do."""
        n = len(points)
        kind = refined(points, begin)
        f = self.of[kind]
        f[begin] = self.compose[self.begin, f[begin]]
        before = np.full(n, FRESH, np.uint8)
        before[1:] = self.state[self.scan(f)[:-1]]
        before[begin] = FRESH
        return np.flatnonzero(self.starts[before, kind])


def refined(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The class of each code point, with what follows in its text taken into account."""
    n = len(points)
    kind = classes()[points]
    ends = np.zeros(n + 1, bool)
    ends[begin] = ends[n] = True
    white = kind == WHITE
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~ends[1:-1]
    mark = np.flatnonzero(points == 0x27)
    kind[last] = LAST
    kind[last & (points == 0x20)] = BLANK
    if len(mark):
        beyond = [ends[np.minimum(mark + i, n)] for i in (1, 2)]
        one, two = (np.where(out, 0, points[np.minimum(mark + i, n - 1)]) for i, out in ((1, beyond[0]), (2, beyond[0] | beyond[1])))
        at = lambda x, c: x == ord(c)
        kind[mark[at(one, "s") | at(one, "t") | at(one, "m") | at(one, "d")]] = SHORT
        kind[mark[((at(one, "r") | at(one, "v")) & at(two, "e")) | (at(one, "l") & at(two, "l"))]] = LONG
    return kind


@cache
def automaton() -> Automaton:
    return Automaton()


class Slices(dict):
    """Ids of slices as bytes of 32-bit numbers."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = np.array(self.merge(piece.encode()), np.int32).tobytes()
        return ids


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.known = Slices(self.merge)
        self.tokens = {b: a for a, b in self.ranks.items()}

    def widths(self) -> np.ndarray:
        """Bytes of each id."""
        width = np.zeros(len(self.tokens) and max(self.tokens) + 1, np.int64)
        for i, b in self.tokens.items():
            width[i] = len(b)
        return width

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the neighbours of lowest rank, leftmost first, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        import heapq

        n = len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # linked list of parts by start
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := ends[i]) >= n or ends[j] != end:
                continue
            alive[j], ends[i] = False, end
            if end < n:
                before[end] = i
                if (r := self.ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i and (r := self.ranks.get(piece[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        return tuple(self.ranks[piece[i : ends[i]]] for i in range(n) if alive[i])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; all texts go through one scan."""
        whole = "".join(t or "" for t in texts)
        size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        edge = np.concatenate(([0], np.cumsum(size)))
        starts = automaton().boundaries(points, edge[:-1][size > 0]) if len(points) else np.zeros(0, np.int64)
        upto = np.searchsorted(starts, edge).tolist()
        if len(self.known) > CACHE:
            self.known.clear()
        at = [*starts.tolist(), len(points)]
        pieces = [whole[a:b] for a, b in zip(at, at[1:])]
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, pieces[a:b])), np.int32) for a, b in zip(upto, upto[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


@cache
def encoder_of(path: str) -> Encoder:
    """One cache of slices for all tasks of a Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, ids[, offsets]): the ids of each text, and the byte at which each starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks)
        width = encoder.widths()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                each = encoder.encode_all(part.column(1).to_pylist())
                edges, ids = np.cumsum([0, *map(len, each)]), np.concatenate(each)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    upto = np.concatenate(([0], np.cumsum(width[ids])))
                    begin = upto[:-1] - np.repeat(upto[edges[:-1]], np.diff(edges))
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(begin, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "offsets"][: len(columns)])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>" + ", offsets array<long>" * offsets)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids, which must start at their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks)
        tokens, width = encoder.tokens.__getitem__, encoder.widths()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                decoded = [b"".join(map(tokens, x or ())) for x in part.column(1).to_pylist()]
                ids, begin = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
                counts = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.concatenate(([0], np.cumsum(width[ids])))
                first = np.concatenate(([0], np.cumsum(counts)))[:-1]
                if len(begin) != len(ids) or not np.array_equal(begin, upto[:-1] - np.repeat(upto[first], counts)):
                    raise ValueError("ids don't start at their offsets")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
