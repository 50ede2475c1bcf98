"""Suffix-array deduplication of bytes: interval expansion on a Burrows-Wheeler transform.

Spark deals the text: each window of 50 bytes has as seed the smallest hash of its 20-byte
strings, so all occurrences of a window meet in one task (:mod:`provlog.llm.repeats`).
There the distinct segments of seeds that have several are indexed together:

* suffixes are sorted by their first 56 bytes (rank doubling over packed bytes), which
  gives the Burrows-Wheeler transform;
* common-prefix lengths are derived by increasing value: the interval of every string of
  length l is extended backward by each byte before it, breadth first, and where the end of
  an extended interval has no value yet, it gets l and the interval goes on to the next
  round.  The rounds stop at the threshold of 50 bytes; what has no value by then shares 50
  bytes or more with its neighbour.

Each group of suffixes that share 50 bytes has one smallest identifier.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from provlog.llm.repeats import marked, mix

WINDOW = 50
#: Shorter strings bring windows together that have little else in common; longer ones make more seeds.
GRAM = 20
PACKED = 7
A = np.uint64(0x9E3779B97F4A7C15)
#: Positions hashed at once, so that arrays stay in the processor's cache.
BLOCK = 1 << 15


def window_seeds(raw: np.ndarray) -> np.ndarray:
    """For each window of the bytes, the smallest hash of its strings of GRAM bytes."""
    x = raw.astype(np.uint64)
    for shift in (1, 2, 4):  # eight bytes from each position on
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    x = mix(mix(x[:-12] * A + x[8:-4]) * A + x[12:])
    span, width = WINDOW - GRAM + 1, 1
    while width < span:  # smallest of span neighbours
        step = min(width, span - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


class Bytes:
    """Units of :func:`provlog.llm.repeats.marked`: bytes of UTF-8."""

    def __init__(self, texts: list[str | None]):
        each = [(t or "").encode() for t in texts]
        self.counts = np.array([len(b) for b in each], np.int64)
        self.body = b"".join(each)

    def seeds(self) -> np.ndarray:
        size = len(self.body)
        raw = np.frombuffer(self.body + bytes(WINDOW), np.uint8)
        out = np.empty(size, np.uint64)
        for at in range(0, size, BLOCK):
            n = min(BLOCK, size - at)
            out[at : at + n] = window_seeds(raw[at : at + n + WINDOW - 1])
        return out

    def segment(self, first: int, last: int) -> bytes:
        return self.body[first:last]

    def kept(self, first: int, keep: np.ndarray) -> bytes:
        part = self.body[first : first + len(keep)]
        return part if keep.all() else np.frombuffer(part, np.uint8)[keep].tobytes()


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the first depth symbols from each on (or some more); symbols are below 2**9."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for i in range(PACKED):
        key = (key << 9) | np.concatenate((text[i:], np.zeros(min(i, n), text.dtype))).astype(np.int64)
    done = PACKED
    while True:
        order = np.argsort(key)  # neither ranks nor intervals depend on the order of equal keys
        if done >= depth:
            return order
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        key = rank * (n + 1) + np.concatenate((rank[done:] + 1, np.zeros(min(done, n), np.int64)))
        done *= 2


def prefix_breaks(bwt: np.ndarray, threshold: int) -> np.ndarray:
    """breaks[j]: suffixes j - 1 and j in order share fewer than threshold symbols."""
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    step[by_symbol] = np.arange(n)
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    later, earlier = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # neighbours with the same symbol before them
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    breaks = np.zeros(n + 1, bool)
    breaks[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(threshold):
        size = high - low + 1
        ends = np.cumsum(size)
        rows = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
        start = np.sort(step[rows[earlier[rows] < np.repeat(low, size)]])
        end = np.sort(step[rows[later[rows] > np.repeat(high, size)]])
        new = ~breaks[end + 1]
        low, high = start[new], end[new]
        breaks[high + 1] = True
        if not len(low):
            break
    return breaks[:n]


def minima(segments: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment, the smallest identifier that holds its bytes."""
    size = np.array([len(s) for s in segments], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    text[begin[1:] - 1] = 0  # separators
    order = suffix_order(text, WINDOW)
    breaks = prefix_breaks(text[order - 1], WINDOW)
    owner = np.repeat(np.arange(len(segments)), size + 1)
    start = np.flatnonzero(breaks)
    # Suffixes too short to start a window share 50 symbols only across a separator; they don't count.
    whole = order + WINDOW <= begin[owner[order] + 1] - 1
    smallest = np.minimum.reduceat(np.where(whole, ids[owner[order]], np.iinfo(np.int64).max), start)
    low = np.empty(len(text), np.int64)
    low[order] = np.repeat(smallest, np.diff(np.concatenate((start, [len(text)]))))
    return [low[a : a + n - WINDOW + 1] for a, n in zip(begin[:-1].tolist(), size.tolist())]


def byte_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rest, n_units (bytes), n_removed, n_spans, kept (binary; what is left need not be valid UTF-8), text (null)."""
    return marked(docs, Bytes, minima, WINDOW, id_col, text_col)
