"""Substring deduplication of words by recompression.

Each round names pairs and runs of neighbouring symbols.  Names are split into left and right
by a bit of their hash; a left symbol before a right one is always joined to a new symbol,
named by the hash of both; of what is left, a run of equal symbols becomes one, named by the
hash of the symbol and the run's length.  A name is a function of the names in it, so it is
global without a dictionary, and rounds need no exchange: equal substrings get equal symbols
wherever they stand, but for a few at their ends.

With each symbol go the words that decide it (its own, and for what stays unpaired those of
its neighbours).  A window of 13 words holds a symbol for sure if it holds all those words,
so equal windows hold the same symbols.  A window's seed is the name of one of the upper
symbols (from the second round on) that it holds, the one whose name ranks highest, sharpened by
the words beside it that every such window holds: half of the rest, on the side that has more
room.  A window that holds no such symbol is its own seed.  Shared symbols reveal repeats; :mod:`provlog.llm.repeats`
brings their words together, and windows are verified word by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from provlog.llm.repeats import NO_ID, deduplicated, marked, mix

WINDOW = 13
#: Rounds of naming, and the first whose symbols are seeds: one of the third covers up to eight words; higher ones seldom fit a window.
ROUNDS, LEAST = 3, 2
#: More words than a window has: what the edge of a document decides, no window holds.
FAR = 1 << 20
#: Bytes between words, and words that are named at once.
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BLOCK = 1 << 15
A, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def names(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit names of the words that begin at these places, each with the blank after it; the last place is the end."""
    first, size = begin[:-1], np.diff(begin)
    powers = np.full(int(size.max(initial=1)), np.uint64(BASE))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    out = np.zeros(len(first), np.uint64)
    for at in range(0, len(first), BLOCK):
        a, n = first[at : at + BLOCK], size[at : at + BLOCK]
        part = data[a[0] : a[-1] + n[-1]]
        out[at : at + BLOCK] = np.add.reduceat(part * powers[np.arange(len(part)) - np.repeat(a - a[0], n)], a - a[0])
    return mix(out)


def together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * A + y)


class Symbols:
    """A string of symbols: name, the words [low, high) that decide each, and whether it begins a document."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray):
        self.name, self.low, self.high, self.first = name, low, high, first

    def round(self, salt: int) -> Symbols:
        """The string after pairs, and runs of what isn't paired, have got their names."""
        name, first, n = self.name, self.first, len(self.name)
        right = (mix(name + np.uint64(salt)) & np.uint64(1)).astype(bool)
        joins, taken = np.zeros(n, bool), np.zeros(n, bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        taken[1:] = joins[:-1]
        free, head = ~(joins | taken), ~taken
        head[1:] &= ~(free[1:] & free[:-1] & (name[1:] == name[:-1]) & ~first[1:])
        at = np.flatnonzero(head)
        end = np.concatenate((at[1:], [n])) - 1
        pair, new = joins[at], name[at]
        new[pair] = together(new[pair], name[at[pair] + 1])
        run = np.flatnonzero(~pair & (end > at))
        new[run] = together(new[run] ^ A, (end[run] - at[run] + 1).astype(np.uint64))
        low, high = np.minimum(self.low[at], self.low[end]), np.maximum(self.high[at], self.high[end])
        # What isn't paired depends on its neighbours too; on one more where the neighbour is equal, but paired.
        alone = np.flatnonzero(~pair)
        a, b = at[alone], end[alone] + 1
        inside = np.minimum(b, n - 1)
        left, right = np.maximum(a - 1 - (name[a - 1] == name[a]), 0), np.minimum(inside + (name[inside] == name[a]), n - 1)
        low[alone] = np.where(first[a], -FAR, np.minimum(low[alone], self.low[left]))
        high[alone] = np.where((b < n) & ~first[inside], np.maximum(high[alone], self.high[right]), self.low[a] + FAR)
        return Symbols(new, low, high, first[at])


class Spans:
    """Hashes of any words that stand together."""

    def __init__(self, name: np.ndarray):
        n = len(name)
        up, self.down = np.full(n, np.uint64(BASE)), np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
        up[:1] = self.down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(name * up, dtype=np.uint64)))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.down[first])


class Words:
    """Units of :func:`provlog.llm.repeats.marked`: words, unchanged."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join([part for text in raw for part in (text, b" ")]), np.uint8)
        blank = BLANK[data]
        start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # the blank after each word
        edge = np.searchsorted(end, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))
        del raw
        self.counts = np.diff(edge, prepend=0)
        keep = ~blank
        keep[end] = True
        size = end - start + 1  # with the one blank that stays
        data, blank = data[keep], blank[keep]
        data[blank] = ord(" ")
        self.body = data.tobytes()
        self.begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        self.name = names(data, self.begin)

    def rounds(self) -> list[Symbols]:
        """The strings of symbols after each round."""
        n = len(self.name)
        first, begin = np.zeros(n, bool), np.cumsum(self.counts) - self.counts
        first[begin[self.counts > 0]] = True
        low = np.arange(n, dtype=np.int32)
        strings = [Symbols(self.name, low, low + np.int32(1), first)]
        for level in range(1, ROUNDS + 1):
            strings.append(strings[-1].round(level))
        return strings[1:]

    def seeds(self) -> np.ndarray:
        n, spans = len(self.name), Spans(self.name)
        # Symbols by how many words decide them: place, rank, and the seeds with the words before and after.
        by_size: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(WINDOW + 1)]
        for s in self.rounds()[LEAST - 1 :]:
            size = s.high - s.low
            held = np.flatnonzero(size <= WINDOW)
            held = held[np.argsort(size[held], kind="stable")]
            cut = np.searchsorted(size[held], np.arange(WINDOW + 2))
            for w in range(1, WINDOW + 1):
                if len(k := held[cut[w] : cut[w + 1]]):
                    at, rank = s.low[k].astype(np.int64), mix(s.name[k]) | np.uint64(1)
                    before, after = (WINDOW - w + 1) // 2, (WINDOW - w) // 2 + 1 if w < WINDOW else 0
                    left = mix(rank + spans.of(np.maximum(at - before, 0), at))
                    right = mix((rank ^ A) + spans.of(at + w, np.minimum(at + w + after, n)))
                    by_size[w].append((at, rank, left, right, np.full(len(k), before, np.int8)))
        best, seed = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        here = [np.zeros(n, kind) for kind in (np.uint64, np.uint64, np.uint64, np.int8)]
        for w in range(1, WINDOW + 1):  # a symbol that w words decide may stand up to WINDOW - w words into a window
            for at, *found in by_size[w]:
                k = np.flatnonzero(found[0] > here[0][at])
                for own, x in zip(here, found):
                    own[at[k]] = x[k]
            ahead = WINDOW - w
            if ahead < n:
                i = np.flatnonzero(here[0][ahead:] > best[: n - ahead])
                q = i + ahead
                best[i] = here[0][q]
                seed[i] = np.where(here[3][q] <= ahead, here[1][q], here[2][q])
        none = np.flatnonzero(best == 0)
        none = none[none + WINDOW <= n]
        seed[none] = spans.of(none, none + WINDOW)
        return seed

    def segment(self, first: int, last: int) -> bytes:
        return self.body[self.begin[first] : self.begin[last] - 1]

    def kept(self, first: int, keep: np.ndarray) -> bytes:
        if not len(keep):
            return b""
        body = self.segment(first, first + len(keep))
        if keep.all():
            return body
        words = body.split(b" ")
        return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def minima(segments: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment, the smallest identifier that holds its words."""
    smallest: dict[bytes, int] = {}
    each = []
    for text, d in zip(segments, ids.tolist()):
        words = text.split(b" ")
        windows = [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        each.append(windows)
        for w in windows:
            if d < smallest.get(w, NO_ID):
                smallest[w] = d
    return [np.array([smallest.get(w, NO_ID) for w in windows], np.int64) for windows in each]


def substring_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """rest, n_units (words), n_removed, n_spans, kept (words joined by one blank, binary), text: see :func:`provlog.llm.repeats.marked`."""
    return marked(docs, Words, minima, WINDOW, id_col, text_col, whole)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns; where words were removed, text holds those kept, joined by one blank."""
    return deduplicated(docs, substring_marks(docs, id_col, text_col, whole=False), text_col)
