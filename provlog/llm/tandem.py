"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A tandem repeat is a stretch of two equal halves; a run is a stretch of words with smallest period q, of at least
two periods and ``least`` words, that no neighbour extends.

* Texts are sieved first, without loss: every word of a run stands twice in its stretch, and a run of
  ``least`` words holds some ``least / 2`` consecutive words twice.  Stretches that can't hold a run are left out.
* What is left of many documents is one string, with a different end mark for each stretch.  Ranks of its substrings of
  lengths 1, 2, 4 and so on give its suffix array, which stands for the suffix tree, and the longest common extension of any two places.
* Lempel-Ziv blocks, and extensions from their bounds, find tandem repeats that cover the leftmost place of each kind.
* Walks along suffix links (from the rank of a place to that of the next) add the other rotations of
  each: the vocabulary of all tandem repeats.  A kind's locus is its interval of the suffix array.
* The places in these intervals, in order, merge into runs; of runs with the same ends the smallest period counts.

Each document is worked out by itself, in batches of about ``WORDS`` words, so nothing is shuffled.  A null text counts as empty
and has no runs.  A very long text is a batch of its own and needs some 4 bytes for each word and each level of ranks,
for the stretches that the sieve leaves.  Identifiers may be null or repeat; rows are worked out one by one.
An empty table gives no rows.  Only the two named columns are read, so other names can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words of a batch, about.
WORDS = 200_000
#: Sieving goes on so often at most; each round is without loss.
ROUNDS = 4
NONE = np.zeros(0, np.int64)
MIX = np.uint64(0x9E3779B97F4A7C15)
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Ranked:
    """Ranks of all substrings of lengths 2**level; equal substrings share the place of the first of them in the suffix array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ranks, active = self.grouped(symbols[order], order, np.zeros(n, np.int64), n)
        levels, width = [ranks], 1
        while len(active):
            now = levels[-1]
            key = now[active].astype(np.int64) * n + now[active + width]
            order = np.argsort(key)
            at = active[order]
            ranks, active = self.grouped(key[order], at, now[at], n, now)
            levels.append(ranks)
            width *= 2
        self.levels, self.n = np.stack(levels), n
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[levels[-1]] = np.arange(n)

    @staticmethod
    def grouped(keys: np.ndarray, at: np.ndarray, old: np.ndarray, n: int, now: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ranks after sorting places ``at`` by keys, and the places that aren't told apart yet."""
        i = np.arange(len(at))
        new = np.append(True, keys[1:] != keys[:-1])
        of_old = np.append(True, old[1:] != old[:-1])
        first = np.maximum.accumulate(np.where(new, i, 0))
        base = np.maximum.accumulate(np.where(of_old, i, 0))
        ranks = np.empty(n, np.int32) if now is None else now.copy()
        ranks[at] = old + first - base
        alone = new & np.append(new[1:], True)
        return ranks, at[~alone]

    def same(self, level: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether 2**level symbols from i and from j on are the same; False where either begins before the string."""
        ok = (i >= 0) & (j >= 0) & (level < len(self.levels))
        out = np.zeros(len(i), bool)
        out[ok] = self.levels[level[ok], i[ok]] == self.levels[level[ok], j[ok]]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from two different places on are the same."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            n += (ranks[i + n] == ranks[j + n]).astype(np.int64) << level
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to two different places, which count, are the same."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, a, b = self.levels[level], i - n - (1 << level) + 1, j - n - (1 << level) + 1
            n += ((a >= 0) & (b >= 0) & (ranks[np.maximum(a, 0)] == ranks[np.maximum(b, 0)])).astype(np.int64) << level
        return n


def blocks(r: Ranked) -> np.ndarray:
    """Beginnings of Lempel-Ziv blocks, and the end: each is the longest stretch that begins earlier too, or one symbol."""
    before, after, stack = [-1] * r.n, [-1] * r.n, []
    for x in r.suffixes.tolist():  # the nearest suffixes, on both sides, that begin earlier
        while stack and stack[-1] > x:
            after[stack.pop()] = x
        if stack:
            before[x] = stack[-1]
        stack.append(x)
    longest = np.zeros(r.n, np.int64)
    for other in (np.array(before), np.array(after)):
        at = np.flatnonzero(other >= 0)
        longest[at] = np.maximum(longest[at], r.forward(at, other[at]))
    steps, out, at = np.maximum(longest, 1).tolist(), [], 0
    while at < r.n:
        out.append(at)
        at += steps[at]
    return np.array([*out, r.n])


def covering(r: Ranked, bounds: np.ndarray) -> Runs:
    """Stretches (start, end, period) of two periods or more around the bounds of blocks; they hold the leftmost place of every kind."""
    size = np.diff(bounds)
    inner, two = size[:-1], size.copy()
    two[:-1] += size[1:]
    k = np.concatenate([ramps(inner) + 1, ramps(two) + 1])
    later = np.concatenate([np.repeat(bounds[1:-1], inner), np.repeat(bounds[:-1], two) + ramps(two) + 1])
    keep = later < r.n
    k, later = k[keep], later[keep]
    earlier = later - k
    # A tandem repeat of period k agrees over k / 2 symbols at least, on one side of the bound.
    level = np.frexp((k + 1) // 2)[1] - 1
    width = np.left_shift(1, level)
    may = r.same(level, earlier, later) | r.same(level, earlier - width, later - width)
    k, earlier, later = k[may], earlier[may], later[may]
    right, left = r.forward(earlier, later), r.backward(earlier - 1, later - 1)
    found = left + right >= k
    return distinct((earlier - left)[found], (later + right)[found], k[found])


def distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Runs:
    """Each stretch once, with its smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    return start[first], end[first], period[first]


class Least:
    """Smallest values of stretches of an array, by tables of powers of two; finds how far values stay large."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while len(self.tables[-1]) > (1 << len(self.tables) - 1):
            last, step = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(np.minimum(last[:-step], last[step:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on with a smaller value, or the array's length."""
        at = at.copy()
        for level in range(len(self.tables) - 1, -1, -1):
            table = self.tables[level]
            ok = at < len(table)
            at += (ok & (table[np.minimum(at, len(table) - 1)] >= least)).astype(np.int64) << level
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` with a smaller value, or -1."""
        at = at.copy()
        for level in range(len(self.tables) - 1, -1, -1):
            table, begin = self.tables[level], at - (1 << level) + 1
            ok = (begin >= 0) & (begin < len(table))
            at -= (ok & (table[np.clip(begin, 0, len(table) - 1)] >= least)).astype(np.int64) << level
        return at


def located(r: Ranked, found: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every tandem repeat of a kind that the stretches hold, wherever it stands."""
    start, end, period = found
    # Suffix links: from each place to the next, as long as the stretch holds the repeat; after a period kinds come again.
    places = end - start - 2 * period + 1
    own = np.repeat(start, places) + ramps(places), np.repeat(period, places)
    steps = np.minimum(period, places)
    at, k = np.repeat(start, steps) + ramps(steps), np.repeat(period, steps)
    common = np.zeros(r.n + 1, np.int64)  # of neighbours in the suffix array; at r the one before and r
    common[1 : r.n] = r.forward(r.suffixes[:-1], r.suffixes[1:])
    rank = r.levels[-1][at].astype(np.int64)
    shared = (common[rank] >= 2 * k) | (common[rank + 1] >= 2 * k)
    rank, k = rank[shared], k[shared]
    if not len(rank):
        return own
    least = Least(common)
    low, high = least.left(rank, 2 * k), least.right(rank + 1, 2 * k)
    locus = np.unique(np.stack([low, high, k]), axis=1)
    each = locus[1] - locus[0]
    return np.concatenate([own[0], r.suffixes[np.repeat(locus[0], each) + ramps(each)]]), np.concatenate([own[1], np.repeat(locus[2], each)])


def runs_of(symbols: np.ndarray) -> Runs:
    """(start, end, period) of the runs, of two periods or more, of a string whose stretches end in marks that stand once."""
    if not len(symbols):
        return NONE, NONE, NONE
    r = Ranked(symbols)
    found = covering(r, blocks(r))
    if not len(found[0]):
        return found
    place, period = located(r, found)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.append(True, (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(place) - 1)
    return distinct(place[first], place[last] + 2 * period[first], period[first])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return out


def sieved(ids: np.ndarray, part: np.ndarray, least: int) -> np.ndarray:
    """Places, in order, of the stretches that can hold runs; part: a number for each place's document."""
    at, gram = np.arange(len(ids)), max(1, least // 2)
    for _ in range(ROUNDS):
        if len(at) < least:
            return at[:0]
        new = np.append(True, (np.diff(at) > 1) | (np.diff(part[at]) != 0))
        stretch = np.cumsum(new)
        end = np.append(np.flatnonzero(new)[1:], len(at))[stretch - 1]
        # Consecutive words that stand twice in their stretch.
        mixed = (ids[at].astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        grams = mixed[: len(at) - gram + 1].copy()
        for i in range(1, gram):
            grams = grams * MIX + mixed[i : len(at) - gram + 1 + i]
        whole = np.arange(len(grams)) + gram <= end[: len(grams)]
        twice = np.zeros(len(grams), bool)
        twice[whole] = repeated(grams[whole] + stretch[: len(grams)][whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        holds = np.zeros(stretch[-1] + 1, bool)
        holds[stretch[: len(grams)][twice]] = True
        keep = holds[stretch]
        at, stretch = at[keep], stretch[keep]
        if not len(at):
            return at
        twice = repeated(stretch.astype(np.int64) * (int(ids.max()) + 1) + ids[at])
        if twice.all():
            break
        at = at[twice]
    new = np.append(True, (np.diff(at) > 1) | (np.diff(part[at]) != 0))
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    return at[np.repeat(size >= least, size)]


def found_in(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of the runs of documents that follow each other in ids, by document, start and period."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    at = sieved(ids, part, least)
    if not len(at):
        return NONE, NONE, NONE, NONE
    new = np.append(True, (np.diff(at) > 1) | (np.diff(part[at]) != 0))
    shift = np.cumsum(new) - 1  # an end mark after each stretch
    symbols = np.arange(len(at) + shift[-1] + 1) + int(ids.max()) + 1
    symbols[np.arange(len(at)) + shift] = ids[at]
    source = np.zeros(len(symbols), np.int64)
    source[np.arange(len(at)) + shift] = at
    start, end, period = runs_of(symbols)
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    place, length = source[start], end - start
    order = np.lexsort((period, place))
    place, length, period = place[order], length[order], period[order]
    of = part[place]
    return of, place - (np.cumsum(sizes) - sizes)[of], length, period


def split(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, and how many each document has."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(d) for d in docs], np.int64)
    return np.fromiter((number[w] for d in docs for w in d), np.int64, int(sizes.sum())), sizes


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, starts, lengths, periods, collapsed): a text's runs by start and period, and the text without what
    repeats: words that some run holds after its first period are left out, the others are joined by single spaces."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
        keys, docs, n = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode().split()
                keys.append(batch.column(0)[i].as_py())
                docs.append(words)
                n += len(words) + 1
                if n >= WORDS:
                    yield keys, docs
                    keys, docs, n = [], [], 0
        if keys:
            yield keys, docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, docs in batched(batches):
            ids, sizes = split(docs)
            of, start, length, period = found_in(ids, sizes, least)
            ends = np.searchsorted(of, np.arange(len(docs) + 1))
            texts = []
            for d, (words, low, high) in enumerate(zip(docs, ends, ends[1:])):
                if low < high:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, start[low:high] + period[low:high], 1)
                    np.add.at(depth, start[low:high] + length[low:high], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                texts.append(b" ".join(words).decode())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (start, length, period)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), *lists, pa.array(texts, pa.string())], ["id", "n_words", "starts", "lengths", "periods", "collapsed"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def with_tails(key: Column, text: Column) -> Column:
    """Every tenth text, by a checksum of its key, with its words from some place on repeating their first few; the others as they are."""
    h = F.crc32(F.encode(key.cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " "))

    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), edited), 0)).otherwise(text)
