"""Packing tokenised documents into sequences: cutting stock by column generation.

A document's token ids, closed with the id ``END``, are cut into full sequences and one rest.
Pieces are counted by size class (lengths rounded up to a multiple of ``UNIT``; at most
``LENGTH / UNIT`` classes, whatever the data).  Pieces shorter than ``SHORT``, for which that would be much, are counted
by their exact length and first share bundles of ``SHORT`` ids, which then count as pieces.  The driver gets these two
histograms alone and solves the cutting-stock problem over each:

* the linear program over patterns (how many pieces of each class share a sequence) is
  solved by the simplex method; a knapsack dynamic program over the duals prices columns
  until none improves;
* multiplicities are rounded down, and what is left over is packed by greedy patterns.

Pieces are ranked in their class (row numbers within hash buckets plus the buckets'
offsets, so that no class meets in one task), and ranks are mapped to the patterns' slots.

A null text counts as empty and packs the closing id alone; a very long one is cut into as
many sequences as it fills, and a rest.  Rows that repeat an identifier, a text or both are
packed each for itself, ties in any order; null identifiers are packed like others.  An empty
table gives no rows.  Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.llm.common import written

LENGTH = 2048
UNIT = 16
SHORT = 128
END = 1
#: Units kept by a Python worker; beyond it the cache starts anew.
CACHE = 400_000
#: Bytes of text that are taken apart at once, and words that the tokenizer gets as one text.
BLOCK, JOINED = 1 << 20, 500
#: White space; letters and digits; marks, with and without the apostrophe, which belongs to some letters after it ('s).
BLANK, PLAIN, MARK, CLOSED = (np.isin(np.arange(256), list(c.encode())) for c in (" \t\n\v\f\r", ascii_letters + digits, punctuation, punctuation.replace("'", "")))
#: Second bytes of the letters from À to ÿ, after 0xC3: all but the two signs.
LATIN = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0) & ~np.isin(np.arange(256), [0x97, 0xB7])
WORD = re.compile(rb"[^ \t\n\v\f\r]*")
#: First bytes, in UTF-8, of the marks that compose with a letter from A to Z, or begin so when they are taken apart.
COMPOSING = (b"\xcc", b"\xcd")
#: Pieces ranked in one bucket, about.
BUCKET = 2000
Pattern = tuple[dict[int, int], int]


def blocks(body: bytes) -> Iterator[bytes]:
    """The text in parts of about BLOCK bytes, which cut no word."""
    at = 0
    while len(body) - at > BLOCK:
        end = WORD.match(body, at + BLOCK).end()
        yield body[at:end]
        at = end
    yield body[at:]


def units(bodies: list[bytes], whole: list[bool]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all bodies, cut where letters or digits meet marks but for those of whole bodies, and how many end with each body."""
    data = np.frombuffer(b"".join([part for body in bodies for part in (body, b" ")]), np.uint8)
    edges = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1)
    blank, first, last = BLANK[data], PLAIN[data], PLAIN[data]
    latin = np.flatnonzero(data == 0xC3)
    latin = latin[LATIN[data[latin + 1]]]  # a blank is last
    first[latin], last[latin + 1] = True, True
    cut = (last[:-1] & MARK[data[1:]]) | (CLOSED[data[:-1]] & first[1:])
    for i in np.flatnonzero(whole):
        cut[edges[i] - len(bodies[i]) - 1 : edges[i] - 1] = False
    start = ~blank
    start[1:] &= blank[:-1] | cut
    at, kept = np.flatnonzero(start), data[~blank]
    offsets = np.append((np.cumsum(~blank) - 1)[at], len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found.dictionary_encode(), np.searchsorted(at, edges)


class WordIds:
    """Ids of texts, as little-endian 32-bit bytes; those of units, words or parts of them, are cached.

    White space always ends a token of this kind of tokenizer, and so does the edge between a
    letter or digit and a mark, but for the apostrophe before a letter; texts are cut there in
    bulk, and a unit is looked up once in a block.  The tokenizer lower-cases; A-Z is lower-cased
    here, so that a unit is cached once.  Not so in texts that could hold the name of a special
    token, which case decides, and in words with combining marks: the tokenizer composes
    characters before it lower-cases them, and some compose with a small letter alone.  Such
    texts are cut at white space only.

    New units of letters alone go to the tokenizer many at once, since each of them is one
    word to it, whose last token alone has the suffix for the end of a word.  Where the number
    of such tokens is another, each is encoded by itself.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.small = Tokenizer(self.tokenizer.model)  # for letters a-z, which normalisation leaves as they are
        self.small.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def learn(self, new: list[bytes]) -> None:
        small, letters, alone = [], [], []
        for unit in new:
            text = unit.decode()
            (small if unit.isalpha() else letters if text.isalpha() else alone).append(text)
        for tokenizer, texts in (self.small, [t.lower() for t in small]), (self.tokenizer, letters):
            keys = small if texts is not letters else letters
            for at in range(0, len(texts), JOINED):
                ids = np.array(tokenizer.encode_batch_fast([" ".join(texts[at : at + JOINED])], add_special_tokens=False)[0].ids, "<u4")
                part, ends = keys[at : at + JOINED], np.flatnonzero(self.closes[ids]) * 4 + 4
                if len(ends) == len(part):
                    raw, ends = ids.tobytes(), [0, *ends.tolist()]
                    self.known.update((t.encode(), raw[a:b]) for t, a, b in zip(part, ends, ends[1:]))
                else:
                    alone += part
        for at in range(0, len(alone), 2000):
            part = alone[at : at + 2000]
            for text, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[text.encode()] = np.array(found.ids, "<u4").tobytes()

    @staticmethod
    def lowered(body: bytes) -> tuple[bytes, bool]:
        """The text, A-Z lower-cased where the ids stay the same, and whether its words must stay whole."""
        if b"<|" in body:
            return body, True
        if any(m in body for m in COMPOSING):
            return b" ".join([w if any(m in w for m in COMPOSING) else w.lower() for w in body.split()]), True
        return body.lower(), False

    def block(self, bodies: list[bytes], whole: list[bool]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        words, ends = units(bodies, whole)
        values = words.dictionary.to_pylist()
        self.learn([v for v in values if v not in self.known])
        found = [self.known[v] for v in values]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, at = np.cumsum(size) - size, words.indices.to_numpy()
        n = size[at]
        stop = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[at] - stop[:-1], n) + np.arange(stop[-1])]
        edges = stop[np.concatenate(([0], ends))]
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        of, bodies, whole, held = [], [], [], 0

        def flush() -> None:
            for i, ids in zip(of, self.block(bodies, whole)):
                out[i].append(ids)

        for i, text in enumerate(texts):
            body, one = self.lowered((text or "").encode())
            for part in blocks(body):
                if held and held + len(part) > BLOCK:
                    flush()
                    of, bodies, whole, held = [], [], [], 0
                of.append(i), bodies.append(part), whole.append(one)
                held += len(part)
        if bodies:
            flush()
        end = np.array([END], "<u4").tobytes()
        return [b"".join([*parts, end]) for parts in out]


@cache
def words_of(path: str) -> WordIds:
    """One cache for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document cut into full sequences and a rest."""
    step = 4 * LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), words.batch(part.column(1).to_pylist())):
                    for start in range(0, len(ids), step):
                        piece = ids[start : start + step]
                        rows.append((key, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(r[5], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = np.flatnonzero(sizes <= w)
        best[w] = best[w - 1]
        if len(fits):
            gain = values[fits] + best[w - sizes[fits]]
            if (top := int(gain.argmax())) is not None and gain[top] > best[w] + 1e-12:
                best[w], last[w] = gain[top], fits[top]
    took, w = np.zeros(len(sizes), int), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            took[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[room]), took


def cutting_stock(demand: dict[int, int], room: int, rounds: int = 5000) -> list[Pattern]:
    """Patterns {size: pieces} and how often each is used; together they hold the demand exactly."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), int)
    left = np.array([demand[int(s)] for s in sizes], int)
    if not len(sizes):
        return []
    basis, inverse = np.diag(room // sizes), np.diag(1 / (room // sizes))  # a column for each pattern
    for _ in range(rounds):
        value, column = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        change, used = (inverse * column).sum(axis=1), (inverse * left).sum(axis=1)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out_of = int(ratio.argmin())
        basis[:, out_of] = column
        row = inverse[out_of] / change[out_of]
        inverse = inverse - change[:, None] * row
        inverse[out_of] = row
    out: list[Pattern] = []

    def use(column: np.ndarray, times: int) -> None:
        nonlocal left
        times = min(times, *(left[column > 0] // column[column > 0]))
        if times > 0:
            left = left - times * column
            out.append(({int(s): int(n) for s, n in zip(sizes, column) if n}, int(times)))

    for k, x in enumerate((inverse * left).sum(axis=1)):
        use(basis[:, k], int(np.floor(x + 1e-6)))
    while left.any():  # less than one sequence for each pattern is left
        column, w = np.zeros(len(sizes), int), room
        for i in range(len(sizes) - 1, -1, -1):
            column[i] = min(left[i], w // sizes[i])
            w -= column[i] * sizes[i]
        use(column, int(left.max()))
    return out


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows with rank: the number of a piece in its class, from 0 and gapless."""
    buckets = max(1, total // BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(W.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(offsets, ["class", "bucket"]).withColumn("rank", F.col("base") + F.col("own")).drop("bucket", "own", "base")


def slots(demand: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(class, low, high, each, number) of the pieces of each class that patterns take, and how many sequences they make.

    Pieces from rank low on, and before high, go to the sequences from number on, each of them to one.
    """
    out, used, number = [], dict.fromkeys(demand, 0), 0
    for pattern, times in cutting_stock(demand, room):
        for size, n in pattern.items():
            out.append((size, used[size], used[size] + n * times, n, number))
            used[size] += n * times
        number += times
    return out, number


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset."""
    spark = docs.sparkSession
    of_size = F.when(F.col("length") < SHORT, -F.col("length")).otherwise(F.ceil(F.col("length") / UNIT)).cast("int")  # below zero: short
    cut = written(pieces(docs, tokenizer, id_col, text_col, keep_ids).withColumn("class", of_size), "pieces")
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # SHORT + LENGTH / UNIT rows at most
    kind, wide = "of int, low long, high long, each long, number long", SHORT // UNIT
    small, bundles = slots({-k: n for k, n in counts.items() if k < 0}, SHORT)
    demand = {k: n for k, n in counts.items() if k > 0}
    alone = demand.get(wide, 0)
    demand |= {wide: alone + bundles} if bundles else {}
    large, _ = slots(demand, LENGTH // UNIT)
    placed = ranked(cut, sum(counts.values()))
    first = F.broadcast(spark.createDataFrame([(-size, *rest) for size, *rest in small], kind))  # as large as the histogram
    placed = placed.join(first, F.expr("class = of AND rank >= low AND rank < high"), "left").withColumn("bundle", F.expr("number + (rank - low) DIV each"))
    short = F.col("class") < 0
    placed = placed.drop("of", "low", "high", "each", "number").withColumns({"rank": F.when(short, F.col("bundle") + alone).otherwise(F.col("rank")), "class": F.when(short, wide).otherwise(F.col("class"))})
    placed = placed.join(F.broadcast(spark.createDataFrame(large, kind)), F.expr("class = of AND rank >= low AND rank < high"))
    placed = placed.withColumn("sequence_id", F.expr("number + (rank - low) DIV each"))
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "sequence_id", "offset")
