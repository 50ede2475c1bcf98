"""Removing what earlier documents hold already: the part that words and bytes share.

A window is a fixed number of consecutive units (words or bytes) of one document; a unit is
removed if a window that covers it also starts in a document with a smaller identifier.
An operator names each window by a *seed*: a value that depends on the window's content
alone, and that neighbouring windows share.  Then, in Spark:

1. documents are dealt to chunks of about ``CHUNK`` bytes; a chunk sends each distinct seed
   once (twice if two of its documents hold it), packed in a row for each bucket;
2. seeds that two documents hold are sent back to their chunks;
3. a chunk sends the *segments* of those seeds (the units of neighbouring windows with one
   seed), each distinct segment once, with the smallest identifier that holds it;
4. all segments of a seed meet, so all occurrences of a window do; the operator compares
   them unit by unit and finds, for each window of a segment, the smallest identifier;
   chunks get back the places of their segments with a bit for each window that is repeated;
5. a document's windows are repeated if such a bit says so, or if a smaller document of its
   chunk holds the same segment.  Segments are matched by their bytes, never by a hash.

A seed that more than ``WIDE`` chunks hold (a phrase with many surroundings) is split: each of
its windows goes on by itself, under the hash of its whole content, so its segments don't
meet in one task; a window that is frequent itself costs an entry for each chunk.

Rows between stages: one law for all sizes.  Chunks and buckets are as many as the text has
``CHUNK`` bytes, and a row holds all seeds that a chunk has for a bucket, so there are at most
as many rows as chunks times buckets and at most as many as seeds (one for every 16 to 28
bytes).  The text crosses the network once: steps 1, 3 and 5 read the same exchange.

Null texts have no units.  Null identifiers are larger than all others and equal to each
other.  Rows that repeat an identifier don't remove each other's units; each has a row of
the result.  A very long text makes a chunk of its own.  An empty table gives no rows.
Columns other than the two named ones travel in one struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ID = np.iinfo(np.int64).max
#: Windows in a segment at most: a bit for each fits one word.
RUN = 32
#: Bytes of a seed.  Seeds only bring windows together; those that agree by chance are told apart by their units.
SEED = 6
SEED_MASK = np.uint64((1 << 8 * SEED) - 1)
#: Bytes of text in a chunk, about; bytes of text whose chunks share a task.
CHUNK, TASK = 3 << 20, 12 << 20
#: Chunks that hold a seed before its windows are sent one by one.  A window by itself takes some ten times the bytes of
#: its share of a segment; as many chunks as this keep the segments of a seed within some MB.
WIDE = 4096
ALL = 0xFFFFFFFF


class Units(Protocol):
    """The units of a chunk's documents, one after the other."""

    counts: np.ndarray

    def seeds(self) -> np.ndarray: ...

    def segment(self, first: int, last: int) -> bytes: ...

    def kept(self, first: int, keep: np.ndarray) -> bytes: ...


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def starts(change: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places starts a run; change: whether it differs from the place before, but for the first."""
    out = np.ones(n, bool)
    out[1:] = change
    return out


class Chunk:
    """Seeds and segments of one chunk; its rows are put in one order, whatever order they came in."""

    def __init__(self, table: pa.Table, units: Callable[[list[str | None]], Units], window: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i] or ""))
        self.table, self.window = table.take(pa.array(order, pa.int64())), window
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.units = units([texts[i] for i in order])
        del texts
        counts = self.units.counts
        self.edges = np.concatenate(([0], np.cumsum(counts)))
        total = int(self.edges[-1])
        seeds = self.units.seeds() if total else np.zeros(0, np.uint64)
        self.row_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        valid = np.arange(total) + window <= self.edges[1:][self.row_of] if total else np.zeros(0, bool)
        at = np.flatnonzero(valid)
        seed, row = seeds[at] & SEED_MASK, self.row_of[at]
        # Runs of neighbouring windows with one seed, cut at RUN windows.
        new = starts((seed[1:] != seed[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1), len(at))
        start = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate((start, [len(at)]))))
        start = np.flatnonzero(new | (since % RUN == 0))
        self.seed, self.row, self.first, self.n = seed[start], row[start], at[start], np.diff(np.concatenate((start, [len(at)])))

    def text(self, first: int, n: int) -> bytes:
        """The units of n windows from a place on."""
        return self.units.segment(first, first + n + self.window - 1)


def packed(seeds: np.ndarray) -> bytes:
    """Seeds as they are sent, SEED bytes each."""
    return np.ascontiguousarray(seeds, "<u8").view(np.uint8).reshape(-1, 8)[:, :SEED].tobytes()


def unpacked(table: pa.Table, name: str) -> np.ndarray:
    """Seeds of all rows."""
    sent = joined(table, name, np.uint8).reshape(-1, SEED)
    out = np.zeros((len(sent), 8), np.uint8)
    out[:, :SEED] = sent
    return out.reshape(-1).view("<u8")


def grouped(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bucket numbers and the positions in each."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, edge) if len(part)]


def joined(table: pa.Table, name: str, kind: Any) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def marked(
    docs: DataFrame,
    units: Callable[[list[str | None]], Units],
    minima: Callable[[list[bytes], np.ndarray], list[np.ndarray]],
    window: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole: bool = True,
) -> DataFrame:
    """rest (a struct of the other columns and the identifier), n_units, n_removed, n_spans, kept (binary), text.

    minima: for segments and the smallest identifier of each, the smallest identifier of each window.
    whole: kept has what is left of every document and text is null; else a document that loses
    nothing has its text as it was, and kept is null.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    chunks, tasks, most = max(1, -(-total // CHUNK)), max(1, -(-total // TASK)), WIDE
    text, rest = F.col(f"`{text_col}`").cast("string"), [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), text), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.struct(*rest).alias("rest"),
    ).repartition(tasks, "chunk")

    def send_seeds(table: pa.Table) -> pa.Table:
        number, chunk = table.column("chunk")[0].as_py(), Chunk(table, units, window)
        order = np.argsort(chunk.seed)
        seed, ids = chunk.seed[order], chunk.ids[chunk.row[order]]
        start = np.flatnonzero(starts(seed[1:] != seed[:-1], len(seed)))
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start) if len(start) else np.zeros(0, bool)
        seed = np.repeat(seed[start], 1 + several)
        out = [(b, number, packed(seed[p])) for b, p in grouped((seed % np.uint64(chunks)).astype(np.int64))]
        return rows_of(out, [("bucket", pa.int32()), ("chunk", pa.int32()), ("seeds", pa.binary())])

    def find_shared(table: pa.Table) -> pa.Table:
        seed = unpacked(table, "seeds")
        order = np.argsort(seed, kind="stable")
        start = np.flatnonzero(starts(seed[order][1:] != seed[order][:-1], len(seed)))
        held_by = np.diff(np.concatenate((start, [len(seed)])))
        many = np.empty(len(seed), np.int64)
        many[order] = np.repeat(held_by, held_by)
        out, at = [], 0
        for number, blob in zip(table.column("chunk").to_pylist(), table.column("seeds").to_pylist()):
            n = len(blob) // SEED
            found, held = seed[at : at + n], many[at : at + n]
            once = (held > 1) & starts(found[1:] != found[:-1], n)
            at += n
            if once.any():
                out.append((number, packed(found[once]), (held[once] > most).tobytes()))
        return rows_of(out, [("chunk", pa.int32()), ("seeds", pa.binary()), ("wide", pa.binary())])

    def send_segments(table: pa.Table, shared: pa.Table) -> pa.Table:
        kinds = [("bucket", pa.int32()), ("chunk", pa.int32()), *[(n, pa.binary()) for n in ("seeds", "ids", "at", "n", "sizes", "data")]]
        if not table.num_rows or not shared.num_rows:
            return rows_of([], kinds)
        number, chunk = table.column("chunk")[0].as_py(), Chunk(table, units, window)
        wanted, wide = unpacked(shared, "seeds"), joined(shared, "wide", bool)
        order = np.argsort(wanted)
        wanted, wide = wanted[order], wide[order]
        place = np.minimum(np.searchsorted(wanted, chunk.seed), len(wanted) - 1)
        inside = wanted[place] == chunk.seed
        best: dict[bytes, tuple[int, int, int]] = {}  # smallest identifier, place, windows (0: a window that goes by itself)
        seeds: list[int] = []
        each = zip(*(x[inside].tolist() for x in (chunk.seed, chunk.first, chunk.n, chunk.ids[chunk.row], wide[place])))
        for seed, first, n, d, alone in each:
            for at, of, text in [(first + j, 0, chunk.text(first + j, 1)) for j in range(n)] if alone else [(first, n, chunk.text(first, n))]:
                old = best.get(text)
                if old is None:
                    seeds.append(seed if of else xxhash.xxh64_intdigest(text) & int(SEED_MASK))
                    best[text] = (d, at, of)
                elif d < old[0]:
                    best[text] = (d, at, old[2])
        texts, seed = list(best), np.array(seeds, np.uint64)
        ids, at, n = (np.array([b[i] for b in best.values()], kind) for i, kind in enumerate((np.int64, np.uint32, np.uint8)))
        out = []
        for b, p in grouped((seed % np.uint64(chunks)).astype(np.int64)):
            part = [texts[i] for i in p.tolist()]
            out.append((b, number, packed(seed[p]), ids[p].tobytes(), at[p].tobytes(), n[p].tobytes(), np.array([len(t) for t in part], np.uint32).tobytes(), b"".join(part)))
        return rows_of(out, kinds)

    def compare(table: pa.Table) -> pa.Table:
        seed, ids, windows = unpacked(table, "seeds").tolist(), joined(table, "ids", np.int64), joined(table, "n", np.uint8)
        known: dict[bytes, int] = {}
        which, texts, seeds = [], [], []
        at = 0
        for sizes, data in zip(table.column("sizes").to_pylist(), table.column("data").to_pylist()):
            here = 0
            for size in np.frombuffer(sizes, np.uint32).tolist():
                text = data[here : here + size]
                here += size
                k = known.setdefault(text, len(texts))
                if k == len(texts):
                    texts.append(text)
                    seeds.append(seed[at])
                which.append(k)
                at += 1
        which = np.array(which, np.int64)
        smallest = np.full(len(texts), NO_ID)
        np.minimum.at(smallest, which, ids)
        # A seed with one segment alone has nothing to compare: all its windows have the segment's smallest identifier.
        _, group, size = np.unique(np.array(seeds, np.uint64), return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(size[group] > 1)
        lows = dict(zip(open_.tolist(), minima([texts[i] for i in open_.tolist()], smallest[open_]) if len(open_) else []))
        out, at = [], 0
        for number, blob, places in zip(table.column("chunk").to_pylist(), table.column("ids").to_pylist(), table.column("at").to_pylist()):
            n = len(blob) // 8
            masks = np.zeros(n, np.uint32)
            for i, (k, d) in enumerate(zip(which[at : at + n].tolist(), ids[at : at + n].tolist())):
                low = lows.get(k)
                masks[i] = (ALL if smallest[k] < d else 0) if low is None else int(np.packbits(low < d, bitorder="little").tobytes()[::-1].hex() or "0", 16)
            own = windows[at : at + n]
            told = (masks > 0) | (own == 0)
            at += n
            if told.any():
                out.append((number, np.frombuffer(places, np.uint32)[told].tobytes(), own[told].tobytes(), masks[told].tobytes()))
        return rows_of(out, [("chunk", pa.int32()), ("at", pa.binary()), ("n", pa.binary()), ("masks", pa.binary())])

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result([], table)
        chunk = Chunk(table, units, window)
        seed, first, n, ids = chunk.seed, chunk.first, chunk.n, chunk.ids[chunk.row]
        total = int(chunk.edges[-1])
        turn = np.zeros(total + 1, np.int64)

        def cover(a: int, w: int, mask: int) -> None:
            """Windows of a segment at a, by its bits."""
            if mask & ((1 << w) - 1) == (1 << w) - 1:
                turn[a] += 1
                turn[a + w + window - 1] -= 1
                return
            for j in range(w):
                if mask >> j & 1:
                    turn[a + j] += 1
                    turn[a + j + window] -= 1

        bits: dict[bytes, int] = {}  # of segments
        alone: dict[bytes, tuple[int, int]] = {}  # of windows that went by themselves: smallest identifier here, bit
        apart: set[int] = set()  # seeds of those
        if found.num_rows:
            told = [joined(found, c, kind).tolist() for c, kind in (("at", np.uint32), ("n", np.uint8), ("masks", np.uint32))]
            segment_at = np.searchsorted(first, np.array(told[0], np.int64), "right") - 1
            for at, w, mask, k in zip(*told, segment_at.tolist()):
                if w:
                    bits[chunk.text(at, w)] = mask
                else:
                    alone[chunk.text(at, 1)] = (int(chunk.ids[chunk.row_of[at]]), mask)
                    apart.add(int(seed[k]))
        # Only segments whose seed stands here twice, or that were told of, can be repeated.
        order = np.argsort(seed, kind="stable")
        same = seed[order][1:] == seed[order][:-1]
        look = np.zeros(len(seed), bool)
        look[order[1:][same]] = look[order[:-1][same]] = True
        if found.num_rows:
            look[segment_at] = True
        look = np.flatnonzero(look)
        texts = [chunk.text(a, w) for a, w in zip(first[look].tolist(), n[look].tolist())]
        lowest: dict[bytes, int] = {}
        for text, d in zip(texts, ids[look].tolist()):
            if d < lowest.get(text, NO_ID + 1):
                lowest[text] = d
        for text, a, w, d, s in zip(texts, first[look].tolist(), n[look].tolist(), ids[look].tolist(), seed[look].tolist()):
            if d > lowest[text]:
                cover(a, w, ALL)
            elif s in apart:
                for j in range(w):
                    low, bit = alone.get(chunk.text(a + j, 1), (d, 0))
                    if d > low or bit:
                        cover(a + j, 1, 1)
            elif mask := bits.get(text):
                cover(a, w, mask)
        gone = np.cumsum(turn[:-1]) > 0
        out = []
        for a, b in zip(chunk.edges[:-1].tolist(), chunk.edges[1:].tolist()):
            lost = gone[a:b]
            spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
            out.append((b - a, int(lost.sum()), spans, chunk.units.kept(a, ~lost) if whole or spans else None))
        return result(out, chunk.table)

    def result(out: list[tuple], table: pa.Table) -> pa.Table:
        found = rows_of(out, [("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        texts = [None if whole or o[2] else t for o, t in zip(out, table.column("text").to_pylist())]
        return found.add_column(0, "rest", table.column("rest").combine_chunks()).append_column("text", pa.array(texts, pa.string()))

    many = ", ".join(f"{n} binary" for n in ("seeds", "ids", "at", "n", "sizes", "data"))
    seeds = rows.groupBy("chunk").applyInArrow(send_seeds, "bucket int, chunk int, seeds binary").repartition(tasks, "bucket")
    shared = seeds.groupBy("bucket").applyInArrow(find_shared, "chunk int, seeds binary, wide binary")
    by_chunk = rows.groupBy("chunk")
    segments = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_segments, f"bucket int, chunk int, {many}").repartition(tasks, "bucket")
    bits = segments.groupBy("bucket").applyInArrow(compare, "chunk int, at binary, n binary, masks binary")
    numbers = [T.StructField(c, T.LongType()) for c in ("n_units", "n_removed", "n_spans")]
    kinds = T.StructType([rows.schema["rest"], *numbers, T.StructField("kept", T.BinaryType()), T.StructField("text", T.StringType())])
    return by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(remove, kinds)


def rows_of(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def deduplicated(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """The documents with all their columns in their order, from marks taken with whole=False."""
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
