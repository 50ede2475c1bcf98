"""SentencePiece encoding and decoding (the BPE kind), with every piece's place in the original bytes.

A text is normalised by the model's compiled character map: at each place the longest prefix that the map
holds is replaced, anything else is kept character by character, and each normalised byte remembers the
byte it came from.  Spaces become ``▁``.  Normalised text falls into chunks that no piece of the vocabulary
crosses: a run of spaces with what follows it, and characters that stand in no longer piece.  A chunk's
pieces are found once for a worker and kept, by merging neighbours with the best score, leftmost first.
Characters that aren't in the vocabulary become byte pieces, or the unknown id where the model has none.

A null text counts as empty and has no ids.  A very long text is one row of a batch and is held some ten times over;
a chunk without spaces takes n log n.  Identifiers may be null or repeat: rows are encoded one by one.  An empty
table gives no rows.  Only the two named columns are read, so other names can't clash.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Fixed values of the model's format: kinds of pieces, and the text of an unknown one.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT = " ⁇ "
#: Chunks kept by a worker, and characters of a chunk that is kept; beyond the first the cache starts anew.
CACHE, KEPT = 300_000, 64
ROWS = 256
NEVER = float("inf")


def messages(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of an encoded message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled map of character sequences: a trie over bytes in one array of units, and the texts that its leaves name.

    A unit holds an offset to its children, a label and whether a value belongs to it.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
        self.texts = compiled[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes the longest prefix has, and what replaces them."""
        units, best = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & ((1 << 31) - 1))
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


@dataclass
class Model:
    """Vocabulary and rules of a model's file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    byte_fallback: bool = False
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    characters: CharacterMap | None = None

    @staticmethod
    def load(path: str) -> Model:
        m = Model()
        with open(path, "rb") as file:
            data = file.read()
        for number, value in messages(data):
            if number == 1:
                f = dict(messages(value))
                m.pieces.append(f[1].decode())
                m.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                m.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(messages(value))
                if f.get(3, 1) != 2:
                    raise ValueError(f"{path}: not a model of the BPE kind")
                m.byte_fallback = bool(f.get(35, 0))
                if f.get(24, 0):
                    raise ValueError(f"{path}: spaces after words aren't supported")
            elif number == 3:
                f = dict(messages(value))
                m.dummy_prefix, m.trim, m.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
                m.characters = CharacterMap(f[2]) if f.get(2) else None
        return m


def normalised(m: Model, text: str) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its bytes, and its end, the original byte it came from."""
    data, out, source = text.encode(), bytearray(), []
    space = SPACE.encode() if m.escape else b" "

    def prefix(at: int) -> tuple[int, bytes]:
        found = m.characters.longest(data, at) if m.characters is not None else None
        if found is not None:
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    at = 0
    if m.trim:
        while at < len(data):
            n, new = prefix(at)
            if new != b" ":
                break
            at += n
    if at == len(data):
        return "", np.zeros(1, np.int64)
    if m.dummy_prefix:
        out += space
        source += [at] * len(space)
    blank = m.trim
    while at < len(data):
        n, new = prefix(at)
        while blank and new[:1] == b" ":
            new = new[1:]
        if new:
            for i in range(len(new)):
                byte = new[i : i + 1]
                byte = space if byte == b" " else byte
                out += byte
                source += [at] * len(byte)
            blank = new[-1:] == b" "
        at += n
        if not m.trim:
            blank = False
    if m.trim:
        while out.endswith(space):
            del out[len(out) - len(space) :]
            at = source[len(out)]
            del source[len(out) :]
    source.append(at)
    return out.decode(), np.array(source, np.int64)


class Pairs:
    """Which neighbours merge, as an open hash table, to merge many short chunks side by side."""

    BITS = 20
    MIX = np.uint64(0x9E3779B97F4A7C15)
    LAST = np.iinfo(np.int64).max

    def __init__(self, pieces: list[str], ids: dict[str, int], ranks: dict[str, float]):
        self.v = len(pieces)
        best = {r: i for i, r in enumerate(sorted(set(ranks.values())))}
        found = [(ids[p[:i]] * self.v + ids[p[i:]], k, best[ranks[p]]) for p, k in ids.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        #: Characters are numbered as pieces; others below zero.  Without all characters of pieces this form isn't exact.
        self.exact = all(c in ids for p in ids for c in p) and 2 * len(found) < 1 << self.BITS
        self.of_char = -1 - np.arange(0x110000)
        for p, k in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.sizes = np.array([len(p.encode()) for p in pieces], np.int32)
        keys, self.merged, self.rank = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        self.keys, slots, step, todo = keys, np.full(1 << self.BITS, -1), 0, np.arange(len(keys))
        home = self.home(keys)
        while len(todo) and self.exact:  # each round the first to come to a free slot stays
            at = (home[todo] + step) & (len(slots) - 1)
            free = slots[at] < 0
            slots[at[free][::-1]] = todo[free][::-1]
            todo, step = todo[slots[at] != todo], step + 1
        self.slots, self.steps = slots, step

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        out = np.full(len(left), -1)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo] * self.v + right[todo]
        home = self.home(key)
        for step in range(self.steps):
            slot = self.slots[(home + step) & (len(self.slots) - 1)]
            hit = (slot >= 0) & (self.keys[slot] == key)
            out[todo[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            todo, key, home = todo[more], key[more], home[more]
            if not len(todo):
                break
        return out

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, ends): what is left of each chunk when its best pair, the leftmost of equals, has been merged again and again."""
        text = "".join(chunks)
        n = len(text)
        size = np.array([len(c) for c in chunks], np.int64)
        start = np.cumsum(size) - size
        sym = np.append(self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], -1)
        following, before = np.arange(1, n + 2), np.arange(-1, n)
        following[start + size - 1], before[start], following[n] = n, n, n
        order, number = np.full(n + 1, self.LAST), np.full(n + 1, -1)

        def judge(at: np.ndarray) -> None:
            pair = self.find(sym[at], sym[following[at]])
            number[at] = pair
            order[at] = np.where(pair >= 0, (self.rank[pair] << 32) | at, self.LAST)
            order[n] = self.LAST

        judge(np.arange(n))
        alive = np.ones(n, bool)
        while True:
            best = np.minimum.reduceat(order[:n], start)
            at = best[best < self.LAST] & 0xFFFFFFFF
            if not len(at):
                break
            gone = following[at]
            sym[at] = self.merged[number[at]]
            alive[gone], order[gone] = False, self.LAST
            following[at] = following[gone]
            before[following[at]] = at
            judge(np.concatenate([at, before[at]]))
        left = np.flatnonzero(alive)
        return sym[left], np.searchsorted(left, np.append(start, n))


class Pieces:
    """A model ready to encode and decode, with the chunks that it has met."""

    def __init__(self, path: str):
        m = self.model = Model.load(path)
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        if any(k in (USER_DEFINED, UNUSED) for k in m.kinds):
            raise ValueError(f"{path}: user-defined and unused pieces aren't supported")
        self.ranks = {p: -m.scores[i] for p, i in self.ids.items()}
        self.unknown = m.kinds.index(UNKNOWN)
        byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)] if m.byte_fallback and len(byte_ids) == 256 else None
        self.byte_of = {i: b for b, i in byte_ids.items()}
        shared = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in shared)
        whole = any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids) or not m.escape
        #: What no piece crosses.
        self.parts = None if whole else re.compile(rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}
        self.pairs = Pairs(m.pieces, self.ids, self.ranks)
        surface = []
        for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
            surface.append(b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else bytes([self.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode())
        self.surface = surface
        self.flat, self.widths = np.frombuffer(b"".join(surface), np.uint8), np.array([len(x) for x in surface], np.int64)
        self.begins = np.cumsum(self.widths) - self.widths
        self.plain = np.array([k == NORMAL for k in m.kinds])

    def merge(self, chunk: str) -> bytes:
        """For each piece of a chunk its id and how many normalised bytes it has, as 32-bit numbers."""
        return self.numbered(self.merged(chunk) if len(chunk) <= KEPT else self.merged_long(chunk))

    def numbered(self, parts: list[str]) -> bytes:
        out, ids = array("i"), self.ids
        for p in parts:
            i = ids.get(p)
            if i is not None:
                out.extend((i, len(p.encode())))
            elif self.byte_ids is not None:
                data = p.encode()
                for b in data[:-1]:
                    out.extend((self.byte_ids[b], 0))
                out.extend((self.byte_ids[data[-1]], len(data)))  # the last byte of a character stands for it
            else:
                out.extend((self.unknown, len(p.encode())))
        return out.tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Keep the pieces of short chunks."""
        if not self.pairs.exact:
            self.known.update((c, self.merge(c)) for c in chunks)
        elif chunks:
            sym, ends = self.pairs.merge(chunks)
            flat, sizes = np.stack([sym, self.pairs.sizes[np.maximum(sym, 0)]], axis=1).astype("<i4").tobytes(), (8 * ends).tolist()
            strange = np.append(0, np.cumsum(sym < 0))
            strange = (strange[ends[1:]] > strange[ends[:-1]]).tolist()
            pieces, sym = self.model.pieces, sym.tolist()
            for k, (c, low, high) in enumerate(zip(chunks, sizes, sizes[1:])):
                self.known[c] = self.numbered([pieces[i] if i >= 0 else chr(-1 - i) for i in sym[low // 8 : high // 8]]) if strange[k] else flat[low:high]

    def merged(self, chunk: str) -> list[str]:
        """A short chunk's pieces: the best pair of neighbours is merged, the leftmost of equals, until none is a piece."""
        rank, parts = self.ranks.get, list(chunk)
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
        return parts

    def merged_long(self, chunk: str) -> list[str]:
        """The same with a heap of pairs, so that time grows little faster than the chunk."""
        rank, parts = self.ranks.get, list(chunk)
        n = len(parts)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(left: int, right: int) -> tuple:
            return rank(parts[left] + parts[right], NEVER), left, right, len(parts[left]) + len(parts[right])

        heap = [x for x in map(offer, range(n - 1), range(1, n)) if x[0] != NEVER]
        heapify(heap)
        while heap:
            _, left, right, size = heappop(heap)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after = following[left] = following[right]
            if after < n:
                before[after] = left
            for pair in ((left, after), (before[left], left)):
                if pair[0] >= 0 and pair[1] < n and (x := offer(*pair))[0] != NEVER:
                    heappush(heap, x)
        return [p for p in parts if p]

    def chunks(self, text: str) -> list[str]:
        if self.parts is None:
            return [text]
        if "\n" in text or "\t" in text or "\r" in text or SPACE * 2 in text or not text.startswith(SPACE):
            return self.parts.findall(text)
        return [SPACE + x for x in text[1:].split(SPACE)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the original bytes at which pieces begin, with the last one's end."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        m, known = self.model, self.known
        rows = []
        for text in texts:
            if text and m.characters is None and not m.trim and m.escape and SPACE not in text:
                norm, source = (SPACE if m.dummy_prefix else "") + text.replace(" ", SPACE), None
            else:
                norm, source = normalised(m, text or "")
            rows.append((norm, self.chunks(norm) if norm else [], source))
        new = {c for _, chunks, _ in rows for c in chunks if c not in known}
        if len(known) + len(new) > CACHE:
            known.clear()
            new = {c for _, chunks, _ in rows for c in chunks}
        self.learn([c for c in new if len(c) <= KEPT])
        long = {c: self.merge(c) for c in new if len(c) > KEPT}
        of = known.__getitem__
        return [self.placed(norm, b"".join(map(of, chunks)) if not long else b"".join([long.get(c) or of(c) for c in chunks]), source) for norm, chunks, source in rows]

    def placed(self, norm: str, found: bytes, source: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised text, and where their pieces begin and end in the original."""
        pairs = np.frombuffer(found, "<i4").reshape(-1, 2)
        ids, ends = pairs[:, 0], np.zeros(len(pairs) + 1, np.int64)
        np.cumsum(pairs[:, 1], out=ends[1:])
        if not self.one_unknown() and (ids == self.unknown).any():
            ids, ends = self.joined(ids, ends)
        if source is not None:
            return ids, source[ends] if norm else np.zeros(1, np.int64)
        # Every space was three bytes and is one, and the first stands for none.
        raw = np.frombuffer(norm.encode(), np.uint8)
        spaces = np.flatnonzero(raw[:-2] == 0xE2)
        spaces = spaces[(raw[spaces + 1] == 0x96) & (raw[spaces + 2] == 0x81)]
        ends = ends - 2 * np.searchsorted(spaces, ends, "left")
        return ids, np.maximum(ends - (1 if self.model.dummy_prefix else 0), 0)

    def one_unknown(self) -> bool:
        return self.byte_ids is not None

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown neighbours as one."""
        again = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown))
        return ids[~again], np.append(ends[:-1][~again], ends[-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD, one each."""
        surface, m = self.surface, self.model
        out = [surface[i] for i in ids.tolist()]
        broken = b"" in out  # a control id parts the bytes before it from those after it
        if m.dummy_prefix or m.trim:
            for at, i in enumerate(ids.tolist()):
                if i in self.byte_of:
                    break
                if out[at]:
                    if m.kinds[i] == NORMAL:
                        rest = out[at].lstrip(b" ") if m.trim else out[at].removeprefix(b" ")
                        seen = rest != out[at]
                        out[at] = rest
                        if rest or seen:
                            break
                    else:
                        break
        try:
            return self.mended(ids, out) if broken else b"".join(out).decode()
        except UnicodeDecodeError:
            return self.mended(ids, out)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of many lists of ids, which follow each other and end where ends say.

        Bytes of all pieces are gathered at once; a list that begins with anything but a plain piece, or whose bytes are
        no text, is decoded by itself.
        """
        widths = self.widths[ids]
        bounds = np.append(0, np.cumsum(widths))
        data = self.flat[np.repeat(self.begins[ids] - bounds[:-1], widths) + np.arange(bounds[-1])].tobytes()
        lead = 1 if self.model.dummy_prefix and not self.model.trim else 0
        odd = np.append(0, np.cumsum(widths == 0))
        out, low = [], 0
        for high in ends.tolist():
            if low == high:
                out.append("")
            elif odd[low] == odd[high] and lead and self.plain[ids[low]]:
                begin = bounds[low] + (data[bounds[low]] == 32)
                try:
                    out.append(data[begin : bounds[high]].decode())
                except UnicodeDecodeError:
                    out.append(self.decode(ids[low:high]))
            else:
                out.append(self.decode(ids[low:high]))
            low = high
        return out

    def mended(self, ids: np.ndarray, out: list[bytes]) -> str:
        text, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        text.append(run[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    n = 1
                at += n
            run.clear()

        for i, data in zip(ids.tolist(), out):
            if i in self.byte_of:
                run.extend(data)
            else:
                flush()
                text.append(data.decode())
        flush()
        return "".join(text)


@cache
def pieces_of(path: str) -> Pieces:
    """One for all tasks of a Python worker."""
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids, places[, decoded]): piece k stands for the original text's bytes from places[k] to places[k + 1].

    decoded: the text that the ids alone decode to, in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = p.encode_all(part.column(1).to_pylist())
                ids, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                ends = np.cumsum([len(f[0]) for f in found])
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, e), pa.int32()), pa.array(x, pa.int32())) for e, x in ((ends, ids), (ends + np.arange(1, len(ends) + 1), places))]
                texts = [pa.array(p.decode_all(ids, ends), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, *texts], names)

    names = ["id", "ids", "places", *["decoded"] * decoded]
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, ids array<int>, places array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of each row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = [np.asarray(x or [], np.int32) for x in part.column(1).to_pylist()]
                texts = p.decode_all(np.concatenate(lists), np.cumsum([len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "id long, decoded string")
