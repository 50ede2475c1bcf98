"""Sources that read parts of segment files: the growing end of open ones, headers, last seals.

Files are reached by their URI through Arrow's file systems, on the driver for sizes and in tasks for bytes, so a folder may be
anything that those reach.  Each is registered with :func:`register` and read by its short name:

* ``provlog_tail`` streams lines as they are appended.  Its offset is the committed length of each file, that is to the end of its
  last whole line; a batch reads the bytes between two offsets and nothing else, in pieces that tasks share.
* ``provlog_probe`` reads the header or the last seals of each file as a range of bytes, and the whole file only where the range doesn't hold
  them.  Which of both is an option and not a condition that is pushed down: Spark keeps one reader for all scans of a table, so what one
  scan pushes would bind the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from provlog.functions import text as X

#: Bytes that opening a file counts for where files are dealt to tasks; files that are looked at side by side.
OPENING, SIDE = 16 << 10, 16
#: Bytes of a header's and of a last seal's range; of a piece that a task reads; of a look back for a line's end.
HEAD, TAIL, PIECE, STEP = 8 << 10, 256 << 10, 8 << 20, 64 << 10
BLANKS = b" \t\x0b\x0c\r"
#: Rows of a batch that a task tells.
ROWS = 10_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(uri: str, ends: tuple[str, ...]) -> dict[str, int]:
    """Sizes of the files below a folder whose names end so."""
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name.endswith(ends) and not f.base_name.startswith((".", "_"))}


def bytes_of(system: fs.FileSystem, path: str, low: int, high: int) -> bytes:
    with system.open_input_file(path) as file:
        return file.read_at(high - low, low)


def after_header(data: bytes) -> int | None:
    """Where the line after the first blank one begins, or None where no line is blank."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        if not data[at:end].strip(BLANKS):
            return end + 1
        at = end + 1
    return None


def header_facts(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    """Name, instance and prefixes that a header states; :func:`provlog.sources.segments.parse_header` judges headers."""
    facts, prefixes = {}, {}
    for line in text.split("\n"):
        words = line.split()
        if len(words) > 1 and words[0] == "@prefix" and len(words) > 2:
            prefixes[words[1].rstrip(":")] = words[2].strip("<>")
        elif len(words) > 1 and words[0].startswith("@"):
            facts[words[0]] = words[1]
    return facts.get("@name"), facts.get("@instance"), prefixes


def ending(options: dict) -> tuple[str, ...]:
    return tuple(options.get("ending", ".log").split(","))


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin from low on and before high; body: where its header ends; end: how far it is committed."""

    path: str
    low: int
    high: int
    body: int
    end: int


@dataclass
class Pieces(InputPartition):
    """Pieces that a task reads one after the other."""

    pieces: list[Piece]


class LogTail(DataSource):
    """Options: path; ending (of files' names, '.log'); bytes (of a batch at most, about; all that is there)."""

    @classmethod
    def name(cls) -> str:
        return "provlog_tail"

    def schema(self) -> str:
        return "file string, segment string, instance string, prefixes map<string,string>, first long, line_no long, following long, raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.ends = options["path"], ending(options)
        self.most = int(options.get("bytes", 1 << 62))
        self.last: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file (where its header ends, where its last whole line ends)."""
        system, room = opened(self.folder)[0], self.most
        grown = []
        for path, size in sorted(listed(self.folder, self.ends).items()):
            body, end = self.last.get(path, (0, 0))
            if size < end:
                raise ValueError(f"{path}: shorter than what was read of it")
            if size > end:
                grown.append((path, size, body, end))
        if sum(size - end for _, size, _, end in grown) <= room:  # all of them fit: none waits for how much another one takes
            with ThreadPoolExecutor(SIDE) as several:
                found = several.map(lambda g: self.committed(system, *g, room), grown)
                self.last |= {path: at for (path, *_), at in zip(grown, found) if at is not None}
        else:
            for path, size, body, end in grown:
                if room <= 0:
                    break
                at = self.committed(system, path, size, body, end, room)
                if at is not None:
                    room -= at[1] - end
                    self.last[path] = at
        return {k: list(v) for k, v in self.last.items()}

    @classmethod
    def committed(cls, system: fs.FileSystem, path: str, size: int, body: int, end: int, room: int) -> list[int] | None:
        """Where a file's header ends, and its last whole line within room bytes; None where there is nothing new."""
        if not body:
            data = bytes_of(system, path, 0, min(size, HEAD))
            body = after_header(data)
            if body is None and size > HEAD:
                body = after_header(bytes_of(system, path, 0, size))
            if body is None:
                return None  # its header isn't whole yet
            if size <= len(data) and size - max(end, body) <= room:
                return [body, max(body, data.rfind(b"\n") + 1)]
        high = min(size, max(end, body) + room)
        last = cls.line_end(system, path, max(end, body), high)
        if last is None and high < size:  # a line longer than the batch's bytes
            last = cls.line_end(system, path, max(end, body), size)
        return [body, last or body] if last is not None or not end else None

    @staticmethod
    def line_end(system: fs.FileSystem, path: str, low: int, high: int) -> int | None:
        """The end of the last whole line between two places."""
        at = high
        while at > low:
            begin = max(low, at - STEP)
            found = bytes_of(system, path, begin, at).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
        return None

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        """Large files in pieces, each a task's, and small ones many to a task, so that tasks grow with the bytes and not with the files."""
        self.last = {k: list(v) for k, v in end.items()} | {k: v for k, v in self.last.items() if k not in end}
        out, room = [], 0
        for path, (body, high) in end.items():
            low = max(start.get(path, (0, 0))[1], body)
            for at in range(low, high, PIECE):
                piece = Piece(path, at, min(at + PIECE, high), body, high)
                cost = piece.high - at + OPENING
                if cost > room:
                    out.append(Pieces([]))
                    room = PIECE + OPENING
                out[-1].pieces.append(piece)
                room -= cost
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system = opened(self.folder)[0]
        held: list[tuple] = []
        for piece in partition.pieces:
            for rows in self.lines(system, piece):
                held += rows
                if len(held) >= ROWS:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    @staticmethod
    def lines(system: fs.FileSystem, piece: Piece) -> Iterator[list[tuple]]:
        name, instance, prefixes = header_facts(bytes_of(system, piece.path, 0, piece.body).decode(errors="replace"))
        of = (piece.path, name, instance, list(prefixes.items()), piece.body)
        with system.open_input_file(piece.path) as file:
            at = piece.low
            if at > piece.body:  # a line that began before is the piece's before
                at, found = at - 1, b""
                while not found.endswith(b"\n") and at < piece.end:
                    chunk = file.read_at(min(STEP, piece.end - at), at)
                    cut = chunk.find(b"\n")
                    found = chunk[: cut + 1] if cut >= 0 else chunk
                    at += len(found)
            data, begin = b"", at
            while at < piece.high:
                end = min(piece.end, begin + len(data) + (1 << 20))
                data += file.read_at(end - begin - len(data), begin + len(data))
                rows, used = [], 0
                while begin + used < piece.high and (cut := data.find(b"\n", used)) >= 0:
                    rows.append((*of, begin + used, begin + cut + 1, decoded(data[used:cut].rstrip(b"\r"))))
                    used = cut + 1
                data, begin = data[used:], begin + used
                at = begin
                yield rows


TOLD = pa.schema([("file", pa.string()), ("segment", pa.string()), ("instance", pa.string()), ("prefixes", pa.map_(pa.string(), pa.string())), ("first", pa.int64()), ("line_no", pa.int64()), ("following", pa.int64()), ("raw", pa.string())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TOLD)], schema=TOLD)


def decoded(line: bytes) -> str | None:
    """A line as text; null where its bytes are none."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return None


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class LogProbe(DataSource):
    """Options: path; ending (of files' names, '.log'); parts ('header,tail')."""

    @classmethod
    def name(cls) -> str:
        return "provlog_probe"

    def schema(self) -> str:
        return "file string, bytes long, part string, text string, read long"

    def reader(self, schema) -> DataSourceReader:
        return ProbeReader(dict(self.options))


class ProbeReader(DataSourceReader):
    #: Files of a task at least, and tasks at most.
    EACH, TASKS = 64, 512

    def __init__(self, options: dict):
        self.folder, self.ends, self.parts = options["path"], ending(options), options.get("parts", "header,tail").split(",")

    def partitions(self) -> list[Files]:
        files = sorted(listed(self.folder, self.ends).items())
        each = max(self.EACH, -(-len(files) // self.TASKS))
        return [Files(files[i : i + each]) for i in range(0, len(files), each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system = opened(self.folder)[0]
        for path, size in partition.files:
            for part in self.parts:
                data, read = (head_of if part == "header" else tail_of)(system, path, size)
                yield path, size, part, decoded(data), read


def head_of(system: fs.FileSystem, path: str, size: int) -> tuple[bytes, int]:
    """A file's header, and how many bytes were read for it."""
    data = bytes_of(system, path, 0, min(size, HEAD))
    end = after_header(data)
    if end is not None or size <= HEAD:
        return data[:end], len(data)
    whole = bytes_of(system, path, 0, size)
    return whole[: after_header(whole)], len(data) + size


def tail_of(system: fs.FileSystem, path: str, size: int) -> tuple[bytes, int]:
    """A file's last whole lines, which hold its last seal if it has one, and how many bytes were read for them."""
    low = max(0, size - TAIL)
    data = bytes_of(system, path, low, size)
    if low == 0:
        return data, len(data)
    whole = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    if whole.startswith(b"#seal ") or b"\n#seal " in whole:
        return whole, len(data)
    return bytes_of(system, path, 0, size), len(data) + size


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(LogTail)
    spark.dataSource.register(LogProbe)


def tail(spark: SparkSession, directory: str, ending: str = ".log", batch: int | None = None) -> DataFrame:
    """A stream of the lines of a folder's segments as they are appended, as :func:`provlog.streaming.live.followed` takes them.

    Lines come once, also after a restart; what stands after the last line's end waits until that line is whole.
    batch: about how many bytes a batch may have.
    """
    register(spark)
    reader = spark.readStream.format("provlog_tail").option("path", directory).option("ending", ending)
    rows = (reader.option("bytes", batch) if batch is not None else reader).load()
    return rows.withColumn("kind", X.line_kind(F.col("raw")))


def probe(spark: SparkSession, directory: str, ending: str = ".log", parts: str = "header,tail") -> DataFrame:
    """(file, bytes, part, text, read): header and tail of each file of a folder, or one of them."""
    register(spark)
    return spark.read.format("provlog_probe").option("path", directory).option("ending", ending).option("parts", parts).load()


def heads(spark: SparkSession, directory: str, ending: str = ".log") -> DataFrame:
    """file, segment, instance, prev, head of each readable segment: the hash of its last seal, or of its header where it has none.

    Only headers and tails are read.
    """
    from provlog.sources.segments import canonical_hash, parse_header

    p = probe(spark, directory, ending)
    p = X.once(p, "h", F.when(F.col("part") == "header", parse_header(F.col("text"))))
    lines = F.filter(F.split("text", "\n"), lambda s: s.startswith("#seal"))
    seals = F.filter(F.transform(lines, lambda s: X.bound(X.parse_seal(s), lambda x: F.struct(X.is_seal(s, x).alias("ok"), x["hash"].alias("hash")))), lambda s: s["ok"])
    header = F.struct(F.col("h.name").alias("segment"), "h.instance", "h.prev", canonical_hash(F.col("h")).alias("h0"))
    each = p.select("file", F.when((F.col("part") == "header") & F.col("h.error").isNull(), header).alias("h"), F.when(F.col("part") == "tail", F.try_element_at(seals, F.lit(-1))["hash"]).alias("sealed"))
    known = each.groupBy("file").agg(F.max("h").alias("h"), F.max("sealed").alias("sealed")).where("h is not null")  # one row of each part
    return known.select("file", "h.segment", "h.instance", "h.prev", F.coalesce("sealed", "h.h0").alias("head"))
