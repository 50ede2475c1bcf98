"""Writing segments: sequence numbers, hash chain, seals, rotation into chained successors.

A hash chain is sequential by nature: each instance is one stream.  Instances are dealt to
tasks, rows are sorted within them, and one pass writes the lines while it holds only the
chain's state, so an instance may be of any length.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime
from itertools import repeat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlog.vocabulary import LOG, MAGIC, PROV

OUT = "instance string, segment string, line_no long, line string"
#: Segments of an instance that may be named for one second.
SUFFIXES = 100


def tagged(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def millis(time: str) -> int:
    """Milliseconds of a time of 24 characters."""
    return round(datetime.fromisoformat(time).timestamp() * 1000)


def header(segment: str, instance: str, level: str, started: str, prev: str) -> str:
    return (
        f"{MAGIC}\n@prefix log:  <{LOG}> .\n@prefix prov: <{PROV}> .\n@name     {segment}\n@instance {instance}\n"
        f"@level    log:{level}\n@started  {started}\n@prev     {prev}\n\n"
    )


class NoName(ValueError):
    """Each name of a second is taken."""


@dataclass
class Cadence:
    """Seals after ``entries`` or ``millis``; rotation after ``max_entries`` or ``max_millis``.  None: never."""

    entries: int | None = 1000
    millis: int | None = 60_000
    max_entries: int | None = 100_000
    max_millis: int | None = 24 * 3600 * 1000

    def seal_due(self, unsealed: int, elapsed: int) -> bool:
        return (self.entries is not None and unsealed >= self.entries) or (self.millis is not None and elapsed >= self.millis)

    def rotation_due(self, entries: int, age: int) -> bool:
        return (self.max_entries is not None and entries >= self.max_entries) or (self.max_millis is not None and age >= self.max_millis)


@dataclass(frozen=True)
class Predecessor:
    """The newest segment of an instance's chain, from which a restarted writer goes on."""

    name: str
    level: str
    head: str
    started: str


class Segments:
    """The state of one instance's writer; add() and close() return what is written: (segment, line_no, line).

    Each segment begins with a process start, where pid and configured are noted.  After a predecessor the chain goes on from its
    head, no segment is stamped before it, and a level that isn't its own is recorded and sealed at once.
    """

    def __init__(
        self, instance: str, level: str, cadence: Cadence, signer: Callable[[str], str | None] | None = None,
        pid: int | None = None, configured: str | None = None, predecessor: Predecessor | None = None,
    ):
        self.instance, self.level, self.cadence, self.signer = instance, level, cadence, signer
        self.pid, self.configured, self.predecessor = pid, configured, predecessor
        self.name, self.head, self.started = "", "genesis", ""
        self.names: dict[str, int] = {}
        self.line_no = self.seq = self.sealed = self.opened = self.since = 0
        self.failed = False  # whether a rotation failed, and none came out since
        self.out: list[tuple[str, int, str]] = []  # each line that isn't handed over yet
        if predecessor is not None:
            self.head, self.started, self.opened = predecessor.head, predecessor.started, millis(predecessor.started)
            stem = self.stem(predecessor.started)
            taken = predecessor.name[len(stem) :]
            if predecessor.name.startswith(stem) and (not taken or taken[1:].isdigit()):
                self.names = {stem: int(taken[1:] or 0) + 1}

    def state(self) -> dict:
        """What a writer must remember between entries."""
        return {k: getattr(self, k) for k in ("name", "head", "started", "names", "line_no", "seq", "sealed", "opened", "since", "failed")} | {"predecessor": self.predecessor and asdict(self.predecessor)}

    def restore(self, state: dict) -> Segments:
        for k, v in state.items():
            setattr(self, k, Predecessor(**v) if k == "predecessor" and v else v)
        return self

    def put(self, line: str) -> None:
        self.line_no += 1
        self.out.append((self.name, self.line_no, line))

    def stem(self, time: str) -> str:
        return f"{self.instance.replace('urn:inst:', 'urn:log:', 1)}:{max(time, self.started)[:19].replace(':', '-')}Z"

    def following(self, time: str) -> str:
        """The next segment's name: by its time, with a number where the second is taken."""
        stem = self.stem(time)
        n = self.names.get(stem, 0)
        if n > SUFFIXES:
            raise NoName(f"{stem}: more than {SUFFIXES} segments in a second")
        return stem if n == 0 else f"{stem}-{n}"

    def open(self, time: str, ms: int) -> None:
        """A segment, whose first entry is a process start; it is never stamped before the one that it follows."""
        time, ms = max(time, self.started), max(ms, self.opened)
        name, stem = self.following(time), self.stem(time)
        self.names = {stem: self.names.get(stem, 0) + 1}  # times never go back: older seconds aren't asked for again
        self.name, self.line_no, self.seq, self.sealed = name, 0, 0, 0
        self.started, before, self.predecessor = time, self.predecessor, None
        text = header(name, self.instance, self.level, time, self.head)
        self.head, self.opened, self.since = tagged(text), ms, ms
        for line in text.split("\n")[:-1]:
            self.put(line)
        stated = f" pid={self.pid}" if self.pid is not None else ""
        self.entry(time, ms, "log:ProcessStart", self.instance, stated + (f" configured={self.configured}" if self.configured else ""))
        if before is not None and before.level != LOG + self.level:
            self.entry(time, ms, "log:LevelChange", name, f" key=level from={before.level} to={LOG + self.level} effective=this-segment")
            self.seal(ms)

    def entry(self, time: str, ms: int, curie: str, subject: str, tail: str) -> None:
        self.seq += 1
        line = f"{time} {curie} {subject} seq={self.seq}{tail}"
        self.head = tagged(self.head + "\n" + line)
        self.put(line)
        if self.cadence.seal_due(self.seq - self.sealed, max(0, ms - self.since)):
            self.seal(ms)

    def seal(self, ms: int) -> None:
        """Seal what isn't sealed yet."""
        if self.seq <= self.sealed:
            return
        sign = self.signer(self.head) if self.signer else None
        self.put(f"#seal {self.sealed + 1}-{self.seq} {self.head}" + (f" {sign}" if sign else ""))
        self.sealed, self.since = self.seq, ms

    def rotate(self, time: str, ms: int) -> None:
        """End the segment, naming its successor, and open that one.

        Where the second has no name left, the segment stays open: a rotation that fails loses no entry.  It is tried again at
        each entry, and noted once until one comes out.
        """
        noted, time, ms = time, max(time, self.started), max(ms, self.opened)
        try:
            following = self.following(time)
        except NoName as e:
            if not self.failed:
                self.failed = True
                self.entry(noted, ms, "log:Error", self.name, f' reason=rotation-failed msg="{e}"')
            return
        self.failed = False
        self.entry(time, ms, "log:Rotation", self.name, f" next={following}")
        self.seal(ms)
        self.open(time, ms)

    def add(self, time: str, ms: int, curie: str | None, subject: str | None, tail: str | None) -> list[tuple[str, int, str]]:
        """Write an entry, and rotate right after it where that makes it due.

        Without a curie it is one that the level leaves out: nothing is written, but its time can make a rotation due.  Without a
        subject it is about the segment in which it lands.
        """
        if not self.name:
            self.open(time, ms)
        if curie is not None:
            self.entry(time, ms, curie, self.name if subject is None else subject, tail)
        if self.cadence.rotation_due(self.seq, max(0, ms - self.opened)):
            self.rotate(time, ms)
        return self.flush()

    def close(self, time: str, ms: int) -> list[tuple[str, int, str]]:
        if self.name:
            self.entry(time, ms, "log:ProcessStop", self.instance, "")
            self.seal(ms)
        return self.flush()

    def flush(self) -> list[tuple[str, int, str]]:
        out, self.out = self.out, []
        return out


def write_lines(
    entries: DataFrame, cadence: Cadence, order: list[str], level: str = "trace", signer: Callable[[str], str | None] | None = None, predecessors: DataFrame | None = None
) -> DataFrame:
    """instance, segment, line_no, line of the segments that entries become.

    entries: instance, time, ms, curie, subject, tail (rendered fields without the sequence), and the columns of order.  A null
    curie stands for an entry that the level leaves out, whose time may still make a rotation due; a null subject for the segment
    in which the entry lands.
    predecessors: instance, name, level, head, started of the chains that go on (see :func:`tails`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Segments | None = None
        last = ("", 0)

        def emit(instance: str, rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
            segment, no, line = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([instance] * len(rows)), pa.array(segment), pa.array(no, pa.int64()), pa.array(line)], ["instance", "segment", "line_no", "line"])

        for batch in batches:
            rows: list[tuple[str, int, str]] = []
            chains = repeat(None) if batch.column(6).null_count == batch.num_rows else batch.column(6).to_pylist()
            for instance, time, ms, curie, subject, tail, before in zip(*(batch.column(i).to_pylist() for i in range(6)), chains):
                if now is None or instance != now.instance:
                    if now is not None:
                        yield emit(now.instance, rows + now.close(*last))
                        rows = []
                    now = Segments(instance, level, cadence, signer, predecessor=Predecessor(**before) if before else None)
                rows += now.add(time, ms, curie, subject, tail)
                last = (time, ms)
            if rows:
                yield emit(now.instance, rows)
        if now is not None:
            yield emit(now.instance, now.close(*last))

    of = "struct<name: string, level: string, head: string, started: string>"
    if predecessors is None:
        entries = entries.withColumn("before", F.lit(None).cast(of))
    else:
        entries = entries.join(predecessors.select("instance", F.struct("name", "level", "head", "started").cast(of).alias("before")), "instance", "left")
    slim = entries.select("instance", "time", "ms", "curie", "subject", "tail", "before", *[c for c in order if c not in ("instance", "time", "ms")])
    return slim.repartition("instance").sortWithinPartitions("instance", *order).mapInArrow(run, OUT)


def tails(headers: DataFrame, report: DataFrame) -> DataFrame:
    """instance, name, level, head, started of the newest segment of each chain.

    That is the one whose head no other segment of the instance names as what it follows; where there
    isn't exactly one, the last by name.
    """
    r = report.select("instance", "segment", "level", "head", "prev").join(headers.select("segment", "started"), "segment")
    named = r.select("instance", F.col("prev").alias("head")).distinct().withColumn("named", F.lit(True))
    each = r.join(named, ["instance", "head"], "left")
    free, row = F.col("named").isNull(), F.struct("segment", "level", "head", "started")
    best = each.groupBy("instance").agg(F.count_if(free).alias("n"), F.max(F.when(free, row)).alias("tail"), F.max(row).alias("last"))
    best = best.withColumn("t", F.when(F.col("n") == 1, F.col("tail")).otherwise(F.col("last")))
    return best.select("instance", F.col("t.segment").alias("name"), "t.level", "t.head", "t.started")


def write_files(lines: DataFrame, path: str) -> None:
    """A text file for each segment, in one of 256 folders below path; :func:`provlog.sources.segments.read` finds them.

    Files carry a part of the name's hash, because different names can have one slug; its first two digits name the folder.  Each task
    writes its files itself through Arrow's file systems, under a hidden name until they are whole, so that nothing is left to
    rename at the end and a repeated task replaces what it wrote.  What is there already is never overwritten.
    """
    from provlog.sources.ranges import opened

    system, root = opened(path)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} already exists")
    digest = F.left(F.sha2("segment", 256), F.lit(8))
    name = F.concat(F.left(digest, F.lit(2)), F.lit("/part-"), F.regexp_replace("segment", "[^A-Za-z0-9._-]", "-"), F.lit("-"), digest, F.lit(".txt"))
    rows = lines.select(name.alias("file"), "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        own, made = uuid.uuid4().hex, set()
        now = out = hidden = None

        def done() -> None:
            out.close()
            system.move(hidden, f"{root}/{now}")

        for batch in batches:
            held: list[str] = []
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != now:
                    if out is not None:
                        out.write("".join(held).encode())
                        done()
                    folder, base = file.split("/")
                    if folder not in made:
                        system.create_dir(f"{root}/{folder}", recursive=True)
                        made.add(folder)
                    now, hidden, held = file, f"{root}/{folder}/.{base}-{own}", []
                    out = system.open_output_stream(hidden)
                held.append((line or "") + "\n")
            if held:
                out.write("".join(held).encode())
        if out is not None:
            done()
        yield from ()

    system.create_dir(root, recursive=True)
    rows.select("file", "line").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass


def deliver(lines: DataFrame, destination: str, path: str | None = None, sink: Callable[[Iterator], None] | None = None) -> None:
    """Write lines (segment, line_no, line) where a configuration says.

    file: to files below path.  console: to the driver's standard error, a segment after the other, never to standard
    output.  sink: to a function that gets the rows of a partition, whose segments are whole and in order.  off: nowhere.
    """
    if destination == "file":
        write_files(lines, path)
    elif destination == "console":
        for row in lines.orderBy("segment", "line_no").toLocalIterator():
            print(row["line"], file=sys.stderr)
    elif destination == "sink":
        lines.repartition("segment").sortWithinPartitions("segment", "line_no").foreachPartition(sink)
    elif destination != "off":
        raise ValueError(f"destination: file, console, sink or off, not {destination!r}")
