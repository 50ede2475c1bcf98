"""Streams: transreption of segments line by line, and the writer as a stateful operator.

Parsing is stateless and stays in the JVM.  State is kept for each segment (ordinals, process runs, spans,
agents) or instance (the writer's chain, entries that wait for their turn) in buckets of the state store, and never grows beyond a bound: a segment that needs more fails the query, so that no answer is partial.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from provlog.functions import text as X
from provlog.operators import triples
from provlog.operators.writer import OUT, Cadence, Segments
from provlog.sources import segments
from provlog.sources.tables import shared_dir, written
from provlog.vocabulary import LOG, Vocabulary

STATE = "seq long, head string, sealed long, since long"
SEALS = "segment string, first long, last long, hash string"
#: Bytes of a segment's state at most.
BUDGET = 64 << 20
#: Buckets to which segments, or instances, are dealt; characters of a bucket's state that are read and written at once; spans and children of a part.
BUCKETS, NEAR, PART = 512, 8 << 20, 5000
#: Rows of a frame that a bucket tells, about.
ROWS = 5_000


def finished_files(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of whole segments; rotation never changes a file that it has left."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.log").load(directory)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.lit(None).cast("string").alias("error"), F.col("value").alias("text"))


def triples_of(files: DataFrame, v: Vocabulary) -> DataFrame:
    """Declared fields of the entries of each segment as triples, without state: the rows that the batch operator gives."""
    lines = segments.lines(files).where("kind = 'entry'")
    e = lines.withColumn("e", X.parse_entry(F.col("raw"), F.col("prefixes"))).select("segment", F.lit(None).cast("string").alias("instance"), "line_no", "e.*")
    return triples.declared(e, v)


class Kept:
    """State of the many keys of a bucket, as a text (JSON) for each.

    A call to the state, and a group of rows, cost far more than a row does, so keys are dealt to buckets.  near: the keys that were
    used last, read and written all at once.  far: those for which there is no room, each by itself.  A key is in one of them.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, room: int):
        self.room = room
        self.near = handle.getListState(f"{name}_near", "key string, state string")
        self.far = handle.getMapState(f"{name}_far", "key string", "state string")

    def open(self) -> None:
        self.texts = {key: text for key, text in self.near.get()}
        self.more = self.far.exists()

    def take(self, key: str) -> list | None:
        text = self.texts.pop(key, None)
        if text is None and self.more:
            row = self.far.getValue((key,))
            if row is not None:
                text = row[0]
                self.far.removeKey((key,))
        return None if text is None else json.loads(text)

    def put(self, key: str, state: list) -> None:
        self.texts[key] = json.dumps(state, ensure_ascii=False)

    def close(self) -> None:
        size = sum(map(len, self.texts)) + sum(map(len, self.texts.values()))
        for key in list(self.texts):  # what was used last stands last
            if size <= self.room:
                break
            text = self.texts.pop(key)
            size -= len(key) + len(text)
            self.far.updateValue((key,), (text,))
        if self.texts:
            self.near.put(list(self.texts.items()))
        else:
            self.near.clear()


class Follower(StatefulProcessor):
    """The lines of the segments of a bucket in their order, whatever order they come in, with what only state tells.

    A segment's state: ordinal, run and so on after the last line that was taken, early lines that came before their turn, and the
    spans, children and agents that wait for its end; where these are many they are parts of their own, which are written once
    and read at the end.  What comes and goes within a batch is held in memory and never stored.
    """

    def __init__(self, starts: set[str], ends: set[str], budget: int, room: int, part: int):
        self.starts, self.ends, self.budget, self.room, self.part = starts, ends, budget, room, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = Kept(handle, "segments", self.room)
        self.parts = handle.getMapState("parts", "segment string, n long", "spans string, children string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        self.kept.open()
        now: dict[str, Followed] = {}
        out: list[tuple] = []
        for frame in rows:
            frame = frame.sort_values(["segment", "at"], kind="stable")
            for segment, lines in groupby(zip(frame["segment"].tolist(), zip(*(frame[c].tolist() for c in ROW))), key=itemgetter(0)):
                if segment not in now:
                    now[segment] = Followed(segment, self.kept.take(segment))
                now[segment].follow(map(itemgetter(1), lines), self.starts, self.ends, out)
            if len(out) > ROWS:
                yield pd.DataFrame(out, columns=TOLD)
                out = []
        for segment, s in now.items():
            if s.ended:
                self.end(s, out)
            s.close()
            if s.held > self.budget:
                raise ValueError(f"over budget: the state of {segment} needs more than {self.budget} bytes")
            if len(s.spans) + len(s.children) > self.part:
                self.parts.updateValue((segment, s.parts), (json.dumps(s.spans, ensure_ascii=False), json.dumps(s.children, ensure_ascii=False)))
                s.spans, s.children, s.parts = [], [], s.parts + 1
            if s.following is not None:
                self.kept.put(segment, s.state())
        self.kept.close()
        if out:
            yield pd.DataFrame(out, columns=TOLD)

    def end(self, s: Followed, out: list[tuple]) -> None:
        """Edges and agents of a segment that has ended, which then waits for nothing."""
        before = [[json.loads(text) for text in self.parts.getValue((s.segment, n))] for n in range(s.parts)]
        known, children = {}, []
        for spans, some in [*before, (s.spans, s.children)]:
            known |= {(run, span): iri for run, span, iri in spans}  # of equal spans the last one counts
            children += some
        known |= s.fresh
        edges = [(known.get((run, parent)), child) for run, parent, child in [*children, *s.born]]
        out += [("edge", s.segment, s.instance, *[None] * 7, p, c) for p, c in edges if p is not None and p != c]
        out += [("agent", s.segment, i, *[None] * 7, a, None) for a, i in sorted((s.agents | s.named).items())]
        for n in range(s.parts):
            self.parts.removeKey((s.segment, n))

    def close(self) -> None:
        pass


class Followed:
    """A segment within a batch: what is stored of it, and what the batch adds (fresh spans, children born, agents named)."""

    def __init__(self, segment: str, stored: list | None):
        self.segment = segment
        self.following, self.ordinal, self.run, self.started, self.held, self.parts, early, self.spans, self.children, self.agents = stored or (None, 0, 0, False, 0, 0, [], [], [], {})
        self.early = {row[0]: tuple(row) for row in early}
        self.fresh: dict[tuple[int, str], str] = {}
        self.born: list[tuple[int, str, str]] = []
        self.named: dict[str, str] = {}
        self.ended, self.instance = False, None

    def follow(self, lines: Iterator[tuple], starts: set[str], ends: set[str], out: list[tuple]) -> None:
        segment, early, fresh, born = self.segment, self.early, self.fresh, self.born
        following, ordinal = self.following, self.ordinal
        for row in lines:
            following = row[2] if following is None else following
            if row[0] < following:
                continue  # a line that came again
            if row[0] > following:
                again = early.get(row[0])
                early[row[0]] = row = tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in row)
                self.held += sum(len(str(x)) for x in row) - (sum(len(str(x)) for x in again) if again is not None else 0)
                continue
            while row is not None:
                at, following, _, kind, instance, class_, seq, span, parent, named = row[:10]
                self.instance = instance
                if kind == "entry":
                    ordinal += 1
                    if class_ in starts:
                        self.run, self.started = self.run + self.started, True
                    iri = f"{segment}:{seq if seq is not None else ordinal}"
                    if span is not None:
                        fresh[self.run, span] = iri
                    if parent is not None:
                        born.append((self.run, parent, iri))
                    if named is not None:
                        for agent in named:
                            self.named[agent] = instance
                    self.ended = class_ in ends
                if kind in ("entry", "seal"):
                    out.append((kind, segment, instance, at, ordinal if kind == "entry" else None, *row[10:], None))
                row = early.pop(following, None) if early else None
                self.held -= sum(len(str(x)) for x in row) if row is not None else 0
        self.following, self.ordinal = following, ordinal

    def close(self) -> None:
        """The batch is over: what it adds is kept, or forgotten where the segment has ended."""
        if self.ended:
            self.spans, self.children, self.agents, self.parts = [], [], {}, 0
            self.held = self.held if self.early else 0
            return
        news = {a: of for a, of in self.named.items() if a not in self.agents}
        self.held += sum(len(s) + len(i) + 8 for (_, s), i in self.fresh.items()) + sum(len(p) + len(i) + 8 for _, p, i in self.born) + sum(map(len, news))
        self.spans += [(run, span, iri) for (run, span), iri in self.fresh.items()]
        self.children += self.born
        self.agents |= news

    def state(self) -> list:
        return [self.following, self.ordinal, self.run, bool(self.started), self.held, self.parts, list(self.early.values()), self.spans, self.children, self.agents]


#: Columns that the follower reads of a line, and that it tells of it.
PASSED = ["time", "subject", "keys", "values", "raw"]
ROW = ["at", "following", "first", "kind", "instance", "iri", "seq", "span", "parent", "agents", "iri", *PASSED]
TOLD = ["what", "segment", "instance", "line_no", "ordinal", "class", "time", "subject", "keys", "values", "a", "b"]
TOLD_KIND = "what string, segment string, instance string, line_no long, ordinal long, class string, time string, subject string, keys array<string>, values array<string>, a string, b string"


def followed(lines: DataFrame, v: Vocabulary, budget: int = BUDGET) -> DataFrame:
    """Lines of a stream (segment, instance, line_no, raw, kind, prefixes) with what only state tells.

    what: entry, with ordinal and its columns (keys and values of its fields); seal, with its line in a; and, when a segment has
    ended, edge (a: parent's, b: child's IRI) and agent (a: principal).  Lines may come in any order, within a batch and across: each waits
    until the one before it has come, so all lines of a segment must be there, blank ones and comments too, numbered
    one by one from first (1 where there is no such column).  Lines with bytes for places state where the next begins (following).
    A segment that never ends keeps its edges and agents in the state; budget: bytes that a segment may keep.
    """
    starts, ends = set(v.below(LOG + "ProcessStart")), set(v.below(LOG + "ProcessStop") + v.below(LOG + "Rotation"))
    e = F.when(F.col("kind") == "entry", X.parse_entry(F.col("raw"), F.col("prefixes")))
    f = F.col("e.fields")
    following = F.col("following") if "following" in lines.columns else F.col("line_no") + 1
    first = F.col("first") if "first" in lines.columns else F.lit(1)
    slim = lines.withColumn("e", e).select(
        F.pmod(F.xxhash64("segment"), F.lit(BUCKETS)).alias("bucket"), "segment", F.col("line_no").cast("long").alias("at"), following.cast("long").alias("following"), first.cast("long").alias("first"), "kind", "instance", F.col("e.class").alias("iri"), X.stated_sequence(f).cast("string").alias("seq"),
        X.first_value(f, "span").alias("span"), X.first_value(f, "parent").alias("parent"), F.filter(X.all_values(f, "principal"), X.is_rdf_iri).alias("agents"),
        "e.time", "e.subject", F.transform(f, lambda x: x["key"]).alias("keys"), F.transform(f, lambda x: x["value"]).alias("values"), F.when(F.col("kind") == "seal", F.col("raw")).alias("raw"),
    )
    return slim.groupBy("bucket").transformWithStateInPandas(Follower(starts, ends, budget, NEAR, PART), TOLD_KIND, "Append", "None")


def triples_stream(lines: DataFrame, v: Vocabulary, budget: int = BUDGET) -> DataFrame:
    """All that a stream of lines says, as the batch operator tells it: one query, which runs as long as lines come."""
    told = followed(lines, v, budget)
    fields = F.transform(F.arrays_zip("keys", "values"), lambda x: F.struct(x["keys"].alias("key"), x["values"].alias("value")))
    predicate = v.predicate_map()
    e = triples.node(X.once(told, "fields", F.when(F.col("what") == "entry", fields)))
    of_fields = F.flatten(F.transform("fields", lambda f: F.concat(F.array(triples.declared_triple(v, f)), triples.undeclared_triples(v, f))))
    said = F.concat(triples.core_array(F.try_element_at(predicate, F.col("class"))), F.filter(F.array_distinct(of_fields), lambda t: t.isNotNull()), triples.delegation_array())
    # In a step of its own: within a condition nothing is shared, and what is repeated would be worked out for each triple.
    e = X.once(e, "said", F.when(F.col("what") == "entry", said))
    seal = X.parse_seal(F.col("a"))
    e = e.withColumns({"value": F.col("a"), "s": F.when(F.col("what") == "seal", seal)})
    of = (
        F.when(F.col("what") == "entry", F.col("said")).when(F.col("what") == "seal", triples.seal_array(F.col("s"))).when(F.col("what") == "agent", triples.agent_array())
        .otherwise(F.array(triples.triple(F.col("a"), LOG + "invoked", F.col("b"))))
    )
    return triples.exploded(e.select("graph", of.alias("t")), F.col("t"))


def seal_stream(entries: DataFrame, every: int, millis: int) -> DataFrame:
    """Seals of a stream of entries (segment, h0, ms, event_id, line): state for each segment is the chain's head and counters."""

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"], kind="stable")
        seq, head, sealed, since = state.get if state.exists else (0, rows["h0"].iloc[0], 0, int(rows["ms"].iloc[0]))
        out = []
        for ms, line in zip(rows["ms"].tolist(), rows["line"]):
            seq += 1
            head = "sha256:" + hashlib.sha256(f"{head}\n{line}".encode()).hexdigest()
            if seq - sealed >= every or ms - since >= millis:
                out.append((key[0], sealed + 1, seq, head))
                sealed, since = seq, ms
        state.update((seq, head, sealed, since))
        yield pd.DataFrame(out, columns=["segment", "first", "last", "hash"])

    return entries.groupBy("segment").applyInPandasWithState(run, SEALS, STATE, "append", GroupStateTimeout.NoTimeout)


class StreamWriter(StatefulProcessor):
    """The writers of the instances of a bucket.  waiting: entries that the watermark hasn't passed, as texts, each with its first and last time; due: the bucket's timer."""

    def __init__(self, level: str, cadence: Cadence, order: list[str], late: bool, room: int):
        self.level, self.cadence, self.order, self.late, self.room = level, cadence, order, late, room
        self.columns = ["instance", *WRITTEN, *[c for c in order if c not in ("instance", *WRITTEN)]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = Kept(handle, "writers", self.room)
        self.waiting = handle.getListState("waiting", "first long, last long, entries string")
        self.due = handle.getValueState("due", "at long")

    def write(self, rows: list[list]) -> Iterator[pd.DataFrame]:
        self.kept.open()
        out: list[tuple] = []
        by = itemgetter(*(self.columns.index(c) for c in ("instance", *self.order)))
        for instance, own in groupby(sorted(rows, key=by), key=itemgetter(0)):
            w = Segments(instance, self.level, self.cadence)
            stored = self.kept.take(instance)
            if stored is not None:
                w.restore(dict(zip(WRITER, stored)))
            for _, time, ms, curie, subject, tail, *_ in own:
                out += [(instance, *line) for line in w.add(time, int(ms), curie, subject, tail)]
            self.kept.put(instance, [getattr(w, c) for c in WRITER])
            if len(out) > ROWS:
                yield pd.DataFrame(out, columns=WROTE)
                out = []
        self.kept.close()
        if out:
            yield pd.DataFrame(out, columns=WROTE)

    def wait(self, at: int) -> None:
        """Set the bucket's timer, unless an earlier one is set."""
        stored = self.due.get()
        if stored is not None and stored[0] <= at:
            return
        if stored is not None:
            self.handle.deleteTimer(stored[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        if not self.late:
            yield from self.write([r for frame in rows for r in tuples(frame, self.columns)])
            return
        first = None
        for frame in rows:
            least = int(frame["ms"].min())
            self.waiting.appendList([packed(tuples(frame, self.columns))])
            first = least if first is None else min(first, least)
        if first is not None:
            self.wait(max(first, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due: list[list] = []
        rest: list[list] = []
        later: list[tuple[int, int, str]] = []
        for first, last, text in self.waiting.get():
            if first > now:  # none of them is due: they stay as they are
                later.append((first, last, text))
                continue
            for r in json.loads(text):
                (due if r[MS] <= now else rest).append(r)
        if rest:
            later.append(packed(rest))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self.due.clear()  # the timer that has expired
        if later:
            self.wait(min(first for first, *_ in later))
        if due:
            yield from self.write(due)

    def close(self) -> None:
        pass


def packed(rows: list) -> tuple[int, int, str]:
    """Entries as (first time, last time, text)."""
    return min(r[MS] for r in rows), max(r[MS] for r in rows), json.dumps(rows, ensure_ascii=False)


def tuples(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows of a frame; what is missing is None."""
    each = [[None if pd.isna(x) else x for x in frame[c].tolist()] if frame[c].hasnans else frame[c].tolist() for c in columns]
    return list(zip(*each))


WRITTEN, WROTE, MS = ["time", "ms", "curie", "subject", "tail"], ["instance", "segment", "line_no", "line"], 2
#: What is kept of an instance's writer.
WRITER = ["name", "head", "started", "names", "line_no", "seq", "sealed", "opened", "since", "failed"]


def write_stream(entries: DataFrame, cadence: Cadence, order: list[str], level: str, v: Vocabulary, delay: str | None = None) -> DataFrame:
    """instance, segment, line_no, line of the segments that a stream of entries becomes.

    entries: instance, time, ms, class, curie, subject, tail, and the columns of order, which are whole numbers.  The level lets entries through
    before they get a sequence number; the state of an instance is its writer's: name, head, sequence, seals, times.
    Segments rotate; the last one stays open, as long as the stream does.

    delay: how late an entry may come ('10 minutes').  Entries then wait until the watermark has passed them and are written in
    order, by what batches they came in aside; those that come later still are dropped, and counted by the query's metrics.
    Without a delay entries are in order within a batch only.
    """
    rank = v.ranks[LOG + level]
    classes = F.broadcast(v.class_table(entries.sparkSession).select("class", "least_rank"))
    slim = entries.join(classes, "class", "left").where(F.coalesce(F.col("least_rank") <= rank, F.lit(True)))
    columns = ["instance", *WRITTEN, *[c for c in order if c not in ("instance", *WRITTEN)]]
    slim = slim.select(F.pmod(F.xxhash64("instance"), F.lit(BUCKETS)).alias("bucket"), *columns, F.timestamp_millis("ms").alias("came"))
    if delay is not None:
        slim = slim.withWatermark("came", delay)
    return slim.groupBy("bucket").transformWithStateInPandas(StreamWriter(level, cadence, order, delay is not None, NEAR), OUT, "Append", "None" if delay is None else "EventTime")


class Appended(StreamingQueryListener):
    """Calls a function after each batch that brought rows: (name of the query, rows, batch)."""

    def __init__(self, notify: Callable[[str | None, int, int], None]):
        self.notify = notify

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.notify(p.name, p.numInputRows, p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(stream: DataFrame, path: str, state: str | None = None) -> StreamingQuery:
    """Run a stream over what is there, one batch for each trigger's share, into Parquet files below path; typed state needs this store."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", state or f"{path}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def drained(stream: DataFrame, name: str, budget: int | None = None) -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder, and read it.

    budget: bytes that its state may have in all; a batch that leaves more fails the query.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = started(stream, path)
    while not query.awaitTermination(1):
        over(query, budget)
    over(query, budget)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def over(query: StreamingQuery, budget: int | None) -> None:
    """Stop a query whose state has outgrown its budget, as an error."""
    most = max((r[4] for r in accounts(query)), default=0)
    if budget is not None and most > budget:
        query.stop()
        raise ValueError(f"over budget: the state has {most} bytes, more than {budget}")


def accounts(query: StreamingQuery) -> list[tuple[int, int, str, int, int, int]]:
    """(batch, number of the operator, operator, rows of state, bytes of state, rows that came too late) of the batches that a query still tells of."""
    return [(p["batchId"], i, o["operatorName"], o["numRowsTotal"], o["memoryUsedBytes"], o["numRowsDroppedByWatermark"]) for p in query.recentProgress for i, o in enumerate(p["stateOperators"])]


def account(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """What :func:`accounts` tells, as a table."""
    return spark.createDataFrame(accounts(query), "batch long, nth int, operator string, rows long, bytes long, late long")


def fed(rows: DataFrame, name: str, batch: Column | None = None, batches: int = 1) -> DataFrame:
    """A stream over a table, which is written to the shared folder first.

    batch: a number from 0 for each row; rows come in as many batches, in that order.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/source-{name}-{uuid.uuid4().hex}"
    if batch is None:
        rows.write.parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)
    rows = written(rows.withColumn("_batch", batch), name)
    counts = {r["_batch"]: r["n"] for r in rows.groupBy("_batch").agg(F.count("*").alias("n")).collect()}  # as many rows as batches
    # Each batch but the last must have as many files as the others: so many that none of them is empty.
    least = min((counts.get(i, 0) for i in range(batches - 1)), default=0)
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), least // 10_000))
    for i in range(batches):  # a file's time tells its turn
        each = rows.where(F.col("_batch") == i).drop("_batch")
        each = each.coalesce(1) if files == 1 or counts.get(i, 0) < 10_000 else each.repartition(files)
        each.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("_batch").schema).option("maxFilesPerTrigger", files).parquet(path)
