"""SimHash near-deduplication with a Gray-order hierarchical index.

1. Fingerprints: each bit is set if it is set in over half the hashes of the text's shingles.
2. Distinct fingerprints are dealt by blocks: 64 bits in six blocks; two fingerprints that
   differ in at most two bits agree in four blocks at least, so each fingerprint goes to the
   15 choices of four blocks.  A group that agrees in a choice has at most 2**22 members,
   because fingerprints are distinct: its size is bounded whatever the data.
3. In a group, fingerprints are sorted by Gray rank (neighbours in it share long bit
   patterns).  Each run of ``FAN`` neighbours becomes a node that keeps the bits on which all
   its members agree (a mask and a pattern); nodes are grouped in the same way up to one
   root.  Pairs of nodes are compared from the root down: where the differences in bits that
   both nodes fix exceed the limit, the pair is pruned with all below it.
4. Links of a group are cut to a spanning forest, and components over all are found by
   star contraction (:mod:`provlog.llm.components`).

A null text counts as empty; a text without words has fingerprint zero and is linked like any
other.  Rows that repeat an identifier each have their own row.  Rows with null identifiers link others; they never name
a component unless all its identifiers are null.  Texts of any length are read whole; of ties
the smallest identifier counts; an empty table gives no rows; other columns aren't read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlog.llm.common import written
from provlog.llm.components import components

BITS = 64
BLOCKS = 6
SEED = 42
FAN = 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For similar texts: words of a shingle, and bits, by which the Gray-order index links their fingerprints.
INDEXED, LIMIT = 3, 2
#: For similar texts: bits of a fingerprint, candidate keys, smallest hashes in a key, rows of a key compared at once.
WIDE, BANDS, EACH, HELD = 1024, 12, 4, 20_000
#: Standard deviations by which fingerprints may exceed the mean distance; shingles below which they prune nothing.
SLACK, FEW = 5, 64
#: Rows and shingles of a cluster that are compared in one block.
BLOCK_ROWS, BLOCK_SHINGLES = 4_096, 4_000_000
#: Pairs of nodes compared in one step.
STEP = 1 << 18


def fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    body, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[len(words) - n :] - 1).tolist()
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(body[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp): fp is a long that holds the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def masks() -> list[int]:
    """One mask for each choice of blocks that two linked fingerprints may agree on."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(blocks[i] for i in choice) for choice in combinations(range(BLOCKS), BLOCKS - 2)]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over distinct fingerprints in Gray order; finds all pairs within a distance."""

    def __init__(self, fp: np.ndarray):
        self.order = np.argsort(gray_rank(fp), kind="stable")
        pattern = fp[self.order]
        self.levels = [(pattern, np.full(len(fp), ONES))]
        while len(pattern) > 1:
            at = np.arange(0, len(pattern), FAN)
            mask = self.levels[-1][1]
            every, some = np.bitwise_and.reduceat(pattern | ~mask, at), np.bitwise_or.reduceat(pattern & mask, at)
            fixed = np.bitwise_and.reduceat(mask, at) & (every | ~some)
            pattern = every & fixed
            self.levels.append((pattern, fixed))

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the given array) of pairs that differ in at most limit bits, in blocks."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > STEP:
                todo += [(level, a[i : i + STEP], b[i : i + STEP]) for i in range(0, len(a), STEP)]
                continue
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            pattern, mask = self.levels[level - 1]
            x = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(a))
            y = np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(np.arange(FAN), FAN), len(b))
            near = (x < len(pattern)) & (y < len(pattern)) & ((x < y) if level == 1 else (x <= y))
            x, y = x[near], y[near]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= limit
            if near.any():
                todo.append((level - 1, x[near], y[near]))


def forest(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Positions (i, j) that join each component of linked fingerprints of a group."""
    up = list(range(len(fp)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    for a, b in GrayIndex(fp).pairs(limit):
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = top(i), top(j)
            if i != j:
                up[max(i, j)] = min(i, j)
                out.append((i, j))
    return out


def links(distinct: DataFrame, limit: int) -> DataFrame:
    """(a, b): pairs of representatives that join linked fingerprints.  distinct: (fp, rep), fp distinct."""
    choices = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, m in enumerate(masks())])
    dealt = distinct.select("fp", "rep", F.explode(choices).alias("c")).select("c.choice", F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"), "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches_of(batches), [None]):
            if batch is None:
                if rest is None:
                    return
                now, rest = rest, None
            else:
                now = [np.concatenate(x) for x in zip(rest, batch)] if rest else batch
                choice, key = now[0], now[1]
                cut = int(np.flatnonzero((choice != choice[-1]) | (key != key[-1]))[-1:].max(initial=-1)) + 1
                now, rest = [x[:cut] for x in now], [x[cut:] for x in now]  # the last group may go on
            if not len(now[0]):
                continue
            choice, key, fp, rep = now
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
            several = ends - starts > 1
            out = [(s + i, s + j) for s, e in zip(starts[several].tolist(), ends[several].tolist()) for i, j in forest(fp[s:e], limit)]
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            if b.num_rows:
                yield [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy(zero_copy_only=False)]

    return dealt.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 2) -> DataFrame:
    """(id, fp, component) of each document; component is the smallest identifier that links reach."""
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    # Fingerprints stand for themselves while they are linked, so that one whose identifiers are all null links others too.
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), limit)).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    each = written(distinct.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    named = each.groupBy("label").agg(F.min("least").alias("component"))
    return prints.join(each.join(named, "label").select("fp", "component"), "fp")


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; none for a text without words."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    each = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)}
    return np.sort(np.fromiter(each, np.uint64, len(each)))


class Wide:
    """Wide fingerprint and candidate keys of a text's distinct shingles."""

    def __init__(self):
        draw = np.random.default_rng(SEED)
        self.salts = draw.integers(0, 1 << 63, WIDE // BITS, dtype=np.uint64)
        self.odd = draw.integers(0, 1 << 63, BANDS * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, h: np.ndarray) -> tuple[bytes, np.ndarray]:
        if not len(h):
            return bytes(WIDE // 8), np.zeros(BANDS, np.int64)
        ones, least = np.zeros((len(self.salts), BITS), np.int64), np.full(len(self.odd), ONES)
        for at in range(0, len(h), 2048):
            part = h[at : at + 2048]
            x = part ^ self.salts[:, None]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            ones += np.unpackbits(x.view(np.uint8).reshape(len(self.salts), len(part), 8), axis=2).sum(axis=1, dtype=np.int64)
            least = np.minimum(least, (part * self.odd[:, None]).min(axis=1))
        keys = [xxhash.xxh64_intdigest(least[EACH * b : EACH * (b + 1)].tobytes(), b) for b in range(BANDS)]
        return np.packbits(2 * ones > len(h)).tobytes(), np.array(keys, np.uint64).view(np.int64)


def linked(fp: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int, similarity: float) -> list[list[int]]:
    """Components of balls, as positions: fingerprints (rows of words) within limit and both radii, and sizes that agree.

    A search from each unseen row compares only with rows not yet reached: a dense group costs few comparisons.
    """
    out, rest = [], np.arange(len(fp))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        group = list(front)
        while front and len(rest):
            i = front.pop()
            sized = (low[rest] * similarity <= high[i] + 1e-9) & (low[i] * similarity <= high[rest] + 1e-9)
            near = sized & (np.bitwise_count(fp[rest] ^ fp[i]).sum(axis=1, dtype=np.int64) <= limit + radius[rest] + radius[i])
            if near.any():
                front += rest[near].tolist()
                group += rest[near].tolist()
                rest = rest[~near]
        out.append(group)
    return out


def near_balls(rows: DataFrame, limit: int, similarity: float) -> DataFrame:
    """Links (a, b) between balls of a group (key, one, two), and its components as balls with b null.

    rows: (key, one, two, id, fp, radius, low, high).  A ball stands for rows that its radius around fp
    and its range of sizes cover.  Balls are joined if any of their rows could be similar, so
    none that is similar is lost; what is joined beyond that is told apart later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, int, int]] = []
        key, out = None, []

        def settle() -> None:
            ids, prints, *sizes = zip(*held)
            fp = np.frombuffer(b"".join(prints), np.uint64).reshape(len(held), -1)
            radius, low, high = (np.array(x, np.int64) for x in sizes)
            for group in linked(fp, radius, low, high, limit, similarity):
                first = group[0]
                out.extend((key[0], ids[first], ids[j], None, 0, 0, 0) for j in group[1:])
                reach = int((np.bitwise_count(fp[group] ^ fp[first]).sum(axis=1, dtype=np.int64) + radius[group]).max())
                out.append((key[0], ids[first], None, prints[first], min(reach, WIDE), int(low[group].min()), int(high[group].max())))

        for batch in chain(batches, [None]):
            rows = zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 8]
            for k, one, two, *ball in rows:
                if (k, one, two) != key:
                    if held:
                        settle()
                    held, key = [], (k, one, two)
                held.append(tuple(ball))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(KIND.names, x)) for x in out], KIND)
                out.clear()

    KIND = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.binary()), ("radius", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    slim = rows.select("key", "one", "two", "id", "fp", "radius", "low", "high")
    dealt = slim.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "id")
    return dealt.mapInArrow(run, "key long, a long, b long, fp binary, radius long, low long, high long")


def candidates(members: DataFrame, limit: int, similarity: float) -> DataFrame:
    """(a, b): links that join rows of a key that could be similar.  members: (key, many, id, n, fp); many: rows of the key.

    A key of more than ``HELD`` rows is dealt to blocks.  Each block gives its components as
    balls, and every block of balls meets every other one of the key.
    """
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / HELD)).cast("int")
    radius = F.when(F.col("n") < FEW, WIDE).otherwise(0).cast("long")
    rows = members.select("key", "many", part.alias("one"), part.alias("two"), "id", "fp", radius.alias("radius"), F.col("n").alias("low"), F.col("n").alias("high"))
    hot = rows.where(F.col("many") > HELD)
    found = near_balls(rows.where(F.col("many") <= HELD), limit, similarity).where("b is not null").select("a", "b")
    if not hot.head(1):
        return found
    first = written(near_balls(hot, limit, similarity), "balls")
    balls = first.where("b is null").select("key", F.col("a").alias("id"), "fp", "radius", "low", "high")
    dealt = balls.join(balls.groupBy("key").agg(F.ceil(F.count("*") / HELD).cast("int").alias("many")), "key").withColumn("block", F.pmod(F.xxhash64("id"), "many").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).where("many = 1 or other != block")
    second = near_balls(met.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")), limit, similarity)
    return found.unionByName(first.unionByName(second).where("b is not null").select("a", "b"))


def similar(sets: list[np.ndarray], label: list[int], similarity: float) -> list[tuple[int, int]]:
    """Positions that join sets whose Jaccard similarity is similarity or more; rows of one label are joined already.

    A search from each unseen row compares only with rows not yet reached.  Overlaps are
    counted over the rows left or over the rows that hold the same shingles, whichever are fewer.
    """
    size = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2 or not size.sum():
        return []
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    own = [token[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
    row = np.repeat(np.arange(len(sets)), size)[np.argsort(token, kind="stable")]
    held = np.bincount(token)
    start = np.cumsum(held) - held
    mark = np.zeros(len(held), bool)
    alike: dict[int, list[int]] = {}
    for i, x in enumerate(label):
        alike.setdefault(x, []).append(i)
    left, out = np.ones(len(sets), bool), []
    rest, flat = np.empty(0, np.int64), None
    for first in range(len(sets)):
        if not left[first]:
            continue
        front = list(alike[label[first]])
        left[front] = False
        while front:
            i = front.pop()
            if flat is None or not left[rest].all():
                rest, flat = np.flatnonzero(left), None
            if not len(rest):
                return out
            if held[own[i]].sum() < size[rest].sum():
                met = np.concatenate([row[start[t] : start[t] + held[t]] for t in own[i].tolist()]) if len(own[i]) else row[:0]
                shared = np.bincount(met, minlength=len(sets))[rest]
            else:
                if flat is None:
                    flat, at = np.concatenate([own[j] for j in rest.tolist()]), np.cumsum(size[rest])
                mark[own[i]] = True
                upto = np.concatenate(([0], np.cumsum(mark[flat])))
                shared = upto[at] - upto[at - size[rest]]
                mark[own[i]] = False
            near = rest[(1 + similarity) * shared >= similarity * (size[i] + size[rest]) - 1e-9]
            for j in near.tolist():
                if left[j]:
                    out.append((i, j))
                    more = alike[label[j]]
                    left[more] = False
                    front += more
    return out


def verified(docs: DataFrame, dealt: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): exact links.  docs: (id, text); dealt: (id, label, cluster, one, two), rows of a group (cluster, one, two) are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, labels, sets = None, [], [], []
        for batch in chain(batches, [None]):
            rows = zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 6]
            out = []
            for cluster, one, two, i, label, text in rows:
                if (cluster, one, two) != key:
                    out += [(ids[a], ids[b]) for a, b in similar(sets, labels, similarity)]
                    key, ids, labels, sets = (cluster, one, two), [], [], []
                if batch is not None:
                    ids.append(i)
                    labels.append(label)
                    sets.append(shingles(text, width))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = docs.join(dealt, "id").select("cluster", "one", "two", "id", "label", "text")
    return rows.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "id").mapInArrow(run, "a long, b long")


def blocks(rows: DataFrame) -> DataFrame:
    """rows (id, cluster, label, n) with their block and the number of blocks of their cluster, of bounded size."""
    many = rows.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("many"))
    return rows.join(many, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "many").cast("int"))


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (id, cluster, n) with the smallest identifier that links reach."""
    return rows.select("id", "cluster", "n").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "cluster", "n", F.coalesce("component", "id").alias("label"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component) of each document that a chain of similar ones joins to another.

    Two texts are similar if their sets of shingles have a Jaccard similarity of ``similarity`` or more.

    1. Texts with equal sets are joined; one of them goes on.
    2. Candidates are what the Gray-order index links by 64-bit fingerprints, as :func:`near_groups` does.  At a similarity of 0.8
       such fingerprints differ in more bits than an index can bridge, so there are more of them: those that share one of ``BANDS`` keys of ``EACH`` smallest hashes.  Of these, those whose wide
       fingerprints are too far apart are pruned: at similarity s a share acos(2s / (1 + s)) / pi of the
       bits differs at most, and ``SLACK`` standard deviations more are allowed; below ``FEW``
       shingles nothing is pruned.  What stays connected is a cluster.
    3. The sets of a cluster are compared exactly.  A large cluster is dealt to blocks: first each
       block is searched, then one row of each group found, and where several groups are
       left, each block with each other.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    limit = int(WIDE * share + SLACK * (WIDE * share * (1 - share)) ** 0.5)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = Wide()
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(1)]
            found = [wide.of(h) for h in sets]
            prints = np.fromiter((fingerprint(t.as_py(), INDEXED) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([f for f, _ in found], pa.binary()), pa.array([k.tolist() for _, k in found], pa.list_(pa.int64())), pa.array(prints.view(np.int64)),
                ],
                ["id", "digest", "n", "fp", "keys", "print"],
            )

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    signed = written(slim.mapInArrow(sign, "id long, digest binary, n long, fp binary, keys array<long>, print long"), "signed")
    equal = written(signed.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("high")), "sets")
    copies = signed.join(equal.where("rep < high").select("digest", "rep"), "digest").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    chosen = signed.join(equal, "digest").where("id = rep").dropDuplicates(["digest"]).select("id", "n", "fp", "keys", "print")
    chosen = written(chosen, "chosen")
    distinct = written(chosen.groupBy("print").agg(F.min("id").alias("rep")), "distinct")
    same = chosen.select("id", "print").join(distinct, "print").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    indexed = same.unionByName(links(distinct.select(F.col("print").alias("fp"), "rep"), LIMIT))
    keyed = chosen.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("many")).where("low < high").select("key", "many")
    members = written(keyed.join(shared, "key").join(chosen.select("id", "n", "fp"), "id").select("key", "many", "id", "n", "fp"), "members")

    clusters = components(indexed.unionByName(candidates(members, limit, similarity)))
    rows = written(chosen.select("id", "n").join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"), "clusters")
    dealt = blocks(rows.withColumn("label", F.col("id"))).select("id", "label", "cluster", F.col("block").alias("one"), F.lit(0).alias("two"))
    done = written(verified(slim, dealt.hint("merge"), width, similarity), "verified")  # clusters grow with the documents
    large = written(blocks(rows).where("many > 1").select("id", "cluster", "n"), "large")
    if large.head(1):
        groups = labelled(large, components(done))
        heads = blocks(groups.where("id = label")).select("id", "label", "cluster", F.col("block").alias("one"), F.lit(0).alias("two"))
        done = written(done.unionByName(verified(slim, heads, width, similarity)), "verified")
        groups = labelled(large, components(done))
        several = groups.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cluster")
        apart = blocks(groups.join(several, "cluster"))
        other = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).where("other != block")
        pairs = other.select("id", "label", "cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
        done = written(done.unionByName(verified(slim, pairs, width, similarity)), "verified")
    return components(done.unionByName(copies))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar ones, that with the smallest identifier, with all columns.

    Documents are told apart by identifier and text, so rows that repeat an identifier are judged
    each for itself; rows that repeat both count as one document and stay or go together.  A null
    identifier is larger than all others.  Null texts count as empty; texts without words are
    alike, so one of them stays.  Very long texts are read whole.  An empty table gives no rows.
    Columns travel in one struct, so their names can't clash.
    """
    uid = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    slim = docs.select(uid.alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    groups = written(similar_groups(slim, "uid", "text", width, similarity), "groups")
    named = groups.join(slim.select(F.col("uid").alias("node"), "id").distinct(), "node")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    lost = named.join(first, "component").where(F.col("node") != F.col("first.node")).select(F.col("node").alias("uid")).distinct()
    rows = docs.select(F.struct("*").alias("row"), uid.alias("uid"))
    # Never broadcast: what is lost grows with the documents.
    return rows.join(lost.hint("merge"), "uid", "left_anti").select("row.*")
