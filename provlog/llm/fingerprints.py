"""Document fingerprints: a homomorphic multiset hash of paragraphs (native).

A paragraph (a line that isn't only spaces) is hashed to a wide vector:

* ``STRONG`` lanes from its SHA-256, for equality;
* ``LANES`` lanes that count, over its words, the set bits of the hash of each word with the
  two words before it in the paragraph, for likeness; and one lane that counts the words.

A fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2**32.  Addition
commutes, so the order of paragraphs doesn't matter, and an edit costs only the paragraphs
it takes out or puts in: ``edited = document - old paragraphs + new paragraphs``.

Likeness is the cosine of the centred count lanes (each word adds +1 or -1 to each), which
estimates the share of common word triples, cut to 0 to 1.  Fingerprints without words are
like each other (1) and unlike the rest (0).

A null text counts as empty.  The next document is the one with the next larger identifier,
after the last the first.  Where rows repeat an identifier, the smallest of their beginnings
and the smallest of their fingerprints stand for the next document.  Null identifiers have
no next document: they are edited with an empty text and near_next is 0 or, without words, 1.
Texts of any length are read whole.  An empty table gives no rows.  Other columns aren't read, so
their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlog.llm.common import whole_text, written

LANES = 62
STRONG = 8
#: Two lanes are counted side by side in one long; a text can't hold 2**31 words.
PAIR = 1 | 1 << 31
WORD = "[ \\t\\n\\x0B\\f\\r]+"


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, next_id, prev_id, take): take is a quarter of the code points of the document before.

    rows: (id, n).  Ranges of identifiers are dealt to tasks; only the edges of ranges meet in one place.
    """
    ranged = rows.where("id is not null").repartitionByRange("id").withColumn("range", F.spark_partition_id())
    ids = written(ranged.groupBy("range", "id").agg(F.max("n").alias("n")), "ids")
    edges = ids.groupBy("range").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max_by("n", "id").alias("high_n"))
    order = W.orderBy("range")  # one row for each range
    span = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = edges.select(
        "range",
        F.coalesce(F.lead("low").over(order), F.first("low").over(span)).alias("after"),
        F.coalesce(F.lag("high").over(order), F.last("high").over(span)).alias("before"),
        F.coalesce(F.lag("high_n").over(order), F.last("high_n").over(span)).alias("before_n"),
    )
    within = W.partitionBy("range").orderBy("id")
    return (
        ids.withColumns({"up": F.lead("id").over(within), "down": F.lag("id").over(within), "down_n": F.lag("n").over(within)})
        .join(F.broadcast(edges), "range")  # as many rows as there are partitions
        .select(
            "id",
            F.coalesce("up", "after").alias("next_id"),
            F.coalesce("down", "before").alias("prev_id"),
            F.floor(F.coalesce("down_n", "before_n") / 4).cast("int").alias("take"),
        )
    )


def hashed(paragraph: Column) -> Column:
    """A 64-bit hash of each word and the two before it.

    The words are bound as a lambda's argument, so that they are split once and not for each word.
    """
    words = F.filter(F.split(paragraph, WORD), lambda w: w != "")
    before = lambda ws, i: F.coalesce(F.get(ws, i), F.lit(""))
    return F.element_at(F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, before(ws, i - 1), before(ws, i - 2)))), 1)


def vectors(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and lanes, array<long>: the sum over each part's paragraphs.

    parts: keys that tell rows apart, and text.  Rows must be partitioned by one of the keys, or are shuffled.
    """
    found = parts.select(*keys, F.explode_outer(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")).alias("p"))
    words = found.select(*keys, F.sha2("p", 256).alias("sha"), F.posexplode_outer(hashed(F.col("p"))).alias("at", "h"))
    first = F.coalesce("at", F.lit(0)) == 0
    strong = [F.sum(F.when(first, F.conv(F.substring("sha", 8 * j + 1, 8), 16, 10).cast("long"))).alias(f"p{j}") for j in range(STRONG)]
    packed = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(PAIR))).alias(f"s{k}") for k in range(LANES // 2)]
    sums = words.groupBy(*keys).agg(F.count("h").alias("n"), *strong, *packed)
    low = [F.col(f"s{k}").bitwiseAND(F.lit((1 << 31) - 1)) for k in range(LANES // 2)]
    high = [F.shiftright(F.col(f"s{k}"), 31) for k in range(LANES // 2)]
    lanes = [F.col(f"p{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(STRONG)] + [F.col("n"), *low, *high]
    return sums.select(*keys, F.array(*[F.coalesce(x, F.lit(0)).cast("long") for x in lanes]).alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(0xFFFFFFFF)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(0xFFFFFFFF)))


def likeness(a: Column, b: Column) -> Column:
    def centred(v: Column) -> Column:
        return F.transform(F.slice(v, STRONG + 2, LANES), lambda x: (2 * x - F.element_at(v, STRONG + 1)).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = centred(a), centred(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    near = F.when(a == b, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(0.0)
    return F.coalesce(near, F.when(F.element_at(a, STRONG + 1) == 0, 1.0).otherwise(0.0))


def text_form(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.hex(x))), "-")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lanes) of each document; rows that repeat an identifier each have a row."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), whole_text(text_col).alias("text"))
    return vectors(rows.repartition("id"), ["id", "uid"]).select("id", "lanes")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, next_id, body, n, k, kept, new, n_chars, edited_sha256) of each document: what its edit keeps of it and what it brings."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), whole_text(text_col).alias("body"))
    links = written(neighbours(rows.select("id", F.length("body").alias("n"))), "links")
    joined = rows.join(links, "id", "left")
    # Not filtered by prev_id: both uses of joined must stay alike, so that the text is shuffled once.
    lead = joined.select(F.col("prev_id").alias("id"), F.struct(F.expr("substring(body, 1, take)").alias("lead"), "uid").alias("x"))
    lead = lead.groupBy("id").agg(F.min("x").alias("x"))
    both = joined.join(lead, "id", "left").withColumn("n", F.length("body")).withColumn("k", F.floor(F.col("n") / 4).cast("int"))
    both = both.withColumns({"kept": F.expr("substring(body, 1, n - k)"), "new": F.coalesce(F.expr("substring(x.lead, 1, k)"), F.lit(""))})
    return both.withColumns({"n_chars": F.col("n").cast("long"), "edited_sha256": F.sha2(F.concat("kept", "new"), 256)})


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, lanes, edited_lanes, near_edited, near_next) of each document."""
    both = edits(docs, id_col, text_col)
    # The paragraph that the edit cuts through, and what follows, comes out; the rest stays.
    carry = F.substring_index("kept", "\n", -1)
    parts = both.select(
        "id", "uid", "next_id", "n_chars", "edited_sha256",
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.expr("left(kept, length(kept) - length(substring_index(kept, '\n', -1)))").alias("text")),
            F.struct(F.lit(1).alias("part"), F.concat(carry, F.expr("substring(body, n - k + 1)")).alias("text")),
            F.struct(F.lit(2).alias("part"), F.concat(carry, F.col("new")).alias("text")),
        )).alias("p"),
    )
    keys = ["id", "uid", "next_id", "n_chars", "edited_sha256"]
    summed = vectors(parts.select(*keys, "p.part", "p.text"), [*keys, "part"])
    of = lambda k: F.max(F.when(F.col("part") == k, F.col("lanes")))
    whole = summed.groupBy(*keys).agg(of(0).alias("head"), of(1).alias("old"), of(2).alias("new"))
    whole = whole.withColumn("lanes", plus(F.col("head"), F.col("old")))
    whole = whole.withColumn("edited_lanes", plus(minus(F.col("lanes"), F.col("old")), F.col("new")))
    whole = written(whole.drop("head", "old", "new", "uid"), "fingerprints")
    after = whole.where("id is not null").groupBy(F.col("id").alias("next_id")).agg(F.min("lanes").alias("next_lanes"))
    near = likeness(F.col("lanes"), F.coalesce("next_lanes", F.array_repeat(F.lit(0).cast("long"), STRONG + 1 + LANES)))
    return whole.join(after, "next_id", "left").select(
        "id", "n_chars", "edited_sha256", "lanes", "edited_lanes", likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), near.alias("near_next")
    )
