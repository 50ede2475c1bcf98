"""Toxicity: a classifier chain over label categories.

Categories are predicted one after the other.  Each has a linear (logistic) model over the
features of a text and the log-odds of the categories before it.  A later model is trained
on out-of-fold predictions of the earlier ones, so it sees them as wrong as they will be
on new texts.  Features are the presence of words, of word beginnings of four and five
characters, and of coarse counts (length, share of symbols, of capitals, of repeated words).
For each model those features are kept whose log-odds between the classes stand out by
``Z`` standard errors; in every fold anew.

Training reads a bounded sample: at most ``max_rows`` labelled rows, those with the smallest
hash of their identifier; only their feature numbers reach the driver.  Scoring reads every
whole text, in any number of tasks, with weights of a fixed size.

A null text counts as empty.  Label rows with a null label are left out; where an identifier
repeats in labels its largest label counts, and where it repeats in documents each row is a
case.  With fewer than ``FEW`` cases of either class a category's probability is the share of
its cases (0 without labels), and nothing is rejected for it.  Texts of any length are scored
whole; a text at the limit is rejected; rows that repeat an identifier are scored each for itself,
null identifiers like others.  An empty table gives no rows.  Columns are carried as one struct,
so their names can't clash.

The first category is that of texts of low quality, because the labels know two: it is a link of the
chain (toxic texts are seldom good ones) and rejects nothing by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1 << 20
MAX_ROWS = 12_000
FOLDS = 3
Z = 3.5
FEW = 5
CACHE = 400_000
#: Texts that are Python's own strings at once.
PART = 256
#: Category and the expression over the labels table that is 1 for it.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
SYMBOL = re.compile(r"[#$%&*|!=<>{}@^~]")
NOT_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSIONS


class Features:
    """Feature numbers of a text; each word's are worked out once.  wanted: leave out others."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted, self.known = wanted, {}

    def word(self, word: str) -> tuple[int, ...]:
        found = tuple(number(x) for x in ("w" + word, "4" + word[:4], "5" + word[:5]))
        return found if self.wanted is None else tuple(i for i in found if self.wanted[i])

    def of(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = text.encode().translate(NOT_WORD).decode().split()
        distinct, known, out = set(words), self.known, set()
        if len(known) > CACHE:
            known.clear()
        for w in distinct:
            found = known.get(w)
            if found is None:
                known[w] = found = self.word(w)
            if found:
                out.update(found)
        n = max(1, len(text))
        shares = {
            "length": n.bit_length() // 2,
            "symbols": 20 * len(SYMBOL.findall(text)) // n,
            "capitals": 10 * sum(map(str.isupper, text)) // n,
            "distinct": 10 * len(distinct) // max(1, len(words)),
        }
        coarse = [number(f"-{name} {size}") for name, size in shares.items()]
        out.update(i for i in coarse if self.wanted is None or self.wanted[i])
        return np.fromiter(sorted(out), np.int32, len(out))


@dataclass
class Linear:
    """A logistic model over feature numbers and the log-odds of earlier categories."""

    weights: dict[int, float]
    bias: float
    chained: list[float]


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    limits: list[float]

    def wanted(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS, bool)
        for m in self.models:
            out[list(m.weights)] = True
        return out

    def predict(self, features: np.ndarray) -> list[float]:
        odds: list[float] = []
        for m in self.models:
            z = m.bias + sum(m.weights.get(i, 0.0) for i in features.tolist()) + sum(a * b for a, b in zip(m.chained, odds))
            odds.append(float(np.clip(z, -30, 30)))
        return [1 / (1 + float(np.exp(-z))) for z in odds]


@dataclass
class Cases:
    """Feature numbers of many texts, one after the other; row says whose each is."""

    row: np.ndarray
    feature: np.ndarray
    n: int


def fit(x: Cases, y: np.ndarray, use: np.ndarray, extra: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[Linear, np.ndarray]:
    """A model fitted on the rows in use, and its log-odds for all rows."""
    pos, neg = int(y[use].sum()), int((1 - y[use]).sum())
    if min(pos, neg) < FEW:
        share = pos / max(1, pos + neg)
        bias = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)) if pos + neg else -30.0
        return Linear({}, bias, [0.0] * extra.shape[1]), np.full(x.n, bias)
    inside = use[x.row]
    hits = np.bincount(x.feature[inside & (y[x.row] == 1)], minlength=DIMENSIONS)
    misses = np.bincount(x.feature[inside & (y[x.row] == 0)], minlength=DIMENSIONS)
    a, b = hits + 0.5, misses + 0.5 * neg / pos
    z = (np.log(a / (pos - hits + 1)) - np.log(b / (neg - misses + 1))) / np.sqrt(1 / a + 1 / b)
    kept = np.flatnonzero((np.abs(z) > Z) & (hits + misses >= 3))
    place = np.full(DIMENSIONS, -1)
    place[kept] = np.arange(len(kept))
    column = place[x.feature]
    row, column = x.row[column >= 0], column[column >= 0]
    w, bias, chained = np.zeros(len(kept)), float(np.log(pos / neg)), np.zeros(extra.shape[1])
    weight, m = use.astype(float), use.sum()
    size = np.maximum(1.0, np.bincount(column[use[row]], minlength=len(kept)))
    speed = [np.zeros(len(kept)), 0.0, np.zeros(extra.shape[1])]

    def odds() -> np.ndarray:
        return np.clip(np.bincount(row, w[column], x.n) + bias + extra @ chained, -30, 30)

    for _ in range(steps):  # gradient steps with momentum, scaled by how frequent a feature is
        left = (1 / (1 + np.exp(-odds())) - y) * weight
        slopes = [np.bincount(column, left[row], len(kept)) / np.sqrt(size * m) + ridge * w, left.sum() / m, (extra * left[:, None]).sum(axis=0) / m / 10]
        speed = [0.9 * s + 0.3 * g for s, g in zip(speed, slopes)]
        w, bias, chained = w - speed[0], bias - speed[1], chained - speed[2]
    return Linear(dict(zip(kept.tolist(), w.tolist())), float(bias), chained.tolist()), odds()


def best_limit(odds: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on the F1 score of out-of-fold predictions is highest."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(score.argmax())
    below = odds[order[at + 1]] if at + 1 < len(y) else odds[order[at]]
    return float(1 / (1 + np.exp(-(odds[order[at]] + below) / 2)))


def train(x: Cases, labels: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    chain, out_of_fold = Chain([], [], []), np.zeros((x.n, 0))
    for name, y in labels.items():
        odds = np.zeros(x.n)
        for k in range(FOLDS):
            odds[fold == k] = fit(x, y, fold != k, out_of_fold)[1][fold == k]
        chain.names.append(name)
        chain.models.append(fit(x, y, np.ones(x.n, bool), out_of_fold)[0])
        few = x.n == 0 or min(y.sum(), (1 - y).sum()) < FEW
        chain.limits.append(2.0 if few else best_limit(odds, y))
        out_of_fold = np.column_stack((out_of_fold, odds))
    return chain


def training_cases(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...], max_rows: int, id_col: str, text_col: str) -> tuple[Cases, dict[str, np.ndarray], np.ndarray]:
    targets = labels.select(F.col("doc_id").alias("id"), *[F.expr(e).cast("int").alias(f"c{i}") for i, (_, e) in enumerate(chain)])
    sample = targets.dropna().groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(chain))])
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts = batch.column(0)
            found = [features.of(t).tobytes() for at in range(0, len(texts), PART) for t in texts.slice(at, PART).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["found", *batch.schema.names[1:]])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")  # max_rows rows
    rows = rows.select("text", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), *[f"c{i}" for i in range(len(chain))])
    kinds = ", ".join(["found binary", "fold long", *[f"c{i} int" for i in range(len(chain))]])
    got = rows.mapInArrow(run, kinds).toArrow()
    each = [np.frombuffer(b, np.int32) for b in got.column("found").to_pylist()]
    cases = Cases(np.repeat(np.arange(len(each)), [len(e) for e in each]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *each]), len(each))
    return cases, {name: got.column(f"c{i}").to_numpy().astype(float) for i, (name, _) in enumerate(chain)}, got.column("fold").to_numpy()


def fit_chain(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    return train(*training_cases(docs, labels, chain, max_rows, id_col, text_col))


def probabilities(model: Chain, text: Column) -> Column:
    """A struct with the probability of each category."""
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in model.names])

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(model.wanted())
        for texts in batches:
            yield pd.DataFrame([model.predict(features.of(t)) for t in texts], columns=model.names, dtype=float)

    return score(text.cast("string"))


def scored(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one probability for each category, one flag for each category)."""
    found = docs.select(F.col(id_col).alias("id"), probabilities(model, F.col(text_col)).alias("p"))
    flags = [(F.col(f"p.{n}") >= limit).alias(f"is_{n}") for n, limit in zip(model.names, model.limits)]
    return found.select("id", *[F.col(f"p.{n}").alias(f"p_{n}") for n in model.names], *flags)


def without_toxic(docs: DataFrame, model: Chain, text_col: str = "text", category: str = "toxic") -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    limit = model.limits[model.names.index(category)]
    rows = docs.select(F.struct("*").alias("row"), probabilities(model, F.col(text_col)).alias("p"))
    return rows.where(F.col(f"p.{category}") < limit).select("row.*")
