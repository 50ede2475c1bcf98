"""The stages of the pipeline, each against brute force, and on odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("provlog.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from test_contracts import brute_windows, low  # noqa: E402
from test_near_dedup import brute  # noqa: E402

from provlog.llm import toxicity  # noqa: E402
from provlog.llm.common import tokenizer_file  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def table() -> dict[int, str | None]:
    rng = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts: list[str | None] = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        texts.append(" ".join([*body, passage]) if i % 4 == 0 else " ".join(body))
    texts += [texts[1].upper(), texts[2], texts[3] + " more", "", None, " ", " ".join(rng.choice(words) for _ in range(4000)), "nasty slur " * 9, "nasty slur nasty " + texts[5]]
    ids = rng.sample(range(1000), len(texts))
    return dict(zip(ids, texts))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("pipeline"))
    rng, texts = random.Random(2), table()
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()]
    labels = [(i, 1, int("nasty" in (t or ""))) for i, t in texts.items()]
    for k in range(60):  # labelled texts, half of them toxic
        body = " ".join(rng.choice(["one", "two", "six", "ten"]) for _ in range(20))
        rows.append((2000 + k, f"{body} nasty slur" if k % 2 else f"{body} {k}", "en", "web", 0))
        labels.append((2000 + k, 1, k % 2))
    spark.createDataFrame(rows, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_is_what_brute_force_gives(spark, folder):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert kept == {i: t for i, t in docs.items() if "nasty" not in (t or "")}
    groups: dict[str, int] = {}
    for i, t in kept.items():
        groups[low(t)] = max(i, groups.get(low(t), -1))
    kept = {i: t for i, t in kept.items() if groups[low(t)] == i}
    near = brute({i: t or "" for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if near[i] == i}
    units = {i: (t or "").encode().split() for i, t in kept.items()}
    gone = brute_windows(units, 13)
    assert sum(map(sum, gone.values())) > 100
    kept = {i: b" ".join(w for w, g in zip(units[i], gone[i]) if not g).decode() if any(gone[i]) else t for i, t in kept.items()}
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in kept.items()}
    rows = pipeline.run(spark, folder).collect()
    at = {i: 0 for i in want}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in want.items()}


ODD = {
    "nulls": [(None, None, None, None, None), (1, None, None, None, None), (None, "a b c", None, None, None)],
    "empty table": [],
    "ties and repeated rows": [(1, "a b c d e f", "x", "s", 1)] * 3 + [(2, "a b c d e f", "x", "s", 1), (2, "g", "y", "s", 1), (2, "G", "y", "s", 1)],
    "very long": [(1, "word " * 60_000, "x", "s", 1), (2, "é" * 200_000, "x", "s", 1), (3, "word " * 60_001, "x", "s", 1), (4, "", "x", "s", 0)],
}


@pytest.mark.parametrize("case", ODD)
def test_stages_take_odd_tables(spark, tmp_path, case):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ODD[case], KIND)
    rows, texts = len(ODD[case]), {(t or "").lower() for _, t, *_ in ODD[case]}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        n = out.count()
        if name == "toxicity":
            assert n == rows
        elif name == "exact_dedup":
            assert n == len(texts)
        elif name == "packing":
            assert out.select("doc_id").distinct().count() <= n and n >= docs.count()
            break
        assert out.columns == docs.columns and n <= docs.count()
        docs = out


def test_near_stage_judges_rows_that_repeat_an_identifier(spark):
    from provlog.llm.simhash import near_dedup

    rng = random.Random(4)
    body = [f"u{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(5, " ".join(body)), (7, " ".join([*body[:-1], "x"])), (7, "something else altogether"), (None, " ".join([*body[:-2], "y", "z"])), (None, "alone")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_recall_of_the_near_stage(spark):
    """Of pairs at a similarity of 0.8 to 0.85 nine in ten at least are found, and none below 0.8 is."""
    from test_near_dedup import found, sets_of

    rng, texts, pairs, below = random.Random(21), {}, [], []
    for k in range(160):
        n = rng.randint(60, 300)
        words = [f"n{rng.randrange(10**9)}" for _ in range(n)]
        other, share = list(words), rng.uniform(0.02, 0.032) if k % 4 else rng.uniform(0.04, 0.06)
        for i in rng.sample(range(n), max(1, int(n * share))):
            other[i] = f"o{rng.randrange(10**9)}"
        a, b = " ".join(words), " ".join(other)
        x, y = sets_of(a), sets_of(b)
        j = len(x & y) / len(x | y)
        if 0.8 <= j <= 0.85 or 0.7 < j < 0.8:
            texts[2 * k], texts[2 * k + 1] = a, b
            (pairs if j >= 0.8 else below).append(2 * k)
    got = found(spark, texts)
    caught = sum(got[i] == got[i + 1] for i in pairs)
    print("near stage:", caught, "of", len(pairs), "at 0.80 to 0.85;", sum(got[i] == got[i + 1] for i in below), "of", len(below), "at 0.70 to 0.80")
    assert len(pairs) >= 15 and caught >= 0.9 * len(pairs) and not any(got[i] == got[i + 1] for i in below)


def test_chain_is_fitted_on_out_of_fold_predictions():
    """A brute-force pass over folds gives the chain's models, and a later category sees the earlier ones' odds."""
    rng = np.random.default_rng(5)
    n = 240
    y1 = (rng.random(n) < 0.5).astype(float)
    y2 = np.where(rng.random(n) < 0.9, y1, 1 - y1)  # told by the first category alone
    rows = [sorted({int(10 + y1[i])} | {int(x) for x in rng.integers(100, 140, 3)}) for i in range(n)]
    x = toxicity.Cases(np.repeat(np.arange(n), [len(r) for r in rows]), np.array([f for r in rows for f in r], np.int32), n)
    fold = np.arange(n) % toxicity.FOLDS
    chain = toxicity.train(x, {"one": y1, "two": y2}, fold)
    odds, earlier = np.zeros(n), np.zeros((n, 0))
    for k in range(toxicity.FOLDS):
        model, all_odds = toxicity.fit(x, y1, fold != k, earlier)
        for i in np.flatnonzero(fold == k):
            by_hand = model.bias + sum(model.weights.get(f, 0.0) for f in rows[i])
            assert abs(by_hand - all_odds[i]) < 1e-9
            odds[i] = by_hand
    second, _ = toxicity.fit(x, y2, np.ones(n, bool), odds[:, None])
    assert chain.names == ["one", "two"] and chain.models[0].chained == [] and chain.models[1].chained == second.chained and chain.models[1].weights == second.weights
    for i in range(0, n, 17):
        p1, p2 = chain.predict(np.array(rows[i]))
        o1 = chain.models[0].bias + sum(chain.models[0].weights.get(f, 0.0) for f in rows[i])
        o2 = second.bias + sum(second.weights.get(f, 0.0) for f in rows[i]) + second.chained[0] * o1
        assert abs(p1 - 1 / (1 + np.exp(-o1))) < 1e-9 and abs(p2 - 1 / (1 + np.exp(-o2))) < 1e-9
    best = max((2 * ((odds >= t) & (y1 == 1)).sum() / ((odds >= t).sum() + y1.sum()) for t in odds))
    at = np.log(chain.limits[0] / (1 - chain.limits[0]))
    assert abs(2 * ((odds >= at) & (y1 == 1)).sum() / ((odds >= at).sum() + y1.sum()) - best) < 1e-9
