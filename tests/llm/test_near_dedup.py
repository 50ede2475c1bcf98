"""The near-dedup stage of the pipeline against brute force over exact shingle sets."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("provlog.llm")

from provlog.llm import simhash  # noqa: E402


def sets_of(t: str, width: int = 5) -> frozenset:
    words = t.lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(texts: dict[int, str], similarity: float = 0.8) -> dict[int, int]:
    sets, group = {i: sets_of(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            x, y = sets[a], sets[b]
            if a < b and group[a] != group[b] and len(x & y) >= similarity * len(x | y) - 1e-9:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def pairs_around(similarity: float = 0.8) -> dict[int, str]:
    """Pairs of texts with similarities about the limit: of a and of b shingles, a of them shared."""
    rng, out = random.Random(11), {}
    for n in (4, 5, 9, 20, 80, 200):
        for more in (0.15, 0.2, 0.25, 0.26, 0.3, 0.34):
            for _ in range(4):
                words = [f"u{rng.randrange(10**9)}" for _ in range(n + 4)]
                added = [f"u{rng.randrange(10**9)}" for _ in range(int(n * more))]
                out[len(out)] = " ".join(words)
                out[len(out)] = " ".join(words + added)
    out |= {len(out): "", len(out) + 1: "  ", len(out) + 2: out[0].upper()}
    return out


def found(spark, texts: dict[int, str]) -> dict[int, int]:
    got = {r["node"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    return {i: got.get(i, i) for i in texts}


def test_groups_are_those_of_exact_similarity(spark):
    texts = pairs_around()
    want = brute(texts)
    assert 60 < sum(i != g for i, g in want.items()) < 120
    assert found(spark, texts) == want


def test_clusters_of_many_blocks(spark, monkeypatch):
    """Chains of edits and copies that fingerprints join but sets don't, over blocks of three rows."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    rng, texts = random.Random(3), {}
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(120)]
        for step in range(12):
            texts[len(texts)] = " ".join(words)
            words[5 * step : 5 * step + 2 + family] = [f"n{rng.randrange(10**9)}" for _ in range(2 + family)]
            if family == 3 and step % 4 == 3:
                words = words[:60] + [f"n{rng.randrange(10**9)}" for _ in range(6)] + words[66:]
    assert found(spark, texts) == brute(texts)


def test_a_key_with_more_rows_than_are_held_keeps_every_link(spark, monkeypatch):
    """A chain of fingerprints, each near the one before alone, and unlike ones, all with one key."""
    import numpy as np
    from pyspark.sql import functions as F

    from provlog.llm.components import components

    monkeypatch.setattr(simhash, "HELD", 3)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(12):
        texts[i] = " ".join(words)
        words[30 * i : 30 * i + 6] = [f"n{i}x{j}" for j in range(6)]
    rng, base = np.random.default_rng(1), np.zeros(1024, np.uint8)
    rows = []
    for i in range(20):
        rows.append((1, 40, i, 100, np.packbits(base).tobytes()))
        base[50 * i : 50 * i + 50] = 1
    rows += [(1, 40, 100 + i, 100, np.packbits(rng.integers(0, 2, 1024, dtype=np.uint8)).tobytes()) for i in range(20)]
    members = spark.createDataFrame([(k, m, i, n, bytearray(f)) for k, m, i, n, f in rows], "key long, many long, id long, n long, fp binary")
    got = {r["node"]: r["component"] for r in components(simhash.candidates(members, 60, 0.8)).collect()}
    assert {got[i] for i in range(20)} == {0}
    assert found(spark, texts) == brute(texts)
    plan = simhash.candidates(members.where(F.col("id") < 3).withColumn("many", F.lit(3).cast("long")), 60, 0.8)
    assert {(r["a"], r["b"]) for r in plan.collect()} == {(0, 1), (0, 2)}


def test_candidates_come_from_the_gray_order_index(spark, monkeypatch):
    """Similar texts that share none of the other candidates' keys are found by the index alone, and what it links is checked exactly."""
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "x"]), 3: " ".join(f"v{i}" for i in range(400))}
    assert bin(simhash.fingerprint(texts[1], simhash.INDEXED) ^ simhash.fingerprint(texts[2], simhash.INDEXED)).count("1") <= simhash.LIMIT
    none = lambda members, limit, similarity: members.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "candidates", none)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs, similarity=0.9999).collect()) == [1, 2, 3]
