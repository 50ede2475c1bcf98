"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("provlog.llm")
from provlog.llm import queries as Q  # noqa: E402
from provlog.llm import tandem as T  # noqa: E402


def brute(words: list, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            kinds = rng.choice([1, 2, 2, 3, 5, 50])
            w = [rng.randrange(kinds) for _ in range(rng.randint(0, rng.choice([10, 40, 120])))]
            if rng.random() < 0.5 and len(w) > 3:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(2, 6)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            if rng.random() < 0.3:
                w = w + w[: rng.randint(0, len(w))] + [99] + w
            docs.append([str(x).encode() for x in w])
        for least in (12, 3):
            got = sorted(zip(*[x.tolist() for x in T.found_in(*T.split(docs), least)]))
            assert got == sorted((d, *r) for d, w in enumerate(docs) for r in brute(w, least))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = ["a", "b", "Ü", "x\x85y", "é\xa0", "z"]
    texts = [None, "", " \t\x0b ", "a", "a " * 500, "a b " * 40, "\n".join(["same line again"] * 9)]
    texts += ["  ".join(rng.choice(words[: rng.randint(2, 6)]) for _ in range(rng.randint(1, 150))) for _ in range(70)]
    rows = [(i * 7, t, 1, "r") for i, t in enumerate(texts)] + [(None, "a b " * 10, 1, "r"), (14, texts[20], 1, "r"), (14, texts[20], 1, "r")]
    spark.createDataFrame(rows, "doc_id long, text string, start int, id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = brute(w, 12)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((key, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], sha("".join(f"{s},{x},{q}\n" for s, x, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_long_text(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op12_periodic_runs(spark, str(tmp_path)).collect() == []
    rng = random.Random(3)
    body = [str(rng.randrange(3000)) for _ in range(100_000)]
    long = body + body[-70_000:] + ["end"]
    row = T.runs(spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string")).collect()[0]
    assert (row["starts"], row["lengths"], row["periods"]) == ([30_000], [140_000], [70_000])
    assert row["collapsed"] == " ".join([*body, "end"])
