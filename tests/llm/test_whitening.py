"""Whitening against exact fractions and a plain eigen-solve."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("provlog.llm")
from provlog.llm import queries as Q  # noqa: E402
from provlog.llm import whitening as W  # noqa: E402

KIND = "vec_id long, embedding array<float>, label int, x int, id string, component int"


def saved(spark, path, rows: list[tuple]) -> str:
    spark.createDataFrame([(i, v, None, 1, "a", 2) for i, v in rows], KIND).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 65])
def test_eigen_solve(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, size))
    for m in (a @ a.T, np.eye(size), np.diag(np.arange(size) // 3).astype(float), np.outer(a[0], a[0]), np.eye(size) * 1e-9 + np.outer(a[0], a[0]), np.zeros((size, size))):
        values, vectors = W.eigen(m)
        top = max(np.abs(m).max(), 1e-300) * size
        assert np.abs(values - np.linalg.eigvalsh(m)[::-1]).max() <= 1e-14 * top
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13
        assert np.abs(m @ vectors - vectors * values).max() <= 1e-14 * top


def test_products_are_summed_beyond_double_precision():
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, size=(3000, 3)) + rng.integers(0, 2, size=(3000, 1)) * 900_000_000
    centre = W.Centre(len(x), tuple(int(s) for s in x.sum(axis=0)))
    total = W.DoubleDouble((3, 3))
    W.add_products(total, *centre.apply(x))
    mean = [Fraction(s, centre.n) for s in centre.sums]
    for i in range(3):
        for j in range(3):
            exact = sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x)
            assert abs(Fraction(total.high[i, j]) + Fraction(total.low[i, j]) - exact) < abs(exact) * Fraction(1, 1 << 80)


def test_query_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 20)) * rng.uniform(0.1, 2, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, vectors[3].tolist()), (3, vectors[3].tolist()), *[(1000 + i, vectors[0].tolist()) for i in range(200)]]
    odd = [(500, None), (501, [float("nan")] * 20), (502, [None] + [0.0] * 19), (503, [float("inf")] + [0.0] * 19), (504, []), (505, [1.0])]
    got = Q.op11_whitening(spark, saved(spark, tmp_path / "v", rows + odd)).collect()
    assert len(got) == 16 * len(rows)
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    of = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in rows}
    sign = {}
    for r in got:
        c, one = r["component"] - 1, of[r["vec_id"]]
        assert r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(one, s))
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-10)
        want = (one - s / n) @ basis[:, c] / np.sqrt(values[c])
        if abs(want) > 0.1:
            assert sign.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-8, abs=1e-9)


def test_no_variance_and_no_rows(spark, tmp_path):
    assert Q.op11_whitening(spark, saved(spark, tmp_path / "none", [])).collect() == []
    assert Q.op11_whitening(spark, saved(spark, tmp_path / "odd", [(1, None), (2, [])])).collect() == []
    one = Q.op11_whitening(spark, saved(spark, tmp_path / "one", [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, None, None)] * 4
    flat = Q.op11_whitening(spark, saved(spark, tmp_path / "flat", [(1, [0.5, 0.25]), (2, [1.5, 0.25])])).collect()
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else abs(round(r["whitened"], 9))) for r in flat) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
