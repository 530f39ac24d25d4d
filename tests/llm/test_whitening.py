"""Embedding whitening against numpy's eigensolver and exact integers, and on odd input."""

import math
from fractions import Fraction

import numpy as np
import pytest

from vigil.llm import queries, whitening
from vigil.llm.whitening import count_above, leading_pairs, packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, v string, code string, deviation string, whitened string, id string"


def spectrum(rng, e):
    q, _ = np.linalg.qr(rng.standard_normal((len(e), len(e))))
    m = q @ np.diag(e) @ q.T
    return (m + m.T) / 2


def test_counts_and_pairs():
    rng = np.random.default_rng(0)
    for t in range(60):
        n = int(rng.integers(1, 30))
        e = np.sort(np.abs(rng.standard_normal(n)))[::-1] * 10.0 ** rng.integers(-3, 6)
        if t % 3 == 0 and n > 3:
            e[1] = e[0]  # equal eigenvalues
        if t % 5 == 0 and n > 6:
            e[3:5] = e[2] * (1 - 1e-9)  # nearly equal ones
        if t % 7 == 0:
            e[n // 2:] = 0
        m = spectrum(rng, e)
        true = np.linalg.eigvalsh(m)[::-1]
        for s in rng.uniform(-1, e.max() * 1.1 + 1, 5):
            assert count_above(m, s) == (true > s).sum()
        values, vectors = leading_pairs(m, 4)
        k = min(4, n)
        assert np.allclose(values, true[:k], atol=1e-12 * e.max(), rtol=0)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
        assert np.abs(m @ vectors - vectors * values).max() <= 1e-11 * e.max()
    assert leading_pairs(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]
    saddle = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert [count_above(saddle, s) for s in (-2, 0, 0.5, 2)] == [2, 1, 1, 0]


def test_codes_return_their_vectors():
    x = np.array([[1, -128, 0], [1, -129, 0], [0, 0, 0], [2 ** 40, 0, 5], [-2 ** 63, 1, 0], [70000, 0, 0]])
    codes = packed(x)
    assert len(set(codes)) == 6 and codes[2] == b"\1" and len(codes[0]) == 3
    back = {c: v.tolist() for c in codes for v in np.vstack(list(unpacked([c], 3)))}
    assert [back[c] for c in codes] == x.tolist()
    assert packed(np.array([[1, -128]])) == codes[:1]


def brute(rows, k=4):
    """x vectors of the rows that stay, and the exact n, sums, covariance of the distinct ones."""
    stay = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in stay)
    stay = [(i, tuple(x + [0] * (d - len(x)))) for i, x in stay]
    fit = sorted({x for _, x in stay})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in stay]
    z = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    return stay, n, sums, dev, z.T @ z / n


def compare(rows, got):
    stay, n, sums, dev, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:4] > 1e-12 * values.sum()).sum())
    assert len(got) == k * len(stay)
    sign = {}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for (i, x), far in zip(stay, [v if v < 2 ** 63 else None for v in dev]):
        y = (n * np.array(x, float) - np.array(sums, float)) / n
        for j in range(k):
            want = float(y @ vectors[:, j]) / math.sqrt(values[j])
            same = [r for r in by[i, j + 1] if r["deviation"] == far]
            assert same
            r = min(same, key=lambda r: abs(abs(r["whitened"]) - abs(want)))
            s = sign.setdefault(j, 1 if r["whitened"] * want >= 0 else -1) if abs(want) > 1e-3 else sign.get(j, 1)
            assert abs(s * r["whitened"] - want) < 1e-6 * max(1, abs(want))
            assert r["n"] == n and abs(r["explained"] / (values[j] / values.sum()) - 1) < 1e-6 and r["identity_error"] < 1e-6


def test_query_equals_exact_covariance(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(rows, got.collect())


@pytest.mark.parametrize("offset", [0.0, 3e5])
def test_hot_vectors_offsets_and_odd_rows(spark, offset):
    rng = np.random.default_rng(5)
    e = (rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 0.5] + offset).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(e)]
    rows += [(100 + i, e[0].tolist()) for i in range(40)]  # one vector, a third of the rows
    rows += [(None, e[1].tolist()), (7, e[2].tolist()), (200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 6),
             (203, [float("inf")] + [0.0] * 5), (204, e[3].tolist()[:4]), (205, [])]
    docs = spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], SCHEMA).repartition(3)
    compare(rows, whitening.report(docs).collect())


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        docs = spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], SCHEMA)
        assert whitening.report(docs).count() == 0
    far = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.report(far).collect()  # entries beyond 64 bits stay at its ends, deviations beyond it are null
    assert {r["component"] for r in got} >= {1} and all(r["deviation"] is None for r in got if r["vec_id"] != 3)
