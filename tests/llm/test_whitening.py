import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from livetext.llm.whitening import above, inertia, leading, op12_whitening, whiten


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10_000), st.sampled_from(["dense", "integers", "zero diagonal", "diagonal"]))
def test_inertia_counts_eigenvalues(d, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((d, d)) if kind != "integers" else rng.integers(-2, 3, (d, d)).astype(float)
    a = a + a.T
    if kind == "zero diagonal":
        np.fill_diagonal(a, 0)
    if kind == "diagonal":
        a = np.diag(np.diag(a))
    values = np.linalg.eigvalsh(a)
    if np.abs(values).min() > 1e-9:  # a zero counts on neither side, or on either by rounding
        assert inertia(a) == (int((values > 0).sum()), int((values < 0).sum()))


@pytest.mark.parametrize("spectrum", [np.arange(64, 0, -1.0), 0.5 ** np.arange(40), [5, 5, 5, 5, 1, 1, 1, 0.5], [3, 3 - 1e-9, 3 - 2e-9, 2, 1, 1e-3], [7] * 20, [4, 2, 0, 0, 0], [1e12, 1, 1e-2], [9]])
def test_leading_eigenpairs(spectrum):
    spectrum = np.array(spectrum, float)
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((len(spectrum), len(spectrum))))
    v = (q * spectrum) @ q.T
    values, vectors = leading(v, 16)
    want = np.sort(spectrum)[::-1]
    want = want[want > len(want) * 1e-13 * want.sum()][:16]
    assert len(values) == len(want) and np.allclose(values, want, rtol=0, atol=1e-12 * spectrum.sum())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-11 * spectrum.sum()
    assert all(above(v, x - 1e-10 * spectrum.sum()) >= k for k, x in enumerate(values, 1))


def test_nothing_to_find():
    assert leading(np.zeros((3, 3)), 16)[0].size == 0 and leading(np.zeros((0, 0)), 16)[0].size == 0


def brute(rows, components=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), by the definition."""
    good = [(i, c) for i, c in rows if c and all(x is not None and math.isfinite(x) for x in c)]
    if not good:
        return {}
    x = [[math.floor(64 * e) + 1_000_000 for e in np.asarray(c, np.float64)] for _, c in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    keep = [k for k in range(min(components, len(e))) if e[k] > len(e) * 1e-13 * e.sum() > 0]
    out = collections.defaultdict(list)
    for (i, _), row in zip(good, x, strict=True):
        y = np.array([(n * a - s) / n for a, s in zip(row, sums, strict=True)])
        for k in keep:
            out[i, k + 1].append((n, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)), abs(y @ u[:, k]) / e[k] ** 0.5, e[k] / e.sum()))
    return out


def same(got, want):
    found = collections.defaultdict(list)
    for r in got:
        found[r.vec_id, r.component].append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert found.keys() == want.keys()
    for key, rows in want.items():
        for a, b in zip(sorted(found[key]), sorted(rows), strict=True):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-8, atol=1e-8)


SCHEMA = "vec_id long, embedding array<float>, label string, x string, n int"


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.standard_normal(5)]) for k in range(40)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, c, None, "x", 3) for i, c in rows], SCHEMA)
    got = whiten(df.repartition(3)).collect()
    same(got, brute([(i, c) for i, c in rows if i not in (104, 105)]))
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert all((r.whitened > 0) == (s.whitened > 0) for r in got for s in got if r.vec_id == 3 and s.vec_id is None and r.component == s.component)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_too_few_vectors(spark, rows):
    assert whiten(spark.createDataFrame([(i, c, None, "x", 3) for i, c in rows], SCHEMA)).collect() == []


def test_rank_and_range(spark):
    rows = [(k, [float(k % 4), 2.0 * (k % 4), 1.0]) for k in range(12)]
    got = whiten(spark.createDataFrame([(i, c, None, "x", 3) for i, c in rows], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and {r.n for r in got} == {4} and abs(got[0].explained - 1) < 1e-12
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        whiten(spark.createDataFrame([(1, [1e12, 0.0], None, "x", 3), (2, [-1e12, 1.0], None, "x", 3)], SCHEMA)).collect()


def test_query_is_the_definition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = op12_whitening(spark, "/root/testdata/sf0.001").collect()
    same(got, brute(rows))
    assert got[0].identity_error <= 1e-9 and len(got) == 16 * len([1 for _, c in rows if c and all(x is not None and math.isfinite(x) for x in c)])
