"""Whitening and exact top-k search against brute force."""

import numpy as np
import pytest

from tickloom.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, block int, n int, ids string"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors, parts=4):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 7, 7, "x") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def vectors_of(n, d, seed=0, ids=None):
    x = np.random.default_rng(seed).normal(0, 0.2, (n, d)).astype(np.float32)
    return list(zip(range(n) if ids is None else ids, x.tolist()))


ODD = [(901, None), (902, [NAN] * 6), (903, [INF] + [0.0] * 5), (904, [None] * 6), (905, [0.1, -INF, 0, 0, 0, 0])]


def test_whitening_equals_eigh(spark):
    base = vectors_of(300, 6, 3)
    vectors = base + [(5, base[5][1]), (None, [0.5] * 6), (None, [0.5] * 6)] + ODD
    rows = whitening.whitened(table(spark, vectors), components=4).collect()
    y = np.floor(np.array([v for _, v in vectors[:303]], np.float32).astype(float) * 64).astype(int)
    n = len(y)
    scaled = n * y - y.sum(0)
    x = scaled / n
    values, basis = np.linalg.eigh(x.T @ x / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(rows) == n * 4 and {r.n for r in rows} == {n}
    want = x @ basis[:, :4] / np.sqrt(values[:4])
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    sign = {c: np.sign(want[0, c - 1] * got[0][c][0].whitened) for c in range(1, 5)}
    for i in range(300):
        for c in range(1, 5):
            assert len(got[i][c]) == (2 if i == 5 else 1)
            assert got[i][c][0].whitened * sign[c] == pytest.approx(want[i, c - 1], abs=1e-10)
            assert got[i][c][0].deviation == int((scaled[i].astype(object) ** 2).sum())
    assert len(got[None][1]) == 2
    trace = np.trace(x.T @ x / n)
    assert all(r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10) and r.identity_error < 1e-10 for r in rows)


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, ODD)).collect() == []
    assert whitening.whitened(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []  # no variance
    line = whitening.whitened(table(spark, [(i, [i, 2 * i, 0, 0]) for i in range(50)])).collect()  # one direction only
    assert {r.component for r in line} == {1} and len(line) == 50 and line[0].explained == pytest.approx(1.0)
    with pytest.raises(Exception, match="several lengths"):
        whitening.whitened(table(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 80), np.r_[np.ones(60), 1.001 + np.arange(20) / 1e3], np.r_[np.zeros(70), np.arange(1, 11.0)], np.geomspace(1e-9, 1e4, 80), np.r_[np.ones(79), 1e6]])
def test_filtered_iteration_certifies(spectrum):
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((80, 80)))[0]
    matrix = basis * spectrum @ basis.T
    found = whitening.chebyshev_subspace(lambda q: matrix @ q, 80, 10)
    want = np.sort(spectrum)[::-1][:10]
    assert found.residual <= whitening.STALLED and np.abs(found.values - want).max() <= 1e-11 * want[0]
    assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() <= 1e-10 * want[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(10)).max() < 1e-12


def test_partial_tables_add_up_in_a_tree(spark):
    rows = spark.range(100, numPartitions=7).selectExpr("id AS part", "array(cast(id as double), 1.0D) AS total")
    assert whitening.added(rows, 100).tolist() == [4950.0, 100.0]


def test_deviations_beyond_64_bits_are_null():
    centre = whitening.Centre(3 * 10**9, np.array([0]), 100)
    assert centre.deviations(np.array([[1], [2]])).to_pylist() == [9 * 10**18, None]


def brute(vectors, every, k):
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            found = sorted(((-int(q @ v), j is None, j) for b, (j, v) in enumerate(ok) if a != b and len(v) == len(q)), key=lambda t: (t[0], t[1], t[2] or 0))[:k]
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [2, 64, 10_000])
def test_top_inner_products_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "INDEX_ROWS", (rows, rows))
    monkeypatch.setattr(topk, "QUERY_ROWS", (max(1, rows // 8), rows))
    n = 60 if rows == 2 else 400
    vectors = vectors_of(n, 6, 4) + ODD
    vectors += [(7, vectors[7][1])] * 8 + [(10, vectors[10][1]), (None, vectors[10][1]), (None, vectors[20][1])]  # repeats, ties, no id
    vectors += [(1000 + i, [0.01 * i, 3.0]) for i in range(5)] + [(2000, []), (2001, [])] + [(3000, [1e4, -2e4, 0.0])]  # other lengths, large numbers
    got = topk.top_inner_products(table(spark, vectors), every=10, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(vectors, 10, 5)


def test_top_inner_products_of_empty_tables(spark):
    assert topk.top_inner_products(table(spark, [])).collect() == []
    assert topk.top_inner_products(table(spark, [(50, [1.0, 2.0])])).collect() == []
    assert topk.top_inner_products(table(spark, ODD)).collect() == []


def test_sums_of_slices_are_sums():
    rng = np.random.default_rng(2)
    y, w = rng.integers(0, 100, (130, 9)), rng.integers(0, 50, 9)
    slices, dropped = topk.sliced(y - 0)
    sums = topk.sum_slices(slices, w)
    got = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << b) for b, s in enumerate(sums))
    want = ((y - y.min(0)) >> dropped) @ w
    assert (got == want).all()
    rows = topk.bitmaps(np.ones(130, np.uint8))
    for k in (1, 5, 130):
        least = topk.kth_largest(sums, rows, k)
        assert least == np.sort(want)[-k]
        assert topk.rows_of(topk.at_least(sums, rows, least), 130).tolist() == np.flatnonzero(want >= least).tolist()
