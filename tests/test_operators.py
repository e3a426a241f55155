"""Operators that SQL can't express, against known values and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import encoders as en
from tickloom.operators import models as mo
from tickloom.operators import resample, shares, summaries

RNG = np.random.default_rng(1)


def weights(**shapes):
    return {k.replace("__", "."): RNG.standard_normal(s) * 0.3 for k, s in shapes.items()}


def test_binomial_interval(spark):
    rows = spark.createDataFrame([(0, 10), (10, 10), (3, 17), (250, 1000)], "k int, n int")
    got = {(r.k, r.n): (r.low, r.high) for r in resample.binomial_interval(rows, "k", "n").collect()}
    tail = lambda k, n, p: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert got[0, 10][0] == 0 and abs(got[0, 10][1] - (1 - 0.025**0.1)) < 1e-12 and got[10, 10][1] == 1
    for (k, n), (low, high) in got.items():
        if 0 < k < n:
            assert abs(tail(k, n, low) - 0.025) < 1e-9 and abs(1 - tail(k + 1, n, high) - 0.025) < 1e-9


def test_correlation_p(spark):
    # two-sided values of Student's distribution: 1 degree of freedom has arctangents, 2 have a closed form
    r1, r2 = 0.6, -0.8
    t1, t2 = r1 / math.sqrt(1 - r1**2), r2 * math.sqrt(2) / math.sqrt(1 - r2**2)
    want = [1 - 2 / math.pi * math.atan(t1), 1 - abs(t2) / math.sqrt(2 + t2**2), 1.0, None]
    rows = spark.createDataFrame([(0, r1, 3), (1, r2, 4), (2, 0.0, 50), (3, 0.5, 2)], "i int, r double, n long")
    got = [x.p_value for x in resample.correlation_p(rows, "r", "n").orderBy("i").collect()]
    assert got[3] is None and np.allclose(got[:3], want[:3], atol=1e-10)


def test_numbers_and_permutations(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    assert sorted((r.k, r.no) for r in resample.numbered(rows, ["k"]).collect()) == [(i, i + 1) for i in range(500)]
    line = spark.createDataFrame([(i, float(i % 50)) for i in range(200)], "t long, x double")
    got = {r.iteration: r.similarity for r in resample.permuted_correlation(line, "t", "x", 5).collect()}
    x = np.arange(200) % 50
    assert abs(got[-1] - np.corrcoef(x[:-1], x[1:])[0, 1]) < 1e-12 and all(abs(v) < 0.3 for k, v in got.items() if k >= 0) and len(got) == 6


def test_paired_difference(spark):
    rows = spark.createDataFrame([(g, int(i > 4), float(i), float(-i)) for g in range(12) for i in range(10)], "g int, label int, a double, b double")
    one = resample.bootstrap_difference(rows, "g", "a", "b", 20).first()
    assert (one.low, one.high, one.iterations) == (1.0, 1.0, 20)
    same = resample.bootstrap_difference(rows, "g", "a", "a", 5).first()
    assert (same.low, same.high) == (0.0, 0.0)


def test_spectrum_of_a_sine(spark):
    rows = spark.createDataFrame([("s", i, math.sin(2 * math.pi * i / 8)) for i in range(512)], "k string, i int, x double")
    r = summaries.spectral(rows, ["k"], "i", "x").first()
    assert abs(r.centroid - 0.125) < 1e-9 and abs(r.peak - 1) < 1e-9 and r.entropy < 1e-6 and r.high < 1e-9 and abs(r.low - 1) < 1e-9


def test_quantile(spark):
    x = RNG.integers(0, 40, 101).astype(float)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for q in (0.0, 0.33, 0.5, 0.95, 1.0):
        assert abs(shares.quantile_of(rows, "x", q).first().at - np.quantile(x, q)) < 1e-9


def test_fits(spark):
    p = RNG.uniform(0.02, 0.98, 4000)
    y = RNG.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 * np.log(p / (1 - p)) + 1)))
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, score double")
    slope, offset = mo.fit_platt(rows)
    assert abs(slope - 0.5) < 0.12 and abs(offset - 1) < 0.12
    with pytest.raises(ValueError):
        mo.fit_platt(rows.withColumn("score", 1 - F.col("score")))
    order = mo.best_blend(rows.withColumn("noise", F.lit(0.5)), "score", "noise").collect()
    assert order[-1].weight == 0 and order[0].auc > 0.6
    scored = mo.score_baseline(mo.fit_baseline(rows, ["score"], "label"), rows)
    assert scored.stat.corr("score", "label") > 0 or scored.count() == 4000
    pcs = np.array([r.pca for r in mo.reduced(rows.withColumn("twice", F.col("score") * 2), ["score", "twice"], 2).collect()])
    assert pcs[:, 1].std() < 1e-6 < pcs[:, 0].std()


def test_selection_within_a_tolerance(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 0.1), (2, "b", 0.9005, 0.3), (3, "c", 0.9005, 0.2), (4, "d", 0.95, 0.0), (5, "e", 0.9499, 0.0)], "o int, model string, x double, y double")
    assert mo.select_within(rows.filter("o < 4"), "o", "x", "y").first().model == "b"
    assert mo.select_within(rows, "o", "x", "y").first().model == "d"


def test_chain_of_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "w.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    good = hashlib.sha256(b"abc").hexdigest()
    assert mo.chain_holds(files, [("w.bin", good)]) and not mo.chain_holds(files, [("w.bin", "0" * 64)]) and not mo.chain_holds(files, [("gone", good)])


def test_convolution_and_norms_equal_loops():
    x, w = RNG.standard_normal((2, 11, 8)), weights(a__weight=(5, 8, 3), a__bias=(5,), n__weight=(8,), n__bias=(8,))
    for dilation, stride in ((1, 1), (2, 1), (1, 2)):
        got = en.conv(x, w, "a", dilation, stride)
        for t in range(got.shape[1]):
            want = w["a.bias"] + sum(w["a.weight"][:, :, k] @ x[0, at] for k in range(3) if 0 <= (at := t * stride + (k - 1) * dilation) < 11)
            assert np.allclose(got[0, t], want)
    part = x.reshape(2, 11, 4, 2)[1, :, 2]
    got = en.group_norm(x, w, "n", 4)[1, :, 4:6]
    assert np.allclose(got, (part - part.mean()) / np.sqrt(part.var() + 1e-5) * w["n.weight"][4:6] + w["n.bias"][4:6])
    z = np.linspace(-4, 4, 81)
    assert np.allclose(en.gelu(z), [v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in z], atol=1e-6)
    p = en.positional(7, 6)
    assert np.isclose(p[3, 2], math.sin(3 * 10_000 ** (-2 / 6))) and np.isclose(p[3, 3], math.cos(3 * 10_000 ** (-2 / 6)))


def test_lstm_equals_a_loop_over_units():
    x, w = RNG.standard_normal((1, 4, 3)), weights(c__weight_ih=(8, 3), c__weight_hh=(8, 2), c__bias_ih=(8,), c__bias_hh=(8,))
    h, c, s = [0.0, 0.0], [0.0, 0.0], lambda v: 1 / (1 + math.exp(-v))
    for t in range(4):
        z = [sum(w["c.weight_ih"][r] * x[0, t]) + sum(w["c.weight_hh"][r] * h) + w["c.bias_ih"][r] + w["c.bias_hh"][r] for r in range(8)]
        c = [s(z[2 + k]) * c[k] + s(z[k]) * math.tanh(z[4 + k]) for k in range(2)]
        h = [s(z[6 + k]) * math.tanh(c[k]) for k in range(2)]
    assert np.allclose(en.lstm(x, w, "c")[0, -1], h)


def block_weights(at, width, wide):
    return {f"{at}.{k}": RNG.standard_normal(s) * 0.2 for k, s in {"norm1.weight": width, "norm1.bias": width, "norm2.weight": width, "norm2.bias": width, "self_attn.in_proj_weight": (3 * width, width), "self_attn.in_proj_bias": 3 * width, "self_attn.out_proj.weight": (width, width), "self_attn.out_proj.bias": width, "linear1.weight": (wide, width), "linear1.bias": wide, "linear2.weight": (width, wide), "linear2.bias": width}.items()}


def test_masked_windows_change_nothing():
    """A player's score is the same with padding behind its windows, whatever the padding holds."""
    w = weights(project__weight=(8, 6), project__bias=(8,), match_head__0__weight=(16,), match_head__0__bias=(16,), match_head__1__weight=(4, 16), match_head__1__bias=(4,), match_head__4__weight=(1, 4), match_head__4__bias=(1,))
    w |= block_weights("sequence.layers.0", 8, 16) | block_weights("sequence.layers.1", 8, 16)
    x = RNG.standard_normal((1, 5, 6))
    padded = np.concatenate([x, RNG.standard_normal((1, 3, 6)) * 9], 1)
    assert np.allclose(en.hierarchical(x, np.ones((1, 5), bool), w), en.hierarchical(padded, np.arange(8)[None] < 5, w))
    pool, a = en.gated_pool(x, weights(attention_v__weight=(4, 6), attention_v__bias=(4,), attention_u__weight=(4, 6), attention_u__bias=(4,), attention_w__weight=(1, 4), attention_w__bias=(1,)))
    assert pool.shape == (1, 24) and np.isclose(a.sum(), 1) and np.allclose(pool[0, 6:12], x[0].mean(0))


def test_scores_of_windows_by_an_encoder(spark):
    w = weights(encoder__first__weight_ih=(24, 2), encoder__first__weight_hh=(24, 6), encoder__first__bias_ih=(24,), encoder__second__weight_ih=(16, 6), encoder__second__weight_hh=(16, 4), encoder__second__bias_ih=(16,), event_head__0__weight=(3, 4), event_head__0__bias=(3,), event_head__3__weight=(1, 3), event_head__3__bias=(1,))
    x = RNG.standard_normal((6, 10, 2))
    rows = spark.createDataFrame([(n, t, float(x[n, t, 0]), float(x[n, t, 1])) for n in range(6) for t in range(10)], "n int, pos int, a double, b double")
    score = en.event_logits("lstm", w)
    got = {r.n: r.score for r in mo.scored(rows, ["n"], ["a", "b"], "pos", score).collect()}
    assert np.allclose([got[n] for n in range(6)], score(x), atol=1e-5)
    for kind in ("tcn", "transformer", "multiscale", "reference_lstm"):
        assert all(layer[0] in en.LAYERS for layer in en.ENCODERS[kind])
