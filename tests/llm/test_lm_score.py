from collections import Counter

import numpy as np

from tickloom.llm import lm_score as lm


CLASSES = lm.SIDE * lm.SIDE


def lay(*texts):
    """Texts given as lists of numbers, end to end."""
    return np.concatenate([np.array(t, np.int32) for t in texts]), np.cumsum([len(t) for t in texts])


def test_probabilities_sum_to_one():
    weights = lm.unpack(lm.first_weights())
    around = np.array([[1, 2, 3, lm.EDGE]] * CLASSES)
    assert abs(np.exp(lm.log_probabilities(weights, np.arange(CLASSES), around)).sum() - 1) < 1e-3


def test_gradient_equals_differences():
    """One step against the slope of the mean log-probability along each of some weights."""
    side = 4
    rng = np.random.default_rng(0)
    flat = lm.first_weights(side=side).astype(float)
    t, a = rng.integers(0, side * side, 64), rng.integers(-1, side * side, (64, 4))
    moved, squares = flat.copy(), [np.zeros_like(w) for w in lm.unpack(flat, side)]
    # the scale of each slope is in the squares: s = 0.02 g g
    lm.step(lm.unpack(moved, side), squares, t, a, 1e-3)
    slope = np.sqrt(np.concatenate([s.ravel() for s in squares]) / 0.02) * np.sign(moved - flat)
    loss = lambda w: lm.log_probabilities(lm.unpack(w, side), t, a).astype(float).mean()
    for k in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - slope[k]) < 2e-3 + 0.02 * abs(slope[k])


def test_places():
    around, owner, place = lm.places_of(*lay([5, 6], [], [7]))
    e = lm.EDGE
    assert owner.tolist() == [0, 0, 2] and place.tolist() == [0, 1, 0]
    assert around.tolist() == [[e, e, 6, e], [e, 5, e, e], [e, e, e, e]]


def test_trained_beats_unigram_and_scores_place_by_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm.fit_masked(docs, rounds=4)
    rows = {r.doc_id: r for r in lm.score_masked(docs, model).collect()}
    assert len(rows) == docs.count()
    numbers = lm.Numbers(model.frequent, model.side)
    number = lambda w: numbers[w] if numbers[w] >= 0 else -1 - numbers[w]
    texts = {d.doc_id: [number(w) for w in (d.text or "").lower().split()] for d in docs.collect()}
    every = np.concatenate([np.array(t, np.int64) for t in texts.values()])
    share = np.bincount(every, minlength=model.side**2) / len(every)
    assert sum(r.pll for r in rows.values()) > np.log(share[every]).sum()
    for i in (0, 1, 2):  # one text by itself, place by place
        ids = [lm.EDGE] * 2 + texts[i] + [lm.EDGE] * 2
        want = sum(lm.log_probabilities(lm.unpack(model.weights, model.side), np.array([ids[k]]), np.array([[ids[k - 2], ids[k - 1], ids[k + 1], ids[k + 2]]]))[0] for k in range(2, len(ids) - 2))
        assert abs(want - rows[i].pll) < 1e-2 * abs(want)


def test_odd_and_empty(spark, odd_dir, empty_dir_of):
    rows = lm.op4_masked_window(spark, odd_dir).collect()
    assert len(rows) == 11 and all(np.isfinite(r.pll) and (r.mean_pll is None) == (r.n_tokens == 0) for r in rows)
    assert lm.op4_masked_window(spark, empty_dir_of).collect() == []


def test_rounds_train_on_every_place_once():
    texts = [[7], [], *([(i * 7 + n) % 900 for i in range(n)] for n in (5, 31, 32, 33, 200, 511, 2000))]
    ids, ends = lay(*texts)
    around, owner, place = lm.places_of(ids, ends)
    times = sum(lm.trained(ids, ends, owner, place, number).astype(int) for number in range(lm.ROUNDS))
    assert times.tolist() == [1] * len(ids)
    assert 0.3 < lm.trained(ids, ends, owner, place, 0).mean() < 0.7


def test_every_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHIPPED", 50)  # most shares come by the join
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 200) % 5000) for _ in range(60)] + ["", "w1 w1 rare é"]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[-1])], "doc_id long, text string")
    counts = Counter(w for r in docs.collect() for w in r.text.lower().split())
    model, scored = lm.fit_and_score(docs)
    rows = scored.collect()
    numbers = lm.Numbers(model.frequent, model.side)
    number = lambda w: numbers[w] if numbers[w] >= 0 else -1 - numbers[w]
    totals = Counter()
    for w, n in counts.items():
        totals[number(w)] += n
    plain = {r.doc_id: r.pll for r in lm.score_masked(docs, model).collect()}
    assert len(rows) == len(texts) + 1 and len(counts) > len(model.frequent)
    for r in rows:
        own = sum(np.log(counts[w] / totals[number(w)]) for w in texts[-1 if r.doc_id is None else r.doc_id].split())
        assert abs(r.pll - plain[r.doc_id] - own) < 1e-6 * max(1, abs(own))
    # over all words, the probabilities at a place sum to 1, apart from classes that no word has
    words, around, weights = list(counts), np.array([[1, 2, 3, lm.EDGE]]), lm.unpack(model.weights, model.side)
    p = np.exp(lm.log_probabilities(weights, np.array([number(w) for w in words]), np.repeat(around, len(words), 0)))
    taken = np.exp(lm.log_probabilities(weights, np.array(sorted(totals)), np.repeat(around, len(totals), 0))).sum()
    assert abs((p * [counts[w] / totals[number(w)] for w in words]).sum() - taken) < 1e-3


def test_vocabulary_grows():
    assert lm.side_for(0) == lm.SIDE and lm.side_for(10**12) > 2 * lm.side_for(10**10) > 2 * lm.SIDE
    numbers = lm.Numbers([f"w{i}" for i in range(5000)], 80)
    assert numbers["w4999"] == 4999 and 5000 <= -1 - numbers["other"] < 80 * 80
