import zlib

import numpy as np
import pytest

from tickloom.llm import common, quality, toxicity


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = np.asarray(score)[order]
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    rank[order] = (first + last + 1) / 2
    pos = np.asarray(label) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out_auc(spark, query, label, least):
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    some = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    return auc([r.score for r in some], [labels[r.doc_id] for r in some])


def test_quality_on_held_out_rows(spark):
    assert held_out_auc(spark, quality.op10_random_indexing, "quality", 0.3) > 0.85


def test_toxicity_on_held_out_rows(spark):
    assert held_out_auc(spark, toxicity.op1_noisy_channel, "toxic", 0.5) > 0.8


def test_odd_and_empty_tables(spark, odd_dir, empty_dir_of):
    for query in (quality.op10_random_indexing, toxicity.op1_noisy_channel):
        rows = query(spark, odd_dir).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert query(spark, empty_dir_of).collect() == []


def test_restores_hidden_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    reading = toxicity.Restored(toxicity.CharModel(model.chars))
    for hidden, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("iiidiooot", "idiot"), ("l.o.s.e.r", "loser"), ("$tup1d", "stupid"), ("p-a-t-h-e-t-i-c", "pathetic"), ("cl0wn!!", "clown")):
        assert word in reading[hidden], (hidden, reading[hidden])
    assert "idiot" in toxicity.words_of("such an i d i o t here", reading)
    assert reading["Plain,"] == ("plain",)


def test_pooling_equals_plain_means():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((quality.WORDS, quality.DIM)).astype(np.float32)
    texts = ["", "a b c", "x " * 200_000, "", "one TWO 3", ""]
    slots = quality.Slots()
    got = quality.pooled(texts, vectors, slots)
    for t, row in zip(texts, got):
        ids = [slots[w] for w in quality.TOKEN.findall(t)]
        want = vectors[ids].mean(0, dtype=np.float64) if ids else np.zeros(quality.DIM)
        assert np.allclose(row, want, atol=1e-3)


def test_context_sums_in_levels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} x y w{i % 3}") for i in range(200)], "doc_id long, text string").repartition(8)
    want = quality.context_sums(docs)
    monkeypatch.setattr(common, "FAN", 2)
    assert np.allclose(want, quality.context_sums(docs))


@pytest.fixture(scope="module")
def reading(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return toxicity.Restored(toxicity.CharModel(toxicity.trigram_counts(docs)))


@pytest.mark.parametrize("hidden, word", [("iiddiioott", "idiot"), ("stuupid", "stupid"), ("i" + "d" * 60 + "iot", "idiot"), ("you_are_all_so_very_wrong_and_such_an_1d10t_too", "idiot")])
def test_doubled_letters_and_long_tokens(reading, hidden, word):
    assert word in reading[hidden], reading[hidden]


@pytest.mark.parametrize("text, word", [("an i d i o t.", "idiot"), ("i d i o t, he", "idiot"), ("(i d i o t)", "idiot"), ("i  d  i  o  t", "idiot"), ("i d\ni o t", "idiot"), ("a m o r o n", "moron"), ("y o u   i d i o t", "idiot"), ('"i - d - i - o - t!"', "idiot")])
def test_spaced_out_words(reading, text, word):
    assert word in toxicity.words_of(text, reading), toxicity.words_of(text, reading)


def test_long_spaced_runs_are_read_whole(reading):
    text = "t h e  " * 14 + "i d i o t"  # a cut after 40 letters would fall within a word
    assert "".join(text.split()) in toxicity.words_of(text, reading) and "idiot" in toxicity.words_of(text, reading)
    assert toxicity.words_of("x.y.z.com is a-b test", reading)[0] == "x.y.z.com"
    assert len(reading["ab1" * 100_000]) > 0


def test_lattice_equals_every_path():
    """The restored word is the best of all readings, scored one by one."""
    import itertools

    rng = np.random.default_rng(2)
    model = toxicity.CharModel(rng.integers(0, 50, toxicity.LETTERS**3))

    def readings(token):
        each = []
        for k, c in enumerate(token):
            letter = "a" <= c <= "z"
            options = [(c, 0.0)] if letter else [(x, toxicity.SIGN) for x in toxicity.LEET.get(c, "")]
            if not letter:
                options.append(("", toxicity.SEPARATOR if c not in toxicity.LEET else toxicity.DIGIT if c.isdigit() else toxicity.STRAY))
            elif k and token[k - 1] == c:
                options.append(("", toxicity.REPEAT))
            each.append(options)
        for path in itertools.product(*each):
            word = "".join(x for x, _ in path)
            codes = [0, 0, *(ord(x) - 96 for x in word), 0]
            yield sum(cost for _, cost in path) + sum(model.logp[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:])), word

    for token in ["a", "1", "b0b", "aab", "$$1t", "i_d1", "1|1|", "xx--xx", "h3ll0", "zz", "4_4"]:
        assert model.restore(token) == max(readings(token))[1], token


def test_long_tokens_are_read_whole(spark):
    codes = toxicity.letter_codes()[np.frombuffer(b"  stupid  abababstupid  qqqqstupid" * 50, np.uint8)]
    counts = np.bincount((codes[:-2] * 27 + codes[1:-1]) * 27 + codes[2:], minlength=27**3)
    restored = toxicity.Restored(toxicity.CharModel(counts))
    for token in ("q" * 200 + "$tup1d", "ab" * 100 + "$tup1d"):
        assert any(w.endswith("stupid") for w in restored[token])
    slots = quality.Slots()
    assert slots["a" * 200 + "x"] != slots["a" * 200 + "y"]


def test_context_sums_equal_loops(spark):
    texts = ["one two three two", "", None, "one", "two one, TWO 7 7 " + "long" * 60]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    place, sign = quality.index_vectors()
    want, slots = np.zeros((quality.WORDS, quality.DIM)), quality.Slots()
    for t in texts:
        rows = [slots[w] for w in quality.TOKEN.findall(t or "")]
        for i, r in enumerate(rows):
            for j in (i - 1, i + 1):
                if 0 <= j < len(rows):
                    for p, s in zip(place[rows[j]], sign[rows[j]]):
                        want[r, p] += s
    assert np.abs(quality.context_sums(quality.texts_of(docs)) - want).max() < 1e-6
