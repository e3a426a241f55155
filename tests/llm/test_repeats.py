import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tickloom.llm import repeats


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def digest(rows):
    return sorted((n, r, hashlib.sha256(k.encode()).hexdigest()) for n, r, k in rows)


def test_equals_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op3_suffix_trees(spark, "/root/testdata/sf0.01").collect())
    want = digest(brute(texts, 35))
    assert got == want and sum(w[1] for w in want) > 0


@pytest.mark.parametrize("often", [5000, 2])
def test_short_windows_and_long_prefixes(spark, monkeypatch, often):
    monkeypatch.setattr(repeats, "LONGER_PREFIX", often)
    monkeypatch.setattr(repeats, "GROUP", 7)
    rng = random.Random(3)
    passages = [[f"p{k}-{i}" for i in range(20)] for k in range(5)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 12))]
            a = rng.randint(0, 12)
            t += rng.choice(passages)[a : a + rng.randint(3, 20)]
        texts.append(" ".join(t))
    texts += ["a " * 100, "b c " * 30, texts[5], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.remove_repeats(docs, 10).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 10)


def test_words_that_clash_stay(spark):
    """Two texts that differ in one word, whose short hashes are equal, share no window."""
    words = np.array([f"word{i}" for i in range(300_000)])
    h = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)
    fold = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    order = np.argsort(fold, kind="stable")
    twin = np.flatnonzero(fold[order][1:] == fold[order][:-1])[0]
    one, two = words[order[twin]], words[order[twin + 1]]
    rest = [f"x{i}" for i in range(34)]
    texts = [" ".join([*rest[:20], w, *rest[20:]]) for w in (one, two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect()] == [(35, 0), (35, 0)]


@pytest.mark.parametrize("column", ["span", "whole"])
def test_buckets_compare_words(column):
    texts = [b"a b c d", b"a b c e", b"a b c d", b"ab c d d"]
    cells = {"span": [None] * 4, "whole": [None] * 4} | {column: texts}
    group = pa.table({"text_key": pa.array([b"1", b"2", b"3", b"4"]), "first": pa.array([0, 0, 5, 0], pa.int32()), "last": pa.nulls(4, pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in cells.items()}})
    assert sorted((r["text_key"], r["first"], r["last"]) for r in repeats.judged(group, 4).to_pylist()) == [(b"1", 0, 0), (b"3", 5, 5)]


def test_odd_rows(spark, odd_dir):
    texts = [r.text for r in spark.read.parquet(odd_dir + "/documents.parquet").collect()]
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op3_suffix_trees(spark, odd_dir).collect())
    assert got == digest(brute(texts, 35))


def test_empty(spark, empty_dir):
    assert repeats.op3_suffix_trees(spark, empty_dir).collect() == []
