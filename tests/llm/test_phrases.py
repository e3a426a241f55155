"""Phrase collocations against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(docs, least, top):
    out = []
    langs = {}
    for lang, text in docs:
        langs.setdefault(lang or "und" if lang is None else lang, []).append(text)
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            for words in pieces(text):
                n += len(words)
                f.update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            cuts = [(int(Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def made(seed, n, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "A", "a", "\x00", "x　y"]
    ends = [" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", "!?"]
    return [("de" if rng.random() < 0.7 else None, "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("least, top", [(30, 2000), (3, 2000), (4, 7)])
def test_collocations_equal_brute_force(spark, least, top):
    docs = made(least, 120) + [("fr", "Hot Phrase here " * 400)] * 3 + [("en", None), ("en", ""), ("", "a b " * 40), (None, "the end " * 5000)]
    rows = spark.createDataFrame([(i, t, lang, "c", 1, 2) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, code string, n int, suffix int").repartition(5)
    got = phrases.collocations(rows, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top)


def test_routes_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROUTE", 50)  # many routes, which cut through phrases
    docs = made(9, 200, 4)
    rows = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string").repartition(40)
    assert sorted(map(tuple, phrases.collocations(rows, 3, 500).collect())) == brute(docs, 3, 500)


def test_empty_tables(spark, empty_dir_of, odd_dir):
    assert phrases.op12_multikey_phrases(spark, empty_dir_of).collect() == []
    rows = phrases.op12_multikey_phrases(spark, odd_dir).collect()
    texts = [r.text for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("text").collect()]
    assert sorted(map(tuple, rows)) == brute([("en", t) for t in texts], 30, 2000) and rows[0].phrase == "word word word word"


@pytest.mark.parametrize("seed", range(6))
def test_quicksort_over_routes_counts_every_prefix(seed):
    rng = np.random.default_rng(seed)
    m, least = int(rng.integers(1, 30_000)), int(rng.integers(1, 60))
    words = rng.zipf(1.3, (m, 4)).astype(np.uint64) % np.uint64(50)
    words[:, :2] += np.uint64(1)
    words[words[:, 2] == 0, 3] = 0
    keys = np.column_stack([rng.integers(1, 3, m).astype(np.uint64), words])
    weights = rng.integers(1, 4, m)
    want = Counter()
    for row, w in zip(keys.tolist(), weights.tolist()):
        for d in (3, 4, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    want = {p: n for p, n in want.items() if n >= least}
    splitters = phrases.splitters_of(keys[rng.integers(0, m, 40)], int(rng.integers(1, 30)))
    route = phrases.route_of(keys, splitters)
    assert route.tolist() == [sum(tuple(s) <= tuple(k) for s in splitters.tolist()) for k in keys.tolist()]
    got = Counter()
    for r in np.unique(route):
        at = route == r
        for p, n in phrases.prefix_counts(keys[at], weights[at], splitters[max(0, r - 1) : r + 1], least):
            got[tuple(p.tolist())] += n
    assert {p: n for p, n in got.items() if n >= least} == want


def test_equal_suffixes_become_one():
    codes = np.array([1, 2, 3, 0, 1, 2, 3, 4, 5, 0, 7, 0, 1, 2, 3, 0], np.uint64)
    rows = phrases.suffixes_of(codes)
    assert rows.tolist() == [[1, 2, 3, 0], [2, 3, 0, 0], [1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 0], [4, 5, 0, 0], [1, 2, 3, 0], [2, 3, 0, 0]]
    found, n = phrases.weighted(rows)
    assert sorted(zip(found.tolist(), n.tolist())) == [([1, 2, 3, 0], 2), ([1, 2, 3, 4], 1), ([2, 3, 0, 0], 2), ([2, 3, 4, 5], 1), ([3, 4, 5, 0], 1), ([4, 5, 0, 0], 1)]


def test_codes_that_meet_are_seen(spark):
    rows = [("en", 1, b"a", 5, 1, None), ("en", 1, b"b", 6, 1, None), ("de", 2, b"a", 5, 1, None)]
    assert phrases.one_to_one(spark.createDataFrame(rows, phrases.WORDS))
    assert not phrases.one_to_one(spark.createDataFrame([*rows, ("de", 2, b"c", 6, 1, None)], phrases.WORDS))
    assert not phrases.one_to_one(spark.createDataFrame([*rows, ("fr", 2, b"a", 5, 1, None)], phrases.WORDS))
