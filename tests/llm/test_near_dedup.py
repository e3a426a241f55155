from collections import Counter

import numpy as np

from tickloom.llm import near_dedup as nd


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def like(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def brute(docs):
    """Classes by comparing every pair that shares a shingle."""
    bags = {i: bag(t or "") for i, t in docs}
    by = {}
    for i, b in bags.items():
        for s in b or [()]:
            by.setdefault(s, []).append(i)
    root = {i: i for i in bags}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for group in by.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if like(bags[a], bags[b]) >= 0.8:
                        x, y = sorted((top(a), top(b)))
                        root[y] = x
    return {i: top(i) for i in bags}


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in nd.op6_bag_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_chain_and_family(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    base = [words[i] for i in rng.integers(0, 5000, 300)]
    docs = [(0, " ".join(base))]
    for k in range(1, 60):  # copies of one text, each changed at two places of its own
        t = list(base)
        for p in rng.integers(0, 300, 2):
            t[p] = f"x{k}"
        docs.append((k, " ".join(t)))
    chain = list(base[::-1])
    for k in range(100, 130):  # each differs a little from the one before, the ends are unlike
        chain = [*chain[12:], *[f"c{k}-{j}" for j in range(12)]]
        docs.append((k, " ".join(chain)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(frame).collect()}
    assert got == brute(docs)


def test_signature_is_unbiased():
    hashes = nd.WordHashes()
    a = " ".join(f"a{i}" for i in range(400)) + " z" * 300
    b = " ".join(f"a{i}" for i in range(100, 500)) + " z" * 200
    x, y = nd.shingle_bag(a, hashes), nd.shingle_bag(b, hashes)
    want = like(bag(a), bag(b))
    assert abs(nd.overlap(x, y) - want) < 1e-12
    s = [nd.signatures([(e + np.uint64(k), w) for e, w in (x, y)]) for k in range(40)]
    assert abs(np.mean([(p[0] == p[1]).mean() for p in s]) - want) < 0.02
    alone = nd.signatures([x])[0]
    assert (nd.signatures([y, x, x])[1] == alone).all()


def test_odd_rows(spark, odd_dir):
    got = [(r.doc_id, r.class_id) for r in nd.op6_bag_minhash(spark, odd_dir).collect()]
    assert len(got) == 11
    by = dict(got)
    assert by[4] == by[1] == 1 and by[2] == by[3] == 2 and by[5] == 5 and by[None] is None


def test_empty(spark, empty_dir):
    assert nd.op6_bag_minhash(spark, empty_dir).collect() == []


def test_keep_first(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words", "z"), (4, None, "n")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in nd.keep_first(docs).collect()) == [1, 3, 4]


def test_family_with_heavy_edits(spark):
    """Copies of one text from lightly to heavily changed: links among the outer ones don't run through the centre."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    docs = []
    for k in range(160):
        t = list(base)
        for p in rng.integers(0, 150, int(rng.integers(0, 14))):
            t[p] = f"x{k}-{p}"
        docs.append((k, " ".join(t)))
        if k % 4 == 0:  # and a near copy of the copy itself
            u = list(t)
            u[int(rng.integers(0, 150))] = "yy"
            docs.append((1000 + k, " ".join(u)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert len(set(want.values())) > 5
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(frame).collect()} == want


def test_prefix_join_keeps_pairs_at_the_threshold(spark):
    """28 of 35 shingles shared, one text being the other cut short: similarity exactly 0.8."""
    words = [f"w{i}" for i in range(39)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:32]))], "node long, text string")
    nodes = spark.createDataFrame([(1, 1, False, 35, 0, 0, 0), (2, 2, True, 28, 0, 0, 0)], "node long, component long, minor boolean, weight long, s0 long, s1 long, s2 long")
    assert [tuple(r) for r in nd.prefix_pairs(nodes, texts, 0.8).collect()] == [(1, 2)]
