import hashlib

from pyspark.sql import functions as F

from tickloom.llm.spotsigs import op2_spotsigs, signatures, spotsigs_join


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 4
        out.append(t[: len(t) - k] + texts[(i + 1) % len(texts)][:k])
    return out


def test_edited_text_and_likeness(spark):
    rows = sorted(op2_spotsigs(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    texts = [d.text or "" for d in docs]
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    sets = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    like = lambda a, b: len(a & b) / len(a | b)
    for i, (r, e) in enumerate(zip(rows, edited(texts))):
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - like(sets(r.fingerprint), sets(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - like(sets(r.fingerprint), sets(rows[(i + 1) % len(rows)].fingerprint))) < 1e-12
    by_text = {}
    for r, t in zip(rows, texts):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    mean = lambda k: sum(r[k] for r in rows) / len(rows)
    assert mean("near_edited") > 0.5 and mean("near_next") < 0.1


def test_odd_rows(spark, odd_dir):
    rows = op2_spotsigs(spark, odd_dir).collect()
    assert len(rows) == 11 and all(r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_empty(spark, empty_dir):
    assert op2_spotsigs(spark, empty_dir).collect() == []


def test_join_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", signatures(F.col("text")).alias("sigs"))
    docs = docs.union(docs.select(F.col("doc_id") + 10000, F.expr("slice(sigs, 1, cast(size(sigs) * 0.9 as int) + 1)")))
    sets = {}
    for r in docs.collect():
        sets[r.doc_id] = min(sets.get(r.doc_id, frozenset(r.sigs)), frozenset(r.sigs), key=len)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids = sorted(first.values())
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.left_id, r.right_id) for r in spotsigs_join(docs).collect()}
    assert got == want and want
