from collections import Counter

import corpus_pipeline
from tickloom.llm.secrets import RULES, scan_unseen
from tickloom.session import materialise


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), name))
    return out


def test_stages(spark):
    docs, good, exact, near, clean, packed = stages(spark, "/root/testdata/sf0.01")
    for d in (good, exact, near, clean):
        assert set(d.columns) == set(docs.columns)
    before = good.collect()
    best = {}
    for r in before:
        best[r.text] = min(best.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(best.values())
    assert docs.count() > len(before) > 0.8 * docs.count()
    assert near.count() < exact.count() and near.join(exact, docs.columns, "left_anti").count() == 0
    assert clean.count() == near.count()
    assert scan_unseen(clean).filter("size(spans) > 0 and kind in ('access', 'hex', 'assign')").count() == 0
    assert scan_unseen(near).filter("size(spans) > 0").count() > 0 and len(RULES) >= 3
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in clean.collect()}
    used = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_odd_rows(spark, odd_dir, empty_dir_of):
    assert len(corpus_pipeline.run(spark, odd_dir).collect()) > 0
    assert corpus_pipeline.run(spark, empty_dir_of).collect() == []
