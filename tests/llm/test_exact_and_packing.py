import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, packing
from tickloom.llm.exact_dedup import exact_duplicates, op7_content_sort


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        known = [x for x in g if x is not None]
        out.append((i, max(known) if known else None, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_equals_brute_force(spark, odd_dir, empty_dir_of):
    for d, n in (("/root/testdata/sf0.01", 1000), (odd_dir, 11), (empty_dir_of, 0)):
        rows = op7_content_sort(spark, d).collect()
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        assert len(rows) == n
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute(docs)
        kept = Counter(r.text_sha256 for r in rows if r.kept)
        assert set(kept.values()) <= {1} and set(kept) == {r.text_sha256 for r in rows}
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_one_hot_group_over_many_partitions(spark, keep):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("text"), F.col("id").alias("more"))
    rows = exact_duplicates(docs.repartition(8), keep=keep, carry=("text", "more")).collect()
    assert len(rows) == 3000
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text, []).append(r.doc_id)
    pick = max if keep == "largest" else min
    kept = {r.text: r for r in rows if r.kept}
    assert {t: (r.doc_id, r.more, r.group_size) for t, r in kept.items()} == {t: (pick(g), pick(g), len(g)) for t, g in groups.items()}
    assert sum(r.kept for r in rows) == len(groups)


def test_normalised(spark):
    docs = spark.createDataFrame([(5, "A  b"), (3, "a B"), (9, "c")], "doc_id long, text string")
    rows = exact_duplicates(docs, lambda c: F.lower(F.regexp_replace(c, " +", " "))).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(5, 3, False), (3, 3, True), (9, 9, True)}


@pytest.fixture(scope="module")
def library():
    return bpe.library_tokenizer(bpe.vocabulary_path())


def test_encoder_equals_the_library(library):
    import random

    enc, rng = bpe.Encoder(bpe.vocabulary_path()), random.Random(2)
    parts = list("abézñß '’!#$\n\t   　 中文🎉12AK\x01\x1csltdrevm<|>") + ["<|endoftext|>", "  ", "'s", "'ll", " the", "!'s", "\x01's"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(5000))]
    for part in (texts[:10], texts[10:]):
        assert enc.encode(part) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        assert [enc.decode(x) for x in enc.encode(part)] == part
    plain = bpe.Encoder(bpe.vocabulary_path())
    plain.ranked, plain.library = None, library
    assert plain.encode(texts[:500]) == enc.encode(texts[:500])


def test_op5(spark, odd_dir, empty_dir_of, library):
    for d in ("/root/testdata/sf0.001", odd_dir, empty_dir_of):
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        want = []
        for i, t in docs:
            ids = library.encode(t or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.op5_forced_boundary_bpe(spark, d).collect()), key=str) == sorted(want, key=str)
    got = bpe.encode_documents(spark.createDataFrame([(1, "it's"), (2, None)], "doc_id long, text string"), decode=True).collect()
    assert [(r.ids, r.decoded) for r in got] == [(library.encode("it's").ids, "it's"), ([], "")]


def test_op9(spark, odd_dir, empty_dir_of, library):
    for d, most in (("/root/testdata/sf0.01", 1.01), (odd_dir, 1.5), (empty_dir_of, 1)):
        rows = packing.op9_island_packing(spark, d).collect()
        want = []
        for i, t in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
        used = Counter()
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == used[r.sequence_id]
            used[r.sequence_id] += r.length
        assert all(v <= 2048 for v in used.values())
        assert len(used) <= most * max(1, -(-sum(used.values()) // 2048))


def test_many_shards(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 41, 500).tolist()
    pieces = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "k long, length long").cache()
    rows = packing.pack(pieces, capacity=100, shard=60).collect()
    assert sorted((r.k, r.length) for r in rows) == list(enumerate(sizes))
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    # nine shards alone would leave up to nine bins half empty
    assert max(used.values()) <= 100 and len(used) <= -(-sum(sizes) // 100) + 1
    assert packing.pack(pieces.filter("k < 0")).collect() == []


def test_columns_with_any_names(spark):
    pieces = spark.createDataFrame([(700 + i, i, 3, "x") for i in range(5)], "shard long, _no int, length int, items string")
    rows = packing.pack(pieces, capacity=7, shard=2).collect()
    assert sorted((r.shard, r["_no"], r.length, r["items"]) for r in rows) == [(700 + i, i, 3, "x") for i in range(5)]
    assert len({r.sequence_id for r in rows}) == 3


def test_crossovers_beat_best_fit_decreasing():
    """Nearly full bins cut in three: best fit decreasing needs one more than there were, the search mostly doesn't."""
    rng, won = np.random.default_rng(5), 0
    for seed in range(6):
        sizes = []
        for total in 2048 - rng.integers(0, 41, 20):
            a, b = np.sort(rng.choice(np.arange(300, total - 300), 2, replace=False))
            sizes += [int(a), int(b - a), int(total - b)]
        home = packing.Island(sizes, 2048, seed)
        first = home.start(8)
        ranked = home.evolve(first, 800)
        assert sorted(i for b in ranked[0] for i in b) == list(range(len(sizes))) and max(home.fills(ranked[0])) <= 2048
        assert home.worth(ranked[0]) >= home.worth(first[0])
        won += len(ranked[0]) < len(first[0])
    assert won >= 3


def test_search_ends_when_nothing_is_left_to_win_or_all_stand_still(spark, monkeypatch):
    """No fixed number of crossovers: those of an island go on as long as one of so many in a row is better."""
    rng, sizes, tried = np.random.default_rng(7), [], []
    for total in 2048 - rng.integers(0, 41, 20):
        a, b = np.sort(rng.choice(np.arange(300, total - 300), 2, replace=False))
        sizes += [int(a), int(b - a), int(total - b)]
    cross = packing.Island.cross
    monkeypatch.setattr(packing.Island, "cross", lambda *a: tried.append(1) or cross(*a))
    home = packing.Island(sizes, 2048, 3)
    ranked = home.evolve(home.start(8), 60)
    assert len(tried) > 60 and sorted(i for b in ranked[0] for i in b) == list(range(60))
    again = len(tried)
    assert home.worth(home.evolve(ranked, 60)[0]) >= home.worth(ranked[0]) and len(tried) >= again + 60
    one = packing.Island([1024] * 9, 2048, 0)
    tried.clear()
    one.evolve(one.start(3), 60)
    assert not tried  # perfect from the start


def test_each_distinct_fragment_of_a_batch_is_looked_up_once(library, monkeypatch):
    """Work of the encoder follows the distinct fragments, not all; a full cache keeps those of the batch."""

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    enc = bpe.Encoder(bpe.vocabulary_path())
    enc.known = Counted()
    texts = ["", "the cat sat, on the mat. " * 50, "", "the cat sat. " * 50]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert Counted.asked < 50
    learnt, learn = [], bpe.Encoder.learn
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe.Encoder, "learn", lambda self, pieces: learnt.extend(pieces) or learn(self, pieces))
    assert enc.encode(texts) == want and not learnt
    assert enc.encode(["qqq xyzzy"]) == [np.array(library.encode("qqq xyzzy", add_special_tokens=False).ids, "<u4").tobytes()] and learnt
    assert enc.encode(texts) == want and enc.encode([]) == [] and enc.encode(["", ""]) == [b"", b""]


def test_genomes_carry_how_full_their_bins_are():
    """Crossovers don't add up all sizes of all bins again."""
    sizes = np.random.default_rng(3).integers(1, 1500, 300).tolist()
    home = packing.Island(sizes, 2048, 1)
    ranked = home.evolve(home.start(4), 40)
    for g in [*ranked, *home.evolve([packing.to_bins(packing.to_genes(g, 300)) for g in ranked], 5)]:
        assert sorted(i for b in g for i in b) == list(range(300))
        assert g.fill == [sum(sizes[i] for i in b) for b in g] and max(g.fill) <= 2048
    assert packing.to_genes([], 0).tolist() == []
