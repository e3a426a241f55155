"""Shared movement, ranges, folds, resampling of any statistic and permutation by counts, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import dedup, overlaps, ranges
from tickloom.operators import inspection as ins
from tickloom.operators import resample as rs
from tickloom.operators import splits as sp
from tickloom.plans import QUERIES


def walk(seed, ticks=192):
    x = np.zeros((ticks, 3))
    rng = np.random.default_rng(seed)
    x[:, :2] = rng.integers(-200, 200, (ticks, 2)) / 8
    x[:, 2] = rng.integers(0, 2, ticks)
    return x


def brute_links(rows, width=64):
    """Links between records that follow each other among those with an equal window."""
    held = {}
    for record, part, x in sorted(rows, key=lambda r: r[:2]):
        if x is None:
            continue
        moving = (np.abs(x[:, :2]) > 0.01).any(1)
        differs = np.r_[False, (x[1:, :2] != x[:-1, :2]).any(1)]
        for o in range(len(x) - width + 1):
            w = x[o : o + width]
            if moving[o : o + width].sum() >= 24 and differs[o : o + width].sum() >= 24 and len(np.unique(w[:, :2], axis=0)) >= 16:
                held.setdefault(tuple((w + 0.0).ravel()), []).append((record, part, o))
    out = set()
    for places in held.values():
        records = sorted({p[0] for p in places})
        out |= set(zip(records, records[1:]))
    return sorted(out)


def series_table(spark, rows, parts=6):
    return spark.createDataFrame([(r, p, None if x is None else x.tolist(), "c") for r, p, x in rows], "record long, part long, series array<array<double>>, h1 string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_shared_windows_equal_brute_force(spark, parts):
    shifted, still, sparse, few = walk(2), np.zeros((192, 3)), np.zeros((192, 3)), np.zeros((192, 3))
    shifted[30:110] = walk(1)[70:150]  # the same path at another offset
    sparse[50:73] = walk(9)[50:73]  # 23 active ticks
    few[:, 0] = np.arange(192) % 7 + 1  # moves all the time, but in 7 places only
    short, minus = walk(1)[:64], walk(4)
    minus[0:90] = walk(5)[0:90]
    minus[minus == 0] = -0.0
    rows = [(1, 0, walk(1)), (2, 0, walk(3)), (2, 1, shifted), (3, 0, still), (4, 0, still), (5, 0, sparse), (6, 0, sparse), (7, 0, few), (8, 0, few), (9, 0, short), (10, 0, walk(5)), (11, 3, minus), (12, 0, None), (13, 0, walk(1)[:20])]
    rows += [(100 + i, 0, walk(77)) for i in range(40)]  # many copies, over the edges of ranges
    rows += [(100, 5, walk(77))]
    got = sorted(tuple(r) for r in overlaps.shared_windows(series_table(spark, rows, parts)).collect())
    want = brute_links(rows)
    assert got == want and (1, 2) in want and (1, 9) in want and (10, 11) in want and len(want) == 42


def test_rolling_hashes_are_those_of_the_windows():
    t = overlaps.ticks_of(np.stack([walk(1), walk(2)]))
    for base in overlaps.BASES:
        h = overlaps.rolling(t, 64, base)
        assert h.shape == (2, 129)
        for s, o in ((0, 0), (0, 70), (1, 128)):
            want = 0
            for v in t[s, o : o + 64].tolist():
                want = (want * base + v) % 2**64
            assert int(h[s, o]) == want


def test_shared_series(spark):
    rest = np.zeros((192, 3))
    rest[:15, 0] = 1
    rows = [(5, 0, walk(1)), (3, 1, walk(1)), (9, 0, walk(1)), (4, 0, walk(2)), (6, 0, rest), (7, 0, rest), (9, 1, walk(1))]
    assert sorted(tuple(r) for r in overlaps.shared_series(series_table(spark, rows)).collect()) == [(3, 5), (3, 9)]
    assert overlaps.shared_series(series_table(spark, [])).collect() == [] and overlaps.shared_windows(series_table(spark, [])).collect() == []


def test_running_sums_and_quantiles_of_hot_keys(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 3000)] + [("hot", 1e9), (None, 4.0), (None, 8.0), ("one", -1.0), ("none", None)]
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v double, i int").repartition(9)
    got = {r["k"]: (r["n"], r["quantiles"]) for r in ranges.exact_quantiles(table, ["k"], "v", [0.0, 0.3, 0.5, 0.999, 1.0]).collect()}
    for k in ("hot", None, "one"):
        values = [v for x, v in rows if x == k]
        assert got[k][0] == len(values) and np.allclose(got[k][1], np.quantile(values, [0.0, 0.3, 0.5, 0.999, 1.0]))
    assert set(got) == {"hot", None, "one"}
    everything = ranges.exact_quantiles(table, [], "v", [0.5]).first()
    assert everything["quantiles"][0] == np.median([v for _, v in rows if v is not None])
    assert ranges.exact_quantiles(table.limit(0), ["k"], "v", [0.5]).collect() == []
    sums = {r["i"]: r["s"] for r in ranges.running_sums(table.filter("v is not null"), ["k"], [F.desc("v"), "i"], {"s": "v"}).collect()}
    for k in ("hot", None):
        upto = 0.0
        for v, i in sorted(((-v, i) for i, (x, v) in enumerate(rows) if x == k and v is not None)):
            upto -= v
            assert sums[i] == upto


def test_near_places(spark):
    rows = [("a", i, "held" if i in (3, 40) else "train" if i in (0, 8, 9) else "none") for i in range(60)] + [("b", 5, "held"), ("b", 6, "train")]
    table = spark.createDataFrame([(s, t, 100 * (s == "b") + t, x) for s, t, x in rows], "source string, t int, id int, split string")
    got = {r["id"]: (r["near"], r["distance"]) for r in ranges.near_places(table, ["source"], ["t"], "id", "split", "held", "train").collect()}
    assert got == {3: (2, 3), 40: (0, None), 105: (1, 1)}


@pytest.mark.parametrize("largest", [10_000, 20, 1])
def test_balanced_folds(spark, largest):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(1500):
        size = 400 if g == 0 else int(rng.integers(1, 8))
        kinds = ["x", "y"] if g % 3 else ["y", "z", None]
        rows += [(f"g{g}", kinds[int(rng.integers(0, len(kinds)))]) for _ in range(size)]
    table = spark.createDataFrame(rows + [(None, "x")], "g string, label string").repartition(5)
    folds = sp.balanced_folds(table, "g", "label", 10, largest=largest)
    found = folds.collect()
    assert len(found) == len({r["g"] for r in found}) == 1500 and {r["fold"] for r in found} == set(range(10))
    fold = {r["g"]: r["fold"] for r in found}
    for label in ("x", "y", "z", None):
        per = np.bincount([fold[g] for g, x in rows if x == label], minlength=10)
        others = np.delete(per, fold["g0"])  # the fold of the group with 400 rows may hold more of its labels
        assert np.abs(others / others.sum() - 1 / 9).max() < (0.01 if largest > 1 else 0.02), (label, per)
    assert sp.balanced_folds(table.limit(0), "g", "label").collect() == []


def test_bootstrap_of_any_statistic(spark):
    rows = spark.createDataFrame([(i % 40, float((i * 37) % 100), int(i % 3 == 0)) for i in range(800)], "person int, score double, label int")
    mean = rs.Sums({"s": F.col("score"), "n": F.lit(1)}, F.col("s") / F.col("n"))
    never = rs.Sums({"s": F.col("score"), "z": F.lit(0)}, F.try_divide("s", "z"))
    got = {r["statistic"]: r for r in rs.bootstrap(rows, "person", {"mean": mean, "auc": rs.RankAuc(), "never": never}, 60).collect()}
    one = rs.bootstrap_auc(rows, "person", 60).first()
    assert (got["auc"]["low"], got["auc"]["high"]) == (one["low"], one["high"])
    draws = {}
    for r in rs.cluster_draws(rows, "person", 60, "b").collect():
        draws.setdefault(r["iteration"], []).append((r["person"], r["times"]))
    data = rows.toPandas()
    sums, sizes = data.groupby("person")["score"].sum(), data.groupby("person").size()
    means = [sum(sums[p] * t for p, t in d) / sum(sizes[p] * t for p, t in d) for d in draws.values()]
    assert got["mean"]["low"] == pytest.approx(np.quantile(means, 0.025)) and got["mean"]["high"] == pytest.approx(np.quantile(means, 0.975))
    assert got["mean"]["estimate"] == pytest.approx(data["score"].mean()) and got["mean"]["iterations"] == 60
    assert got["never"]["iterations"] == 0 and got["never"]["low"] is None and got["never"]["estimate"] is None


def test_permutations_by_counts(spark):
    """Every deal keeps all flags, and the share of groups with two flags is that of permutations."""
    sizes = [5] * 100 + [1] * 200 + [40] * 5
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flags = np.zeros(len(owner), int)
    flags[:90] = 1
    table = spark.createDataFrame(list(zip(owner.tolist(), flags.tolist())), "g int, f int").repartition(6)
    found = rs.dealt_counts(table, "g", "f", 2000, ranges=16).toPandas()
    assert (found.assign(k=found["flags"] * found["n"]).groupby("iteration")["k"].sum() == 90).all() and (found.groupby("iteration")["n"].sum() == len(sizes)).all()
    got = rs.permutation_counts(table, "g", "f", 2000).toPandas().set_index("iteration")["clustered"]
    assert got[-1] == 18 and len(got) == 2001
    rng = np.random.default_rng(0)
    want = [(np.bincount(owner[rng.permutation(len(owner))[:90]], minlength=len(sizes)) >= 2).sum() for _ in range(2000)]
    assert abs(got[got.index >= 0].mean() - np.mean(want)) < 4 * np.std(want) / np.sqrt(2000) * 1.5 and abs(got[got.index >= 0].std() - np.std(want)) < 0.15 * np.std(want)
    again = rs.permutation_counts(table.repartition(2), "g", "f", 20).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rs.permutation_counts(table, "g", "f", 20).collect()))


def test_flags_of_many_rows_are_dealt_whole():
    out = rs.dealt_flags(np.random.default_rng(1), [4 * 10**9, 10**9, 5, 10**9], 10**9, 500)
    assert (out.sum(1) == 10**9).all() and abs(out[:, 0].mean() / (4e18 / (6 * 10**9 + 5)) - 1) < 1e-3 and out[:, 2].max() <= 5
    assert (rs.dealt_flags(np.random.default_rng(1), [3, 2], 5, 4) == [3, 2]).all()


def nearest_of(rows, asked):
    out = []
    for q, g, v in asked:
        far = [(float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, h, x in rows if v is not None and x is not None and h != g and h is not None and g is not None]
        if far:
            d, i = min(far)
            out.append((q, i, round(d, 9)))
    return sorted(out)


@pytest.mark.parametrize("block, slot", [(8192, 4096), (20, 7)])
def test_nearest_by_cells_equals_brute_force(spark, monkeypatch, block, slot):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(dedup, "QUERY_ROWS", slot)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 10, (12, 3))
    rows = [(i, int(i % 5), (centres[i % 12] + rng.normal(0, 0.3, 3)).tolist()) for i in range(600)]
    rows += [(1000 + i, i % 2, centres[0].tolist()) for i in range(200)]  # a hot cell of copies, with ties
    rows += [(2000, 3, None), (2001, None, [0.0, 0.0, 0.0]), (2002, 9, [500.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "i int, g int, v array<double>").repartition(6)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] == 2002]
    got = dedup.nearest_by_cells(table, "i", "g", "v", table.filter("i % 10 = 0 or i = 2002"), pivots=16).collect()
    assert sorted((r["query"], r["nearest"], round(r["distance"], 9)) for r in got) == nearest_of(rows, asked)
    share = sum(r["pairs"] for r in got) / (len(got) * len(rows))
    assert share < 0.35  # of all pairs, in data that lies in clusters
    assert dedup.nearest_other(table.limit(0), "i", "g", "v", table).collect() == []
    only = table.filter("g = 1")
    assert dedup.nearest_other(only, "i", "g", "v", only).collect() == []


def test_an_event_two_hours_later_opens_a_session(spark, tmp_path):
    import datetime as dt

    at = lambda seconds: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
    rows = [(1, at(0), 7, "view", 1.0, ""), (2, at(7199), 7, "view", 1.0, ""), (3, at(14399), 7, "view", 1.0, ""), (4, at(0), 8, "view", 1.0, ""), (5, at(7201), 8, "view", 1.0, "")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["session_bursts"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.last - r.first, r.hits) for r in found) == [(7, 0, 1), (7, 7199, 2), (8, 0, 1), (8, 0, 1)]


def test_large_sides_are_never_broadcast(spark, tmp_path):
    """The states of captures are laid out tick by tick, which the planner doesn't see; shifts multiply no rows before a join."""
    for name, what in (("capture_verdicts", "alive"), ("shift_choice", "yaw")):
        seen = []
        real = ins.band_join
        ins.band_join = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
        try:
            QUERIES[name](spark, "/root/testdata/sf0.001")
        finally:
            ins.band_join = real
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in seen]
        assert plans and not any("-3" in p and "sequence" in p and "shift" in p for p in plans)
        if name == "capture_verdicts":
            assert sum("SortMergeJoin" in p for p in plans) >= 2


def test_text_series_are_the_characters(spark, tmp_path):
    from tickloom.plans import audits

    texts = {1: "ab c" * 100, 2: None, 3: "", 4: "\U0001f600\u00e9 x", 5: "q" * 192, 6: "r" * 193, 7: "long " * 50000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.record, r.part): r.series for r in audits.text_series(spark, str(tmp_path)).collect()}
    want = {(k, p): [[float(ord(c) - 32), 0.0, float(c == " ")] for c in t[p * 192 : p * 192 + 192]] for k, t in texts.items() if t for p in range(-(-len(t) // 192))}
    assert found == want


def test_whole_series_are_told_apart_by_their_bits(spark):
    minus = walk(1)
    minus[minus == 0] = -0.0
    rows = [(1, 0, walk(1)), (2, 0, minus), (3, 0, walk(1)[:100]), (4, 0, walk(1) + 1e-12)]
    assert sorted(tuple(r) for r in overlaps.shared_series(series_table(spark, rows)).collect()) == [(1, 2)]


def test_only_runs_and_windows_of_differing_runs_are_shuffled(spark, monkeypatch):
    """Series of many lengths, copies, shifted parts and a NaN: links as by brute force, from far fewer rows than there are windows."""
    laid, made = [], overlaps.window_hashes
    monkeypatch.setattr(overlaps, "window_hashes", lambda *a: laid.append(made(*a)) or laid[-1])
    rng = np.random.default_rng(8)
    rows = [(i, 0, walk(i, int(rng.integers(40, 193)))) for i in range(300)]
    copies = [(1000 + i, 0, x) for i, _, x in rows[:60]]
    windows = sum(max(0, len(x) - 63) for _, _, x in rows + copies)
    assert sorted(map(tuple, overlaps.shared_windows(series_table(spark, rows + copies)).collect())) == brute_links(rows + copies)
    gates = overlaps.Gates()
    assert laid[-1].count() == 0 and overlaps.runs_of(series_table(spark, rows + copies), gates, None).count() < windows / 8
    odd = walk(400)
    odd[90, 2] = np.nan
    mixed = rows + copies + [(2000 + i, 1, np.concatenate([walk(900 + i, 30 + i), x[20:110], walk(950 + i, 50)])) for i, _, x in rows[30:90]]
    mixed += [(1, 1, odd), (2, 1, odd), (3, 1, odd[60:])]  # 3 shares what comes after the NaN
    assert sorted(map(tuple, overlaps.shared_windows(series_table(spark, mixed)).collect())) == brute_links(mixed)
    assert 0 < laid[-1].count() < windows / 2


def test_distinct_ticks_and_least_of():
    x = np.random.default_rng(1).integers(0, 30, (5, 150)).astype(np.uint64)
    assert overlaps.distinct_ticks(x, 64).tolist() == [[len(set(r[o : o + 64])) for o in range(87)] for r in x.tolist()]
    for width in (1, 2, 33, 64):
        assert overlaps.least_of(x, width).tolist() == [[min(r[o : o + width]) for o in range(151 - width)] for r in x.tolist()]
