"""Phrase collocations by a distributed multikey quicksort of suffixes.

A suffix is the run of up to LONGEST words from a place on, within its piece. Words
stand as 64-bit codes (checked to be one to one). Suffixes that begin with two
frequent words are cut before the next infrequent word, equal ones within a task
become one with a weight, and sampled splitters route them by their leading words,
so a leading word or pair that very many suffixes share is spread over as many
routes as it fills. Each route sorts pointers to its suffixes by a multikey
three-way quicksort down to the maximum depth: the weight of an equal-partition is
the count of its phrase, and partitions below the least count are abandoned.
Phrases on which a splitter falls are counted on either side and added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_limits, column
from tickloom.session import materialise, read_table

#: Longest phrase in words, least count of a phrase, phrases returned of each lang.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A score is SCALE * a / (l + r); a phrase goes where a longer one has this percentage of its count.
SCALE, COVERED = 2_000_000, 80
#: Words that a task holds before it hands on what it has, and distinct words that it remembers.
FLUSH, REMEMBERED = 1_000_000, 500_000
#: Suffixes that a route is meant to get, sampled suffixes for each route, and most routes.
ROUTE, SAMPLES, MOST_ROUTES = 1_000_000, 32, 1 << 16
#: Sampled suffixes that come to the driver, about.
MOST_SAMPLES = 200_000
#: Bits of the filter for frequent words: a fixed size, whatever the vocabulary.
FILTER_BITS = 1 << 26
#: Parts in which the phrases of a lang are ranked first.
SALTS = 64

# Bytes that end a piece become one that no UTF-8 text holds; tabs are spaces.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
FOLD = bytes.maketrans(BREAKS + b"\t", BREAK * len(BREAKS) + b" ")
END = 0

WORDS = "lang string, lang_code long, word binary, code long, n long, suffix array<long>"
ROUTED = "route int, lang_code long, suffixes binary, weights binary"
COUNTED = "lang_code long, codes array<long>, f long"


def code_of(data: bytes, seed: int) -> int:
    """A 64-bit code, never END."""
    return xxhash.xxh3_64_intdigest(data, seed) or 1


class Codes(dict):
    """Word to code; BREAK is END."""

    def __init__(self, seed: int):
        super().__init__({BREAK: END})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        found = self[word] = code_of(word, self.seed)
        return found


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words in order, BREAK between pieces."""
    return text.lower().translate(FOLD).replace(BREAK, b" \xff ").split()


def signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def buffered(batches: Iterator[pa.RecordBatch], seed: int, flush: int = FLUSH) -> Iterator[tuple[str, np.ndarray, Codes]]:
    """lang, codes of consecutive words (END between pieces and documents) and the words known so far, about ``flush`` words at a time."""
    codes, held, total = Codes(seed), {}, 0
    for batch in batches:
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text")):
            words = split_words(text.as_py())
            held.setdefault(lang, []).extend([np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), np.zeros(1, np.uint64)])
            total += len(words)
            if total >= flush or len(codes) >= REMEMBERED:
                yield from ((k, np.concatenate(held[k]), codes) for k in sorted(held))
                held, total = {}, 0
                codes = codes if len(codes) < REMEMBERED else Codes(seed)
    yield from ((k, np.concatenate(held[k]), codes) for k in sorted(held))


def mixed(codes: np.ndarray) -> np.ndarray:
    """One number for each row of codes; unequal rows may share it."""
    h = np.zeros(len(codes), np.uint64)
    for c in codes.T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def suffixes_of(codes: np.ndarray) -> np.ndarray:
    """The LONGEST codes from every place that two words follow on, END from the end of the piece on."""
    wide = np.concatenate([codes, np.zeros(LONGEST, np.uint64)])
    at = np.flatnonzero((wide[:-1] != END) & (wide[1:] != END))
    out = np.zeros((len(at), LONGEST), np.uint64)
    live = np.ones(len(at), bool)
    for d in range(LONGEST):
        live &= wide[at + d] != END
        out[live, d] = wide[at[live] + d]
    return out


def weighted(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes once, with how often they came (as far as they lie together in the order of ``mixed``)."""
    order = np.argsort(h := mixed(suffixes), kind="stable")
    rows, h = suffixes[order], h[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(1)
    starts = np.flatnonzero(fresh)
    return rows[starts], np.diff(np.append(starts, len(rows)))


def sampled(suffixes: np.ndarray, words: int) -> np.ndarray:
    """SAMPLES for each ROUTE of words, at equal distances."""
    wanted = max(1, SAMPLES * words // ROUTE)
    return suffixes[:: max(1, len(suffixes) // wanted)][:wanted]


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """WORDS: the count of every word of every lang, with its code, and sampled suffixes (word null)."""
    names = [c.split()[0] for c in WORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, known in buffered(batches, seed):
            words = {c: w for w, c in known.items()}
            found, n = np.unique(codes[codes != END], return_counts=True)
            some = sampled(suffixes_of(codes), len(codes))
            pad = np.zeros(len(some), np.int64)
            texts = [words[c] for c in found.tolist()] + [None] * len(some)
            values = [pa.array([lang] * len(texts), pa.string()), pa.array(np.full(len(texts), lang_code(lang, seed))), pa.array(texts, pa.binary()), pa.array(np.concatenate([signed(found), pad])), pa.array(np.concatenate([n, pad])), pa.array([None] * len(found) + list(signed(some)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(values, names)

    return materialise(docs.mapInArrow(run, WORDS).groupBy(*[c for c in names if c != "n"]).agg(F.sum("n").alias("n")), "words")


def lang_code(lang: str, seed: int) -> int:
    return int(signed(np.array([code_of(lang.encode("utf-8", "surrogatepass"), seed)], np.uint64))[0])


def one_to_one(words: DataFrame) -> bool:
    """No two words have one code, and no two langs."""
    of = lambda code, name: words.groupBy(code).agg(F.min(name).alias("a"), F.max(name).alias("b")).filter("a <> b").select(F.lit(1))
    return of("code", "word").union(of("lang_code", "lang")).isEmpty()


def frequent_bits(frequent: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS in which every frequent word of a lang is set, and few others."""
    bit = F.col("code").bitwiseXOR(F.col("lang_code")).bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = frequent.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((code ^ lang_code) & {63} as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in rows.collect():  # FILTER_BITS / 64 rows at most
        out[at] = bits
    return out.view(np.uint64)


def kept_words(codes: np.ndarray, lang: int, bits: np.ndarray) -> np.ndarray:
    """``codes`` with END in place of words that are surely infrequent."""
    at = (codes ^ np.array([lang]).view(np.uint64)) & np.uint64(FILTER_BITS - 1)
    return np.where(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1, codes, np.uint64(END))


def splitters_of(samples: np.ndarray, routes: int) -> np.ndarray:
    """At most ``routes`` - 1 sorted rows that cut the samples into parts of one size."""
    rows = samples[np.lexsort(samples.T[::-1])]
    return np.unique(rows[np.arange(1, routes) * len(rows) // routes], axis=0) if len(rows) else rows


def route_of(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters are not above each row, by binary search."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(splitters), np.int64)
    for _ in range(len(splitters).bit_length()):
        open_, mid = low < high, np.minimum((low + high) // 2, max(len(splitters) - 1, 0))
        s = splitters[mid]
        below = keys[:, -1] < s[:, -1]
        for c in range(keys.shape[1] - 2, -1, -1):
            below = (keys[:, c] < s[:, c]) | ((keys[:, c] == s[:, c]) & below)
        high, low = np.where(open_ & below, mid, high), np.where(open_ & ~below, mid + 1, low)
    return low


def with_lang(lang: int, suffixes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.full(len(suffixes), lang, np.int64).view(np.uint64), suffixes])


@dataclass
class Routing:
    """What every task needs to cut and route suffixes; its size is bounded."""

    seed: int
    bits: np.ndarray
    splitters: np.ndarray


def routed(docs: DataFrame, routing: Routing) -> DataFrame:
    """ROUTED: suffixes of frequent words, a row for each flush, lang and route."""
    shared = docs.sparkSession.sparkContext.broadcast(routing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for lang, codes, _ in buffered(batches, r.seed):
            code = lang_code(lang, r.seed)
            rows, weights = weighted(suffixes_of(kept_words(codes, code, r.bits)))
            route = route_of(with_lang(code, rows), r.splitters)
            order = np.argsort(route, kind="stable")
            cuts = np.flatnonzero(np.diff(route[order], prepend=-1))
            parts = [order[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(order)))]
            if parts:
                values = [pa.array(route[order[cuts]].astype(np.int32)), pa.array(np.full(len(parts), code)), pa.array([rows[p].tobytes() for p in parts], pa.binary()), pa.array([weights[p].astype(np.int64).tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in ROUTED.split(", ")])

    return docs.mapInArrow(run, ROUTED)


#: Partitions of so many pointers or fewer are sorted at once.
SMALL = 4096


def multikey_sort(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth (columns), a row and the weight of every prefix of at least ``least``, by multikey three-way quicksort of pointers.

    A partition holds pointers to rows that agree in the columns before its depth.
    It splits by a pivot in the column at its depth; the part that equals the pivot
    goes on one column deeper. Parts below ``least``, and prefixes that END closes, end there.
    """
    depths, rows, totals = [], [], []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        pointers, depth = stack.pop()
        column_ = keys[pointers, depth]
        if len(pointers) <= SMALL:
            order = np.argsort(column_, kind="stable")
            pointers, column_ = pointers[order], column_[order]
            starts = np.flatnonzero(np.diff(column_, prepend=column_[0] ^ np.uint64(1)))
            total = np.add.reduceat(weights[pointers], starts)
            ends = np.append(starts[1:], len(pointers))
            same = [(pointers[starts[i] : ends[i]], int(total[i])) for i in np.flatnonzero((total >= least) & (column_[starts] != END)).tolist()]
        else:
            pivot = np.sort(column_[:: max(1, len(column_) // 9)])[4]
            below, above = column_ < pivot, column_ > pivot
            stack += [(p, depth) for p in (pointers[below], pointers[above]) if len(p) and weights[p].sum() >= least]
            equal = pointers[~(below | above)]
            same = [(equal, int(weights[equal].sum()))] if pivot != END else []
        for equal, total in same:
            if total >= least:
                depths.append(depth + 1)
                rows.append(equal[0])
                totals.append(total)
                if depth + 1 < keys.shape[1]:
                    stack.append((equal, depth + 1))
    return np.array(depths, np.int64), np.array(rows, np.int64), np.array(totals, np.int64)


def prefix_counts(keys: np.ndarray, weights: np.ndarray, edges: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """The lang and words of each phrase of a route, with its count; phrases that a splitter (a row of ``edges``) begins with come with what they have here."""
    cut = {e[: d + 1].tobytes() for e in edges for d in range(2, LONGEST) if (e[1 : d + 1] != END).all()}
    for e in cut:
        prefix = np.frombuffer(e, np.uint64)
        here = int(weights[(keys[:, : len(prefix)] == prefix).all(1)].sum())
        if here:
            yield prefix, here
    for depth, row, total in zip(*multikey_sort(keys, weights, least)):
        if depth > 2 and keys[row, :depth].tobytes() not in cut:
            yield keys[row, :depth], int(total)


def phrase_counts(docs: DataFrame, routing: Routing, least: int) -> DataFrame:
    """COUNTED: the phrases of 2 to LONGEST words that occur ``least`` times or more in a lang."""
    shared = docs.sparkSession.sparkContext.broadcast(routing.splitters)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        splitters, route = shared.value, key[0].as_py()
        rows = [np.frombuffer(b, np.uint64).reshape(-1, LONGEST) for b in group["suffixes"].to_pylist()]
        keys = np.concatenate([with_lang(c, r) for c, r in zip(group["lang_code"].to_pylist(), rows)])
        weights = np.concatenate([np.frombuffer(b, np.int64) for b in group["weights"].to_pylist()])
        found = list(prefix_counts(keys, weights, splitters[max(0, route - 1) : route + 1], least))
        codes = [signed(np.ascontiguousarray(p)) for p, _ in found]
        return pa.table([pa.array([int(c[0]) for c in codes], pa.int64()), pa.array([c[1:] for c in codes], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], ["lang_code", "codes", "f"])

    found = routed(docs, routing).groupBy("route").applyInArrow(run, COUNTED)
    return materialise(found.groupBy("lang_code", "codes").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")


def scored(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang_code, codes, a, and score, l and r of the lowest-scoring cut of every phrase."""
    counts = phrases.union(frequent.select("lang_code", F.array("code"), "n"))
    of = lambda part, name: counts.select("lang_code", F.col("codes").alias(part), F.col("f").alias(name))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("codes") - 1))).select("lang_code", "codes", F.col("f").alias("a"), "k", F.slice("codes", 1, F.col("k")).alias("first"), F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("rest"))
    both = cuts.join(of("first", "l"), ["lang_code", "first"]).join(of("rest", "r"), ["lang_code", "rest"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    best = both.groupBy("lang_code", "codes", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang_code", "codes", "a", "best.score", "best.l", "best.r")


def uncovered(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """``rows`` without phrases that lie inside a longer one with COVERED percent of their count or more."""
    longer = phrases.filter(F.size("codes") > 2)
    parts = F.expr("flatten(transform(sequence(2, size(codes) - 1), m -> transform(sequence(1, size(codes) - m + 1), i -> slice(codes, i, m))))")
    most = longer.select("lang_code", F.explode(parts).alias("codes"), "f").groupBy("lang_code", "codes").agg(F.max("f").alias("longer"))
    return rows.join(most, ["lang_code", "codes"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(COVERED) * F.col("a"))).drop("longer")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each lang; SALTS parts of a lang are ranked first, so that no task sees all of one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = rows.withColumn("_rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def texts_for(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with ``phrase``, the words that the codes stand for."""
    each = rows.select("lang_code", "codes", F.posexplode("codes").alias("pos", "code")).join(frequent.select("lang_code", "code", "word"), ["lang_code", "code"])
    texts = each.groupBy("lang_code", "codes").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("words"))
    return rows.join(texts, ["lang_code", "codes"]).withColumn("phrase", F.concat_ws(" ", F.col("words.word"))).drop("words")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each lang of ``docs`` (lang, text).

    A null lang is ``und`` (and one with it), a null or empty text has no words. Rows
    that repeat count as often as they come. A lang without a phrase of ``least``
    occurrences gives no rows, nor does an empty table.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    for seed in range(16):
        counted = word_counts(docs, seed)
        words = counted.filter("word is not null")
        if one_to_one(words):
            break
    else:
        raise RuntimeError("no seed gives every word a code of its own")
    frequent = words.filter(F.col("n") >= least)
    bits = frequent_bits(frequent)
    samples = counted.filter("word is null").select("lang_code", "suffix")
    some = samples.filter(F.pmod(F.xxhash64("suffix"), F.lit(max(1, samples.count() // MOST_SAMPLES))) == 0).collect()
    cut = [with_lang(r.lang_code, suffixes_of(kept_words(np.array(r.suffix, np.int64).view(np.uint64), r.lang_code, bits))[:1]) for r in some]
    total = frequent.agg(F.sum("n")).first()[0] or 0
    splitters = splitters_of(np.concatenate(cut) if cut else np.zeros((0, LONGEST + 1), np.uint64), min(MOST_ROUTES, max(1, -(-total // ROUTE))))
    phrases = phrase_counts(docs, Routing(seed, bits, splitters), least)
    langs = words.groupBy("lang", "lang_code").agg(F.sum("n").alias("n"))
    rows = texts_for(uncovered(scored(phrases, frequent), phrases), frequent).join(langs, "lang_code")
    return ranked(rows, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_multikey_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every lang of ``documents``.

    A null lang is ``und``, a null or empty text has no words, rows that repeat each
    count, ids and further columns are not read, and an empty table gives no rows.
    """
    return collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) t(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
k AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:m], ' ') AS rest FROM c, range(1, 4) t(k) WHERE k < m),
s AS (SELECT k.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = first AND x.m = k JOIN f y ON y.lang = k.lang AND y.phrase = rest AND y.m = k.m - k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT lang, part, max(a) AS longer FROM
      (SELECT lang, a, unnest(list_transform(range(1, m - q + 2), lambda i: array_to_string(ws[i:i + q - 1], ' '))) AS part FROM c, range(2, 4) t(q) WHERE q < m) GROUP BY lang, part)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN z ON z.lang = b.lang AND z.part = b.phrase JOIN n ON n.lang = b.lang
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
