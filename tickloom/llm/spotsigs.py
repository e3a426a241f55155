"""SpotSigs document fingerprints (DataFrame functions only).

A spot signature is the chain of up to three content words that follow a
common-word anchor, other common words left out. The set of a text's signatures
is its fingerprint. Sets are compared by Jaccard similarity; sets whose sizes
alone rule a threshold out are never compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.llm.common import documents

# Common words of four languages, the anchors.
ANCHORS = (
    "the of and to in a is that it for on was be with as are by this from at or an he i his they not have had were but which she you we all her there been one their has would what so if when who no will more can do "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de et un une du dans est pour que qui sur en par au plus pas ce il se ne sont avec son ont aux elle mais nous ou comme ses leur cette sa ces été être y "
    "el los las que del una por con para no su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde desde todo nos durante todos uno les ni contra otros ese eso"
).split()
CHAIN = 3
#: Most ranges of ids.
MOST_RANGES = 20_000


def signatures(text: Column) -> Column:
    """The sorted distinct 32-bit hashes of a text's spot signatures (array<int>, never empty).

    The start of the text is an anchor as well, and so is every content word for
    which code of first letter plus length is divisible by 6: texts without
    common words keep a fingerprint. A text without any word has the hash of the
    text itself. Null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")

    def mark(w: Column) -> Column:
        content = F.concat(w, F.lit("\u0002"))
        return F.when(w == "", "").when(w.isin(*sorted(set(ANCHORS))), "\u0001").when((F.ascii(w) + F.length(w)) % 6 == 0, F.concat(F.lit("\u0001"), content)).otherwise(content)

    marked = F.concat(F.lit("\u0001"), F.array_join(F.transform(words, mark), ""))
    word = "[^\u0001\u0002]+\u0002"
    chains = F.regexp_extract_all(marked, F.lit(f"\u0001(?=({word}(?:\u0001*{word}){{0,{CHAIN - 1}}}))"), F.lit(1))
    hashed = F.transform(chains, lambda c: F.hash(F.translate(c, "\u0001", "")))
    return F.array_sort(F.array_distinct(F.when(F.size(hashed) > 0, hashed).otherwise(F.array(F.hash(text)))))


def fingerprint(sigs: Column) -> Column:
    """The signature set as text: eight hexadecimal digits for each."""
    return F.array_join(F.transform(sigs, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets (0 to 1)."""
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def spotsigs_join(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (left_id < right_id, likeness) of ``sets`` (doc_id, sigs) with likeness of ``threshold`` or more.

    Equal sets meet once: pairs are between the smallest id of each set, and
    ``members`` of ``spotsigs_classes`` gives the rest. Sets are partitioned by
    the logarithm of their length; two similar sets lie in the same or in
    neighbouring partitions and share one of their few rarest signatures.
    """
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))
    step = math.log(1 / threshold)
    classes = classes.withColumn("n", F.size("sigs")).withColumn("part", F.floor(F.log("n") / step).cast("int"))
    flat = classes.select("doc_id", "n", "part", F.explode("sigs").alias("sig"))
    df = flat.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(df, "sig").withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("df", "sig")))
    prefix = ranked.filter((F.col("df") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)).select("doc_id", "n", "part", "sig")
    left = prefix.toDF("left_id", "left_n", "left_part", "sig").withColumn("part", F.explode(F.array(F.col("left_part"), F.col("left_part") + 1)))
    right = prefix.toDF("right_id", "right_n", "part", "sig")
    near = F.least("left_n", "right_n") >= threshold * F.greatest("left_n", "right_n")
    ordered = (F.col("left_part") < F.col("part")) | (F.col("left_id") < F.col("right_id"))
    pairs = left.join(right, ["sig", "part"]).filter(near & ordered & (F.col("left_id") != F.col("right_id"))).select("left_id", "right_id").distinct()
    side = lambda name: classes.select(F.col("doc_id").alias(f"{name}_id"), F.col("sigs").alias(f"{name}_sigs"))
    compared = pairs.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("likeness", likeness(F.col("left_sigs"), F.col("right_sigs")))
    return compared.filter(F.col("likeness") >= threshold).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "likeness").distinct()


def spotsigs_classes(sets: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest id with an equal signature set."""
    return sets.join(sets.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "sigs").select("doc_id", "class_id")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs`` (doc_id, ...) with next_<c> for each carried column: its value on the row that follows by doc_id.

    The first row follows the last one. Rows with a null id come last; rows with
    the same id follow each other in the order of their first carried column.
    Rows are dealt by ranges of ids with boundaries that are ids of the table, so
    a copy of each boundary row in the range before it is all that neighbours need.
    There are as many ranges as the table has splits, and at most MOST_RANGES.
    """
    parts = max(1, min(docs.rdd.getNumPartitions(), MOST_RANGES))
    quantiles = F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 10 * parts))
    found = docs.agg(quantiles.alias("q"), F.min("doc_id").alias("low")).first()
    bounds, low = sorted(set(found["q"] or [])), found["low"]
    last = F.lit(len(bounds))
    mine = F.col("doc_id")
    array = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    part = F.when(mine.isNull(), last).otherwise(F.size(F.filter(array, lambda b: b <= mine)))
    place = lambda p, ghost, wrap: F.struct(p.cast("int").alias("part"), F.lit(ghost).alias("ghost"), F.lit(wrap).alias("wrap"))
    places = F.array_compact(
        F.array(
            place(part, False, 0),
            F.when(mine.isin(*bounds) & (part > 0), place(part - 1, True, 0)) if bounds else F.lit(None),
            F.when(mine == F.lit(low), place(last, True, 1)),
        )
    )
    dealt = docs.withColumn("p", F.explode(places)).select(*docs.columns, "p.part", "p.ghost", "p.wrap")
    dealt = dealt.repartitionById(len(bounds) + 1, "part")  # a range for each task; a hash of so few numbers would pair some up
    w = W.partitionBy("part").orderBy("wrap", F.asc_nulls_last("doc_id"), carried[0])
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter(~F.col("ghost")).drop("part", "ghost", "wrap")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness and that to the next document."""
    docs = documents(spark, sf_dir).withColumn("sigs", signatures(F.col("text")))
    rows = with_next(docs, "text", "sigs").withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    next_text = F.coalesce("next_text", F.lit(""))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - cut), F.substring(next_text, F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        F.coalesce(likeness(F.col("sigs"), F.col("next_sigs")), F.lit(0.0)).alias("near_next"),
    )
