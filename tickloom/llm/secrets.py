"""Secret scanning with an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed: its blob is the SHA-256 of the
text. The ledger has one row for each (blob, rule, rule version) that has been
scanned, with the spans found, also when there were none. A run scans only the
blobs that lack a row for a current rule version, each blob once however many
paths or versions hold it, and joins the ledger back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents
from tickloom.session import materialise


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` is the smallest length of ``group`` that counts, others are dropped after matching."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
# What this scanner knows beyond them.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
#: Copies of each finding when joined back to paths, so that one blob that many paths hold is no single key.
SALTS = 8


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of the leftmost non-overlapping matches of a rule, in code points.

    Matches and the gaps between them alternate, so their lengths add up to the offsets.
    """
    p = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, p, F.lit(rule.group)).alias("part"),
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(F.regexp_like(text, p), found).otherwise(none)


def contents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the address of its content; a null text is the empty blob."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the blob and rule-version pairs of ``docs`` that ``ledger`` lacks.

    Each distinct blob is scanned once. Without a ledger every pair is unseen.
    """
    todo = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    blobs = contents(docs).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("todo", todo)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("done", F.expr("cast(array() as array<string>)"))))
        blobs = blobs.filter(F.size("todo") > 0)
    rows = [
        F.when(F.array_contains("todo", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    return blobs.select("blob", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("blob", "r.kind", "r.version", "r.spans")


def secrets_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and findings (array of start, rank of kind, kind, end; sorted) of every row of ``docs``, clean ones too."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.concat_ws("@", "kind", "version").isin(*[f"{r.kind}@{r.version}" for r in rules])
    found = (
        ledger.filter(current & (F.size("spans") > 0))
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("kind")].alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end"))).alias("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("findings"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    paths = contents(docs).select("doc_id", "blob").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    return paths.join(found, ["blob", "salt"], "left").select("doc_id", "blob", F.coalesce("findings", none).alias("findings"))


def described(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """Findings of every row with a ledger that starts empty."""
    return secrets_by_path(docs, materialise(scan_unseen(docs), "ledger"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a finding replaced by ``mark``; other columns and clean texts are as before.

    Overlapping spans are replaced together. Rows are matched to the ledger by content.
    """
    ledger = materialise(scan_unseen(docs.select("doc_id", "text")), "ledger")
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    dirty = (
        ledger.filter(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found_spans"))
        .withColumn("found_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .withColumnRenamed("blob", "found_blob")
    )

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate("found_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    joined = docs.withColumn("own_blob", blob).withColumn("own_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(dirty, (F.col("own_blob") == F.col("found_blob")) & (F.col("own_salt") == F.col("found_salt")), "left")
    return joined.withColumn("text", F.when(F.col("found_spans").isNull(), F.col("text")).otherwise(cleaned)).select(*docs.columns)


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, a digest of their spans, and all spans."""
    base = [r.kind for r in BASE_RULES]
    f = F.col("findings")
    count = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only = F.filter(f, lambda x: x["kind"].isin(*base))
    return scanned(documents(spark, sf_dir)).select("doc_id", *[count(k) for k in base], F.sha2(described(only).cast("binary"), 256).alias("base_sha256"), described(f).alias("spans"))


def _sql() -> str:
    """The same result from the rules alone: matches and the gaps between them add up to offsets."""
    parts = []
    for i, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.kind}' AS kind, {i} AS rank, {rule.least} AS least, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {rule.group}) AS g FROM x WHERE regexp_matches(t, '{p}')")
    base = [r.kind for r in BASE_RULES]
    line = "kind || ':' || a || ':' || (a + n)"
    return f"""
    WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}), o AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
    s AS (SELECT doc_id, kind, rank, (list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0))::BIGINT AS a, length(h[i]) AS n FROM o WHERE length(g[i]) >= least)
    SELECT x.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)}, sha256(coalesce(string_agg({line}, ',' ORDER BY a, rank) FILTER (rank < {len(base)}), '')) AS base_sha256,
    coalesce(string_agg({line}, ',' ORDER BY a, rank), '') AS spans FROM x LEFT JOIN s USING (doc_id) GROUP BY x.doc_id"""


OP8_SQL = _sql()
