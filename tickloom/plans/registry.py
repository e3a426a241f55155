"""Named queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Seconds since 1970, for SQL that mirrors ``events``.
EV = "ev AS (SELECT event_id, epoch_us(ts) // 1000000 AS tick, user_id, event_type, value, props FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``tick``, whole seconds since 1970, whatever the session's time zone."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return read_table(spark, sf_dir, "events").select("event_id", F.floor(us / 1000000).cast("long").alias("tick"), "user_id", "event_type", "value", "props")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def n(c: Column | str = "*") -> Column:
    return (F.count(F.lit(1)) if isinstance(c, str) and c == "*" else F.count(c)).cast("long")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, score (ties many) and source of labelled documents."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.least(F.col("n_chars"), F.lit(4000)) / F.lit(4000.0)).alias("raw"))
    return labels.join(docs, "doc_id").select("doc_id", "label", F.round("raw", 2).alias("score"), "lang", "source")


def draws(iterations: int) -> str:
    """SQL of the draws of sources that ``resample.cluster_draws`` makes with seed b: t (i, source, times), with -1 for every source once."""
    return f"""{SC}, g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS no, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM sc)), it AS (SELECT i FROM generate_series(0, {iterations - 1}) t(i)),
    t AS (SELECT i, source, count(*) AS times FROM (SELECT i, ('0x' || substr(md5('b/' || i || '/' || g.no), 1, 8))::BIGINT % k AS hit FROM g, it) d JOIN g ON g.no = d.hit GROUP BY 1, 2 UNION ALL SELECT -1, source, 1 FROM g)"""


SC = "sc AS (SELECT l.doc_id, l.quality AS label, round(least(d.n_chars, 4000) / 4000.0::DOUBLE, 2) AS score, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"
