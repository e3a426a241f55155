"""The corpus pipeline: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``; further
columns go. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, near_dedup, packing, quality, secrets
from tickloom.llm.common import arrow_limits
from tickloom.session import materialise, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives less than 0.3 go; it learns from the labels of ``sf_dir``.

    A null or empty text has the score of a text without words and stays or goes by
    it; texts stay as they are, null ones too. Rows with a null or repeated id count
    each for itself. Without labels of both kinds every score is the share of the good.
    """
    arrow_limits(spark)
    return quality.keep_good(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts stays, the one with the smallest id.

    A null text equals an empty one, so one row of both stays, with its own text.
    Of rows with the same text and id one stays; a null id is the last choice.
    """
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return exact_dedup.exact_duplicates(docs.select(*COLUMNS), carry=rest).filter("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id.

    Null and empty texts are one class. Rows that share an id count as one document
    and stay or go together; rows with a null id stay.
    """
    return near_dedup.keep_first(docs.select(*COLUMNS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text, and n_chars follows; no document goes.

    A null text stays null with its n_chars, an empty one stays empty. Rows that
    repeat, with ids or without, are cleaned each for itself.
    """
    redacted = secrets.redact(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and place.

    A null or empty text is one piece that holds the end mark alone. Rows with null
    or repeated ids are packed each for itself.
    """
    return packing.pack_documents(docs)


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("secrets", clean), ("packing", packed)]

#: Models and packings are found by search; SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``; each stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
