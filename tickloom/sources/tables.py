"""Tables: column statistics, several inputs as one, idempotent writes and text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_cohorts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several Parquet inputs under each other, with the cohort each row is from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p).withColumn("cohort", F.lit(c)) for c, p in paths.items()])


def null_counts(df: DataFrame) -> DataFrame:
    """column and nulls, in one aggregate that reads each column once."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "nulls")


def footer_null_counts(spark: SparkSession, path: str) -> DataFrame:
    """column and nulls from the footers of Parquet files alone, without their values; columns that some file has no statistics of are left out.

    The counts are pushed down to the scan in a session of its own, so the caller's settings stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)

    def nulls(columns: list[str]) -> list[tuple[str, int]]:
        """All columns in one scan of the footers, or, where statistics are missing, halves of them."""
        try:
            row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()  # one row
            return [(c, row["_rows"] - row[c]) for c in columns]
        except Exception as e:
            if "aggregatePushdown" not in str(e):  # the reader names the setting where a footer lacks what it needs
                raise
            half = len(columns) // 2
            return nulls(columns[:half]) + nulls(columns[half:]) if half else []

    return spark.createDataFrame(nulls(df.columns), "column string, nulls long")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, folder: str) -> None:
    """Files with a header; texts are quoted where they must be."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_facts(df: DataFrame, folder: str) -> None:
    """A few rows of facts beside a table, as JSON."""
    df.coalesce(1).write.mode("overwrite").json(folder)


def append_log(df: DataFrame, folder: str) -> None:
    """Rows under those that are there, as JSON lines."""
    df.write.mode("append").json(folder)


def write_new(df: DataFrame, key: str, folder: str) -> None:
    """Append the rows whose key the folder doesn't hold yet; running twice changes nothing."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        df = df.join(spark.read.parquet(folder).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(folder)


def report_lines(df: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """One formatted line per row (value), for a text sink; order by the caller."""
    return df.select(F.format_string(pattern, *[F.col(c) for c in columns]).alias("value"))
