"""Session and storage helpers shared by every subpackage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of our own where it is unset and all run on this machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/tickloom-{uuid.uuid4().hex}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def methods_that_compile(spark: SparkSession) -> None:
    """Let plans of very many columns run outside whole-stage code where its methods pass the size that the JVM compiles (8,000 bytes), unless the session says otherwise.

    The JVM interprets larger methods for good, which took more than half the time of such plans.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":  # Spark's own value
        spark.conf.set(name, "8000")


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` stores inside go when it ends; what is read from them has to be written or collected by then."""
    held: list[str] = []
    token = _owned.set(held)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in held:
            delete(spark, path)


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage and fixes every value (a lost executor re-reads files
    instead of recomputing non-repeatable partitionings).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _owned.get()) is not None:
        held.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, as --py-files would, unless PYTHONPATH already has it."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp()
    sc.addPyFile(shutil.make_archive(f"{folder}/tickloom", "zip", root, "tickloom"))
    _shipped.add(sc.applicationId)
