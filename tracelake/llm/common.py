"""Reading tables, cutting lineage and sizing shuffles, shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a new folder of this machine serves in local mode; on a cluster that would lose
    data, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return base.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracelake-")


#: With it Spark removes what was shuffled for a write as soon as the write has ended. Nothing reads it again: the table is there.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors. Those that are not dropped before go when the driver ends."""

    #: Folders that exist: path to session.
    made: ClassVar[dict[str, SparkSession]] = {}

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tracelake-{uuid.uuid4().hex}", 0
        Scratch.made[self.root] = spark

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        conf, before = self.spark.conf, self.spark.conf.get(FREE, "false")
        conf.set(FREE, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(FREE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            _delete(self.spark, df._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary():
    """Deletes the tables of all Scratch folders made inside. What is returned from inside must have been saved elsewhere."""
    before = set(Scratch.made)
    yield
    for root in set(Scratch.made) - before:
        _delete(Scratch.made.pop(root), root)


@atexit.register
def _delete_all() -> None:
    for root, spark in Scratch.made.items():
        with contextlib.suppress(Exception):  # the session may have ended, and with it the way to its files
            _delete(spark, root)


def partitions(df: DataFrame, bytes_each: int = 8 << 20, least: int = 24) -> int:
    """Partitions for a shuffle that carries about as much as df's files hold."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Plans without file statistics answer with an astronomically large default.
    return max(least, min(size, 1 << 46) // bytes_each) if size < 1 << 60 else 4 * least


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
