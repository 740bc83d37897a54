"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ..functions.names import fresh  # noqa: F401
from ..operators.spread import spread  # noqa: F401
from ..plans.workspace import shared_dir

#: A written table of so many rows and so many bytes in its files, at most, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
BATCH_BYTES = "4m"
_roots: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _thrifty(spark: SparkSession) -> Iterator[None]:
    """For what is set up inside: Python workers that return large blocks of memory as soon as they are freed. Settings that are there stay, others go again."""
    env, added = spark.sparkContext.environment, []
    for key, value in (("MALLOC_MMAP_THRESHOLD_", "1048576"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        if key not in env:
            env[key] = value
            added.append(key)
    try:
        yield
    finally:
        for key in added:
            del env[key]


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow in thrifty workers."""
    with _thrifty(df.sparkSession):
        return df.mapInArrow(run, schema)


def map_groups(spark: SparkSession, grouped: GroupedData | PandasCogroupedOps, run: Callable, schema: str) -> DataFrame:
    """grouped.applyInPandas in thrifty workers."""
    with _thrifty(spark):
        return grouped.applyInPandas(run, schema)


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """For the jobs inside, rows go to Python in batches of 4 MB; a limit that the session has set itself stays. A row is never split."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    ours = spark.conf.get(key) == "67108864b"  # Spark's default
    if ours:
        spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(key)


@contextmanager
def _cleared(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; a choice that the session has made itself stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ours = spark.conf.get(key, None) is None
    if ours:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(key)


class Scratch:
    """Written tables of one run; what is no longer needed can go early, the rest goes at exit."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        _roots[self.root] = spark

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write, then read what was written."""
        path = f"{self.root}/{name}"
        with _batches(self.spark), _cleared(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few rows and bytes, both looked up first, is broadcast; a larger one is left to a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= rows else df


@atexit.register
def _clean() -> None:
    for root, spark in _roots.items():
        try:
            if spark._jsc.sc().isStopped():
                continue
            _delete(spark, root)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone already
            pass
