"""Shared helpers: the shared scratch folder, written tables, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from karst.sources import scratch
from karst.sources.scratch import shared_dir

__all__ = ["bounded", "discard", "free_name", "partitions", "shared_dir", "sheltered", "table", "tidy", "tidy_groups", "without", "written"]


def written(df: DataFrame, name: str, free: bool = False, compression: str | None = None) -> DataFrame:
    """As ``scratch.written``.  free: then the driver's JVM collects its garbage, with which Spark drops the shuffle files of plans that are done.

    One collection frees what the plan holds, the next one the plan's shuffles.
    """
    out = scratch.written(df, name, compression)
    if free:
        for pause in (0.2, 0.1):
            gc.collect()
            df.sparkSession._jvm.System.gc()
            time.sleep(pause)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave and that nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives freed memory back when its partition ends, as workers are kept for later tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def tidy_groups(run: Callable) -> Callable:
    """The same for a function of one group's tables."""

    def tidied(*tables):
        out = run(*tables)
        _give_back()
        return out

    if len(inspect.signature(run).parameters) == 1:
        return lambda table: tidied(table)
    return lambda left, right: tidied(left, right)


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of a batch that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, after seeing to it that batches to Python workers are small: a worker holds some copies of one."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"[0-9]+", conf.get(key))
    if now is None or not 0 < int(now[0]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(columns: list[str], wish: str) -> str:
    """wish, with underscores until no column has that name (case is ignored, as Spark does)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def sheltered(df: DataFrame, names: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(df) with df's own columns: those named like what run adds are renamed meanwhile."""
    low = {n.lower() for n in names}
    clash = {c: free_name([*df.columns, *names], f"own_{c}") for c in df.columns if c.lower() in low}
    out = run(df.withColumnsRenamed(clash)).select(*[f"`{clash.get(c, c)}`" for c in df.columns])
    return out.withColumnsRenamed({v: k for k, v in clash.items()})


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that a result is about to add, so that extra input columns cannot clash."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
