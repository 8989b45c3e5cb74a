"""Helpers that the operators share: lineage cuts, Arrow batches and hashes."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side of a join that is broadcast at most (their lists hold INTS_AT_MOST numbers at most); larger ones are shuffled.
ROWS_AT_MOST, INTS_AT_MOST = 500_000, 4_000_000
#: Splits words at ASCII white space only, as every contract on words asks.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with short lineage.

    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediates: that set on the context or by spark.checkpoint.dir; a temporary one only for a local master, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def small(df: DataFrame, *ints: str) -> DataFrame:
    """df for a join: to be broadcast if its rows, and the numbers in its columns ints, are few. Its columns must be of fixed width but for ints."""
    size = df.agg(F.count("*"), F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in ints), F.lit(0)))).first()
    return F.broadcast(df) if size[0] <= ROWS_AT_MOST and (size[1] or 0) <= INTS_AT_MOST else df


def free(df: DataFrame, *names: str) -> str:
    """A prefix with which none of the names is a column of df, whatever its case."""
    taken, prefix = {c.lower() for c in df.columns}, "__"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return prefix


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows evenly over the cluster when files give fewer partitions than there are cores."""
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism) if df.rdd.getNumPartitions() < context.defaultParallelism else df


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with state for each task: make() runs once in a task, its result on every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its worker gives back what it has freed: it stays for other stages, beside their own workers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return whole


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the given columns: 52 bits of an MD5, so that other engines can recompute it."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
