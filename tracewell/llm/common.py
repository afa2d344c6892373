"""Helpers shared by the corpus operators: shared storage, range buckets, text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests, in local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tracewell-"))
        spark.sparkContext.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: long texts must not meet in one batch by the ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def release_memory() -> None:
    """Give back what earlier tasks of this Python worker have freed: workers are used again, also by other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back freed memory before and after: a worker that waits for its next task holds none of the last one's."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        yield from run(batches)
        release_memory()

    return released


def releasing_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group."""

    def released(group: pa.Table) -> pa.Table:
        release_memory()
        out = run(group)
        release_memory()
        return out

    return released


def releasing_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups of one key."""

    def released(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        out = run(left, right)
        release_memory()
        return out

    return released


#: Rows up to which a narrow table is broadcast; a shuffle joins more.
SMALL = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast where its rows are few; it should be cheap to count."""
    return F.broadcast(df) if df.count() <= SMALL else df


def byte_slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of a text column, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending upper bounds, each a value of the key, that cut df into about equal ranges; [] when there is no key.

    The list has at most `buckets` entries, whatever the size of df.
    """
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, probs or [0.5], 20 * buckets).alias("p"), F.max(key).alias("m")).first()
    return [] if row["m"] is None else sorted({*(row["p"] if probs else []), row["m"]})


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Index of the first bound that is not below key (binary search as an expression); 0 for a null key."""
    if not bounds:
        return F.lit(0)
    values = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps, n = [], 1
    while n <= len(bounds):
        steps.insert(0, n)
        n *= 2
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(values, at + step - 1) < key, at + step).otherwise(at),
    )
