"""Recordings as rows of chunks, each with a halo, and kernels that never cross a gap.

A recording is a table of samples (recording, place, value). A chunk holds the samples that it owns and a halo of its
neighbours' at both ends, so a kernel whose reach is at most the halo gives each owned place what the whole recording
would; a place is owned by one chunk. A task holds a batch of chunks, however long a recording is.

A sample that is null or not finite is a gap, and so is a place without a sample: kernels get the runs between gaps. A run
that is shorter than a kernel needs is reported, not left out.

Defined cases: a recording without samples has no rows; repeated places of a recording are refused by the caller's order
(`places` numbers samples by time and key, so there are none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples that a chunk owns.
SIZE = 8192
MISSING, SHORT = "MISSING_SAMPLE", "SHORT_SUPPORT"


def bounded_batches(spark: SparkSession) -> None:
    """Chunks are long rows: bound the Arrow batches that Python workers get by bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def places(samples: DataFrame, recording: str, order: list[str], slice_: Column) -> DataFrame:
    """samples with `k`: the sample's place in its recording from 0, in the given order.

    slice_ must ascend with the order (a day of the time, say): samples are numbered within slices, to which the samples of
    earlier slices are added, so no window holds a recording.
    """
    cut = samples.withColumn("_slice", slice_)
    counts = cut.groupBy(recording, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(recording).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(recording, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(recording, "_slice").orderBy(*order)) - 1
    return cut.withColumn("_nth", inside).join(base, [recording, "_slice"]).withColumn("k", F.col("_base") + F.col("_nth")).drop("_slice", "_base", "_nth", "_n")


def chunked(samples: DataFrame, recording: str, place: str, value: str, halo: int, size: int = SIZE) -> DataFrame:
    """recording, chunk, ks, xs: the samples of each chunk and its halo, by place. A chunk that owns no sample has no row."""
    if halo < 0 or size < 1:
        raise ValueError("a chunk owns at least one sample, and a halo isn't negative")
    k = F.col(place).cast("long")
    to = F.explode(F.sequence(F.greatest(F.floor((k - halo) / size), F.lit(0)), F.floor((k + halo) / size)))
    dealt = samples.select(F.col(recording), k.alias("k"), F.col(value).cast("double").alias("x"), to.alias("chunk"))
    rows = dealt.groupBy(recording, "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"), F.max((F.floor(F.col("k") / size) == F.col("chunk")).cast("int")).alias("owns"))
    return rows.where("owns = 1").select(recording, "chunk", F.col("s.k").alias("ks"), F.col("s.x").alias("xs"))


class Run:
    """Samples without a gap: x from place `first`; the chunk owns places from low to high (excluded)."""

    def __init__(self, first: int, x: np.ndarray, low: int, high: int):
        self.first, self.x, self.low, self.high = first, x, low, high

    def owned(self) -> slice:
        """Which of x the chunk owns."""
        lo = min(max(self.low - self.first, 0), len(self.x))
        return slice(lo, max(lo, min(self.high - self.first, len(self.x))))


def runs_of(ks: np.ndarray, xs: np.ndarray, chunk: int, size: int) -> list[Run]:
    """The runs between gaps of a chunk and its halo, those that own nothing left out."""
    good = np.isfinite(xs)
    ks, xs = ks[good], xs[good]
    edges = np.flatnonzero(np.diff(ks) != 1) + 1
    made = [Run(int(k[0]), x, chunk * size, (chunk + 1) * size) for k, x in zip(np.split(ks, edges), np.split(xs, edges), strict=True) if len(k)]
    return [r for r in made if r.first < r.high and r.first + len(r.x) > r.low]


Kernel = Callable[[list[Run]], list[dict[str, np.ndarray]]]


def on_chunks(chunks: DataFrame, recording: str, kernel: Kernel, schema: str, least: int, size: int = SIZE, missing: bool = False) -> DataFrame:
    """recording, k, the kernel's columns, reason: what a kernel makes of the runs of chunks.

    The kernel gets the runs of a batch that are at least `least` samples long and returns for each its columns, with `k`,
    the place that owns a row (or `k2`, twice it, where it lies between two samples); rows that another chunk owns are left
    out here. A shorter run gives a row with SHORT_SUPPORT for each owned sample (`missing`: samples are rows) or for its
    first one; with `missing`, a missing sample gives a row with MISSING_SAMPLE, else the first one of a gap does. Kernels must reach no further than the halo,
    which must be at least `least`, and 1.
    """
    bounded_batches(chunks.sparkSession)
    kind = chunks.schema[recording].dataType.simpleString()
    full = f"`{recording}` {kind}, k long, {schema}, reason string"
    names = [f.strip().split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            if target is None:
                target = arrow_schema(batch.schema.field(recording).type, recording, schema)
            owners, runs, parts = batch.column(recording), [], []
            whose: list[int] = []
            for row in range(batch.num_rows):
                ks = batch.column("ks").slice(row, 1).flatten().to_numpy()
                xs = batch.column("xs").slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(float)
                chunk = batch.column("chunk")[row].as_py()
                bad = ~np.isfinite(xs)
                lost = ks[bad & (ks // size == chunk) & (missing | ~np.append(False, bad[:-1]))]
                parts.append((np.full(len(lost), row), lost, None, MISSING))
                for r in runs_of(ks, xs, chunk, size):
                    if len(r.x) >= least:
                        runs.append(r)
                        whose.append(row)
                    else:
                        own = r.owned()
                        k = np.arange(r.first + own.start, r.first + own.stop) if missing else np.array([r.first] if r.first >= r.low else [], np.int64)
                        parts.append((np.full(len(k), row), k, None, SHORT))
            for row, r, made in zip(whose, runs, kernel(runs) if runs else [], strict=True):
                at = made["k2"] if "k2" in made else 2 * made["k"]
                keep = (at >= 2 * r.low) & (at < 2 * r.high)
                parts.append((np.full(int(keep.sum()), row), at[keep] // 2, [_kept(made[n], keep) for n in names], None))
            if not parts:
                continue
            rows = np.concatenate([p[0] for p in parts])
            columns = [owners.take(pa.array(rows)), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64))]
            for c, name in enumerate(names):
                type_ = target.field(name).type
                columns.append(pa.concat_arrays([pa.nulls(len(p[0]), type_) if p[2] is None else pa.array(p[2][c], type_, from_pandas=True) for p in parts]))
            columns.append(pa.array(np.repeat(np.array([p[3] for p in parts], object), [len(p[0]) for p in parts]), pa.string()))
            yield pa.record_batch(columns, schema=target)

    return chunks.mapInArrow(run, full)


def _kept(column, keep: np.ndarray):
    return column[keep] if isinstance(column, np.ndarray) else [v for v, k in zip(column, keep, strict=True) if k]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def arrow_schema(kind: pa.DataType, recording: str, schema: str) -> pa.Schema:
    fields = [f.strip().split() for f in schema.split(", ")]
    return pa.schema([(recording, kind), ("k", pa.int64()), *((n, _TYPES[t]) for n, t in fields), ("reason", pa.string())])


def each_sample(columns: Callable[[list[np.ndarray]], list[list[np.ndarray]]], names: list[str]) -> Kernel:
    """A kernel with a value for each sample of a run: columns gets the runs' samples and returns for each its columns."""

    def kernel(runs: list[Run]) -> list[dict[str, np.ndarray]]:
        out = columns([r.x for r in runs])
        return [{"k": r.first + np.arange(len(r.x)), **dict(zip(names, cs, strict=True))} for r, cs in zip(runs, out, strict=True)]

    return kernel


def each_window(columns: Callable[[np.ndarray], list[np.ndarray]], names: list[str], width: int, hop: int, origin: str = "start") -> Kernel:
    """A kernel over windows of `width` samples, `hop` apart: columns gets [window, time] and returns a value (row) for each.

    Windows begin at places that are multiples of hop, so neighbouring chunks see the same ones; a window is owned by its
    centre, in half samples. Its column `first` is its first place.
    """

    def kernel(runs: list[Run]) -> list[dict[str, np.ndarray]]:
        out, firsts, every = [], [], []
        for r in runs:
            first = np.arange(-(-r.first // hop) * hop, r.first + len(r.x) - width + 1, hop)
            middle = 2 * first + width - 1
            first = first[(middle >= 2 * r.low) & (middle < 2 * r.high)]
            firsts.append(first)
            every.append(np.lib.stride_tricks.sliding_window_view(r.x, width)[first - r.first] if len(first) else np.zeros((0, width)))
        made = columns(np.concatenate(every))
        at = 0
        for first in firsts:
            out.append({"k2": 2 * first + width - 1, "first": first, **{n: c[at : at + len(first)] for n, c in zip(names, made, strict=True)}})
            at += len(first)
        return out

    return kernel
