"""Best-fit packing planned on the length histogram.

Documents become pieces of at most `capacity` tokens. Their lengths are counted, and best-fit decreasing runs over the
counts: at most `capacity` lengths, whatever the number of documents. The plan is a list of runs "pieces of length L with
ranks r to r+n take places in sequences s, s+1, ..."; a piece then finds its place from its rank within its length.

Defined cases: a null text is empty and gives one piece, the end id alone; repeated rows are packed each; a null key
keeps its pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, byte_slices, materialize, partitions, releasing
from tracewell.llm.tokens import Encoder, encoder, vocabulary
from tracewell.session import table

END_ID = 1
#: Bytes of texts coded at once.
SLICE_BYTES = 1 << 20


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for batch in batches:
                for few in byte_slices(batch, "text", SLICE_BYTES):
                    yield cut_slice(enc, few)
        finally:
            enc.forget()  # more workers wait than work: an executor would hold a table for each

    def cut_slice(enc: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        out = []
        for k, ids in zip(keys, enc.encode(texts), strict=True):
            ids = np.append(ids, np.array([end_id], "<u4"))
            for p, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                out.append((k, p, start, len(part), zlib.crc32(part.tobytes())))
        columns = zip(*out, strict=True)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        releasing(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first_rank, pieces, first_sequence, per_sequence, offset).

    Pieces of one length with ranks first_rank .. first_rank + pieces - 1 fill sequences first_sequence, first_sequence
    + 1, ..., `per_sequence` to each, one after another from `offset`. Sequences that were filled alike are kept as one
    run, so work and plan depend on the number of lengths alone.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, how many)
    rooms: list[int] = []
    used, plan = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no open sequence has room: open as many as it takes
                per = capacity // length
                put(capacity, used, -(-left // per))
                used += -(-left // per)
                continue
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer than `per` are left: one sequence takes them
                plan.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                put(room, first + full, n - full)
    return plan


def place(pieces_: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces_ with sequence_id and offset.

    The rank of a piece within its length is its rank within a slice of the length plus the sizes of the slices before;
    slices split lengths that hold a large part of all rows.
    """
    spark = pieces_.sparkSession
    sliced = pieces_.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(4 * partitions(spark))).cast("int"))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "slices")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_best_fit(histogram, capacity)
    columns = np.array(plan, np.int64).reshape(-1, 6)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    shared = spark.sparkContext.broadcast(columns)
    inside = W.partitionBy("length", "slice").orderBy(*order)
    ranked = sliced.withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts.select("length", "slice", "base"), ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = [c for c in pieces_.columns]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        lengths, firsts = np.unique(runs[:, 0], return_index=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(rank), np.int64)
            for value in np.unique(length):  # few lengths in a batch: rows come sorted by length
                k = np.searchsorted(lengths, value)
                lo = firsts[k]
                hi = firsts[k + 1] if k + 1 < len(firsts) else len(runs)
                rows = length == value
                at[rows] = lo + np.searchsorted(runs[lo:hi, 1], rank[rows], side="right") - 1
            run = runs[at]
            nth = rank - run[:, 1]
            sequence = run[:, 3] + nth // run[:, 4]
            offset = run[:, 5] + (nth % run[:, 4]) * length
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(seat, schema)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset, gapless from 0."""
    return place(materialize(pieces(docs, path, capacity, end_id, key, text), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
