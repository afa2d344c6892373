"""Event ledgers as gzip JSON lines, tables as gzip CSV, and arrays as raw float32 frames or NumPy archives.

A ledger is dealt into partitions. A partition's file begins with a header line that holds the number of its events and a
digest of their canonical lines; a reader recomputes both. Executors write and read every file; the digest is a sum of
hashes, so it doesn't depend on the order of lines, and no partition passes through the driver.

Defined cases: null values stay null (left out of a line); an empty table gives an empty folder, read as no rows.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.sources import files

HEADER = "type string, events long, digest string"


def line_digest(line: Column) -> Column:
    """Sum of the lines' hashes, as text."""
    return F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38, 0)")).cast("string")


def write_ledger(rows: DataFrame, folder: str, partition: Column) -> None:
    lines = rows.select(partition.cast("int").alias("part"), F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
    heads = lines.groupBy("part").agg(F.count("*").alias("events"), line_digest(F.col("value")).alias("digest"))
    heads = heads.select("part", F.to_json(F.struct(F.lit("header").alias("type"), "events", "digest")).alias("value"), F.lit(0).alias("place"))
    every = heads.unionByName(lines.withColumn("place", F.lit(1))).repartition("part").sortWithinPartitions("part", "place", "value")
    every.select("part", "value").write.option("compression", "gzip").partitionBy("part").text(folder)


def read_ledger(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(typed events with `part`; audit: part, declared, found, status)."""
    lines = spark.read.schema("value string, part int").text(folder)
    is_head = F.get_json_object("value", "$.type").eqNullSafe("header") & F.get_json_object("value", "$.digest").isNotNull()
    heads = lines.where(is_head).select("part", F.from_json("value", HEADER).alias("h")).select("part", F.col("h.events").alias("declared"), F.col("h.digest").alias("digest"))
    events = lines.where(~is_head)
    found = events.groupBy("part").agg(F.count("*").alias("found"), line_digest(F.col("value")).alias("own"))
    status = F.when(F.col("declared").isNull(), "NO_HEADER").when(F.coalesce("found", F.lit(0)) != F.col("declared"), "COUNT_MISMATCH")
    status = status.when(~F.col("own").eqNullSafe(F.col("digest")), "CONTENT_MISMATCH").otherwise("OK")
    audit = heads.join(found, "part", "full").select("part", "declared", F.coalesce("found", F.lit(0).cast("long")).alias("found"), status.alias("status"))
    return events.select("part", F.from_json("value", schema).alias("e")).select("part", "e.*"), audit


#: A record is a line, so line ends inside a text are written as a backslash and a letter, and so is a backslash.
ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))
CSV = {"header": True, "nullValue": "\\N", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, folder: str) -> None:
    """Gzip CSV, a record a line; `read_csv` gives back any text, null and empty ones too."""
    for name, kind in rows.dtypes:
        if kind == "string":
            for plain, written in ESCAPES:
                rows = rows.withColumn(name, F.replace(F.col(f"`{name}`"), F.lit(plain), F.lit(written)))
    rows.write.options(**CSV).option("compression", "gzip").csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    rows = spark.read.schema(schema).options(**CSV).csv(folder)
    for name, kind in rows.dtypes:
        if kind == "string":
            for plain, written in reversed(ESCAPES):  # the backslash last: no other escape holds its letter
                rows = rows.withColumn(name, F.replace(F.col(f"`{name}`"), F.lit(written), F.lit(plain)))
    return rows


def write_arrays(arrays: DataFrame, folder: str, kind: str, key: str = "key", values: str = "values") -> DataFrame:
    """A file for each row: raw little-endian float32 ("frames") or a NumPy archive ("npz"); returns key, path, crc32.

    A task writes under a name of its attempt and renames at the end, so a repeated task leaves one whole file. The folder is
    where Spark itself resolves it, so executors write to the store that readers meet.
    """
    folder = files.qualified(arrays.sparkSession, folder)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths, sums = [], []
            for k, x in zip(batch.column(key).to_pylist(), batch.column(values), strict=True):
                samples = x.values.to_numpy(zero_copy_only=False).astype("<f4")
                out = io.BytesIO()
                if kind == "npz":
                    np.savez_compressed(out, samples=samples, rate=np.float64(1.0))
                else:
                    out.write(samples.tobytes())
                name = f"{root}/{k}.{kind}"
                with store.open_output_stream(f"{name}.{attempt}.tmp") as f:
                    f.write(out.getvalue())
                store.move(f"{name}.{attempt}.tmp", name)
                paths.append(name)
                sums.append(zlib.crc32(samples.tobytes()))
            yield pa.record_batch([batch.column(key), pa.array(paths, pa.string()), pa.array(sums, pa.int64())], names=[key, "path", "crc32"])

    return arrays.select(key, values).mapInArrow(save, f"{key} long, path string, crc32 long")


def read_arrays(spark: SparkSession, folder: str, kind: str, key: str = "key") -> DataFrame:
    """key, values array<float>, crc32, reason (why an array could not be read; its values are null then)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).cast("long").alias(key), "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sums, reasons = [], [], []
            for raw in batch.column("content").to_pylist():
                samples, reason = None, None
                try:
                    if kind == "npz":
                        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                            samples = z["samples"]
                    else:
                        samples = np.frombuffer(raw, "<f4")
                except (ValueError, KeyError, zipfile.BadZipFile):
                    reason = "UNREADABLE_ARRAY"
                values.append(samples)
                sums.append(None if samples is None else zlib.crc32(samples.tobytes()))
                reasons.append(reason)
            yield pa.record_batch(
                [batch.column(key), pa.array(values, pa.list_(pa.float32())), pa.array(sums, pa.int64()), pa.array(reasons, pa.string())],
                names=[key, "values", "crc32", "reason"],
            )

    return files.mapInArrow(load, f"{key} long, values array<float>, crc32 long, reason string")
