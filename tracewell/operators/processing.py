"""Blocks processed once: a ledger of what is done, receipts of what failed, and runs that go on where one was killed.

A run takes the blocks that the ledger doesn't have (an anti join by key) and deals them into waves. A wave is one Spark
job: tasks call a function for each block, and a block becomes one row with its results, or, if the function raises, with a
receipt (type and text of the error); its neighbours go on. The row stands in the wave's folder, which counts once Spark has
committed the job (its _SUCCESS file); so a killed run leaves whole blocks or none, and what it had not committed is done
again. Should two runs do the same block, the one whose wave sorts first counts, everywhere.

Defined cases: failed blocks count as done, unless a run is told to take them again: then a later success replaces the
receipt; a null key is refused; keys must be unique; without blocks a run does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.sources import files

COMPLETE, FAILED = "COMPLETE", "FAILED"


class BlockLedger:
    """A folder of waves. key: the column that names blocks; results: the schema of the rows that a block gives."""

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, results: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.names = [f.strip().split()[0] for f in results.split(", ")]
        inner = ", ".join(f"{n}: {f.strip().split(None, 1)[1]}" for n, f in zip(self.names, results.split(", "), strict=True))
        self.schema = f"{key} {kind}, status string, error_type string, reason string, results array<struct<{inner}>>"

    def waves(self) -> list[str]:
        """Committed waves, in order."""
        return [n for n in files.names(self.spark, self.folder) if files.exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]

    def blocks(self) -> DataFrame:
        """A row for each block that is done: key, status, error_type, reason, results, wave."""
        waves = self.waves()
        if not waves:
            return self.spark.createDataFrame([], self.schema + ", wave string")
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{w}" for w in waves))
        rows = rows.withColumn("wave", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        first = W.partitionBy(self.key).orderBy(F.col("status") != COMPLETE, "wave")
        return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")

    def receipts(self) -> DataFrame:
        return self.blocks().drop("results")

    def results(self) -> DataFrame:
        """The rows of complete blocks, with their key."""
        return self.blocks().where(F.col("status") == COMPLETE).select(self.key, F.explode("results").alias("r")).select(self.key, "r.*")

    def todo(self, blocks: DataFrame, again: bool = False) -> DataFrame:
        done = self.blocks().where(F.col("status") == COMPLETE) if again else self.blocks()
        return blocks.join(done.select(self.key), self.key, "left_anti")

    def run(self, blocks: DataFrame, function: Callable[[dict], list[tuple]], waves: int = 1, again: bool = False, most: int | None = None) -> int:
        """Process what is to do in so many waves, `most` of them in this run; returns how many it committed.

        function gets a block's row as a dict and returns its results' rows.
        """
        if blocks.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError("a block without a key")
        key, names, columns = self.key, self.names, blocks.columns

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False, name=None):
                    row = dict(zip(columns, row, strict=True))
                    try:
                        made = [dict(zip(names, r, strict=True)) for r in function(row)]
                        out.append((row[key], COMPLETE, None, None, made))
                    except Exception as error:  # noqa: BLE001  whatever a block raises is its receipt
                        out.append((row[key], FAILED, type(error).__name__, str(error)[:1000], None))
                yield pd.DataFrame(out, columns=[key, "status", "error_type", "reason", "results"])

        done, run = 0, uuid.uuid4().hex[:12]
        number = 1 + max([int(w.split("-")[1]) for w in files.names(self.spark, self.folder)], default=-1)
        for wave in range(waves):
            if most is not None and done >= most:
                break
            own = self.todo(blocks, again).where(F.pmod(F.xxhash64(key), F.lit(waves)) == wave) if waves > 1 else self.todo(blocks, again)
            if own.limit(1).count():
                own.mapInPandas(work, self.schema).write.parquet(f"{self.folder}/wave-{number + done:08d}-{run}")
                done += 1
        return done
