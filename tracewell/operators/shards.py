"""Filling shards in order, without a task that walks over all files.

A file opens a new shard where it would overfill the current one; so where a shard ends depends on where it began, and the
fill looks sequential. Here running sums give every file the place at which a shard that began with it would end: its
pointer. Pointers are followed from the first file by doubling: a round adds to the starts that are known those as many
shards further on, and then makes pointers twice as long. After as many rounds as the number of shards has bits, all starts
are known.

Running sums are taken within ranges of the order, to which the sums of earlier ranges are added. Ends are found within
buckets as wide as a shard; a bucket has at most capacity / least size files, so sizes should have a floor (a header, say).

Defined cases: a file larger than a shard gets a shard of its own; a null in the stratum is a stratum; files must have
different orders within a stratum, and no null sizes; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.streaming.windows import folder_of


def written(df: DataFrame) -> DataFrame:
    """df through a new folder of the shared store: computed once, lineage cut."""
    folder = folder_of(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def in_ranges(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with `_range`: ranges of (keys, order), ascending."""
    return written(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], maxima: dict[str, Column] | None = None) -> DataFrame:
    """rows (of `in_ranges`) with running sums and maxima by order within keys, this row included."""
    maxima = maxima or {}
    inside = W.partitionBy("_range", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = rows.groupBy("_range", *keys).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_{n}") for n, c in maxima.items()))
    base = held.select("_range", *keys, *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums), *(F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in maxima))
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.max(c).over(inside) for n, c in maxima.items()})
    out = out.join(base, ["_range", *keys])
    out = out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums} | {n: F.greatest(n, f"_{n}") for n in maxima})
    return out.drop(*(f"_{n}" for n in [*sums, *maxima]))


def ends(files: DataFrame, capacity: int) -> DataFrame:
    """_key, at, next: where the shard that begins with each file ends, as the number of the first file after it."""
    full = F.col("total") - F.col("size") + capacity  # a shard from here holds files whose running sum is at most this
    bucket = lambda c: F.floor(c / capacity)
    sums = files.select("_key", bucket(F.col("total")).alias("bucket"), F.col("total").alias("value"), F.lit(0).alias("asks"), "at")
    asks = files.select("_key", bucket(full).alias("bucket"), full.alias("value"), F.lit(1).alias("asks"), "at")
    order = W.partitionBy("_key", "bucket").orderBy("value", "asks", "at").rowsBetween(W.unboundedPreceding, 0)
    both = sums.unionByName(asks).withColumn("_within", F.sum((F.col("asks") == 0).cast("long")).over(order))
    held = sums.unionByName(asks).groupBy("_key", "bucket").agg(F.sum((F.col("asks") == 0).cast("long")).alias("_held"))
    earlier = W.partitionBy("_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = held.select("_key", "bucket", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_base"))
    found = both.where("asks = 1").join(base, ["_key", "bucket"])
    return found.select("_key", "at", F.greatest(F.col("_base") + F.col("_within"), F.col("at") + 1).alias("next"))


def reached(pointers: DataFrame) -> DataFrame:
    """_key, at: the places that pointers (_key, at, next) lead to from place 0, and 0 itself."""
    places = pointers.select("_key", "at")
    known = written(places.where("at = 0"))
    while True:
        jumps = pointers.withColumnRenamed("next", "to")
        more = known.join(jumps, ["_key", "at"]).select("_key", F.col("to").alias("at"))
        more = more.join(places, ["_key", "at"], "left_semi")  # what points past the end leads nowhere
        grown = written(known.unionByName(more).distinct())
        if grown.count() == known.count():
            return grown
        known = grown
        onward = pointers.select("_key", F.col("at").alias("next"), F.col("next").alias("after"))
        pointers = written(pointers.join(onward, ["_key", "next"]).select("_key", "at", F.col("after").alias("next")))


def fill_shards(files: DataFrame, stratum: list[str], order: str, size: str, capacity: int) -> DataFrame:
    """files with `shard` (from 0 within the stratum) and `filled` (its size up to this file)."""
    rows = files.withColumn("_key", F.to_json(F.struct(*stratum), {"ignoreNullFields": "false"}))
    rows = in_ranges(rows.select("_key", F.col(order).alias("order"), F.col(size).cast("long").alias("size"), F.struct(*files.columns).alias("file")), ["_key"], "order")
    numbered = running(rows, ["_key"], "order", {"total": F.col("size"), "count": F.lit(1).cast("long")})
    numbered = written(numbered.withColumn("at", F.col("count") - 1).drop("count"))
    starts = reached(written(ends(numbered, capacity))).withColumn("starts", F.lit(1).cast("long"))
    marked = numbered.join(starts, ["_key", "at"], "left").withColumn("starts", F.coalesce("starts", F.lit(0).cast("long")))
    before = F.when(F.col("starts") == 1, F.col("total") - F.col("size"))
    filled = running(marked, ["_key"], "order", {"shard": F.col("starts")}, {"begun": before})
    return filled.select("file.*", (F.col("shard") - 1).alias("shard"), (F.col("total") - F.col("begun")).alias("filled"))
