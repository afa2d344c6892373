"""Events moved at random within what is feasible for each: its own bin of time, cut with the recording's supported intervals.

Intervals are half-open, in whole units (microseconds, say). A bin's feasible pieces are intervals of the support cut at the
bin's ends; a draw is a uniform number on their joint length, taken back into the pieces. So every draw lies in its event's
own set, whatever the support's gaps. Draws come from hashes of seed, event and draw: they are the same in any order of
tasks.

Defined cases: touching or overlapping support is joined; an event whose bin has no supported place has no draws and says
NO_FEASIBLE_PLACE; a null stratum or time takes no part; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.chunks import bounded_batches

NO_PLACE, NOT_ESTIMABLE, DRAWS = "NO_FEASIBLE_PLACE", "NOT_ESTIMABLE", 99


def joined(intervals: DataFrame, stratum: str, low: str, high: str) -> DataFrame:
    """stratum, lo, hi: the union of intervals, as intervals that neither touch nor overlap; empty ones are left out."""
    rows = intervals.select(F.col(stratum).alias("s"), F.col(low).cast("long").alias("lo"), F.col(high).cast("long").alias("hi")).where("s IS NOT NULL AND lo < hi")
    order = W.partitionBy("s").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    return rows.groupBy("s", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.col("s").alias(stratum), "lo", "hi")


def without(spans: DataFrame, gaps: DataFrame, stratum: str) -> DataFrame:
    """stratum, lo, hi: one span for each stratum (stratum, lo, hi) less the gaps (stratum, lo, hi), which are joined already."""
    cut = gaps.select(stratum, F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi"))
    order = W.partitionBy(stratum).orderBy("gap_lo")
    inner = cut.join(spans, stratum).withColumn("after", F.coalesce(F.lead("gap_lo").over(order), F.col("hi"))).withColumn("nth", F.row_number().over(order))
    behind = inner.select(stratum, F.greatest("lo", "gap_hi").alias("lo"), F.least("hi", "after").alias("hi"))
    first = spans.join(cut.groupBy(stratum).agg(F.min("gap_lo").alias("to")), stratum, "left").select(stratum, "lo", F.least("hi", F.coalesce("to", "hi")).alias("hi"))
    return behind.unionByName(first).where("lo < hi")


def feasible(events: DataFrame, support: DataFrame, stratum: str, time: str, width: int) -> DataFrame:
    """events with `pieces` (array of lo, hi, ascending) and `room` (their joint length); without any, pieces is empty."""
    bins = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("_bin")
    cut = support.select(stratum, "lo", "hi", bins)
    rows = events.where(F.col(stratum).isNotNull() & F.col(time).isNotNull()).withColumn("_bin", F.floor(F.col(time) / width))
    cut = cut.join(rows.select(stratum, "_bin"), [stratum, "_bin"], "left_semi")
    cut = cut.select(stratum, "_bin", F.greatest("lo", F.col("_bin") * width).alias("lo"), F.least("hi", (F.col("_bin") + 1) * width).alias("hi"))
    pieces = cut.groupBy(stratum, "_bin").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("pieces"))
    none = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    rows = rows.join(pieces, [stratum, "_bin"], "left").withColumn("pieces", F.coalesce("pieces", none)).drop("_bin")
    return rows.withColumn("room", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"]))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) for a key, by its hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


def offset(key: Column, room: Column, draw: Column, seed: int) -> Column:
    """A place on the joint length of an event's pieces, uniform by the hash of seed, event and draw."""
    return F.floor(uniform(F.lit(seed), key, draw) * room).cast("long")


def draws(rows: DataFrame, key: str, seed: int, count: int = DRAWS) -> DataFrame:
    """rows of `feasible` with `draw` (from 0) and `moved`, `count` for each event that has room."""
    each = rows.where("room > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    start = F.struct(offset(F.col(key), F.col("room"), F.col("draw"), seed).alias("left"), F.lit(None).cast("long").alias("at"))

    def step(state: Column, piece: Column) -> Column:
        size = piece["hi"] - piece["lo"]
        here = state["at"].isNull() & (state["left"] < size)
        return F.struct(F.when(here, state["left"]).otherwise(state["left"] - size).alias("left"), F.when(here, piece["lo"] + state["left"]).otherwise(state["at"]).alias("at"))

    return each.withColumn("moved", F.aggregate("pieces", start, step, lambda s: s["at"])).drop("pieces", "room")


def taken_back(left: np.ndarray, pieces: pa.ListArray) -> np.ndarray:
    """Places [event, draw] of offsets on the joint length of each event's pieces (lo, hi), of which none is empty."""
    flat, count = pieces.flatten(), pieces.value_lengths().to_numpy()
    lo, size = flat.field("lo").to_numpy(), flat.field("hi").to_numpy() - flat.field("lo").to_numpy()
    before = np.cumsum(size) - size  # the pieces of all events in a row
    at = left + before[np.cumsum(count) - count][:, None]
    piece = np.searchsorted(before, at, "right") - 1
    return lo[piece] + at - before[piece]


def most_pairs(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """How many one-to-one pairs of ascending times within the tolerance there can be: each time of a in turn takes the first
    of b that is left in its reach. a may hold several columns, each with its own pairs."""
    first, last = np.searchsorted(b, a - tolerance, "left"), np.searchsorted(b, a + tolerance, "right")
    j = np.zeros(a.shape[1:], np.int64)
    n = np.zeros(a.shape[1:], np.int64)
    for lo, hi in zip(first, last, strict=True):
        j = np.maximum(j, lo)
        hit = j < hi
        j += hit
        n += hit
    return n


def in_runs(own: DataFrame, fixed: DataFrame, stratum: str, tolerance: int, width: int, *columns: str) -> DataFrame:
    """stratum, own (array of at and columns), fixed (array of t, ascending): a row for each run that has any of own.

    Strata of own (stratum, at, columns) and fixed (stratum, t) are cut into runs where nothing follows within the tolerance,
    wherever in its bin a row of own moves; so no pair crosses a cut, and a row holds such a run.
    """
    bin_, t = F.floor(F.col("at") / width), F.col("t")
    a = own.select(stratum, "at", *columns, F.lit(0).alias("_side"), (bin_ * width).alias("_lo"), ((bin_ + 1) * width + tolerance).alias("_hi"))
    b = fixed.select(stratum, t.alias("at"), F.lit(1).alias("_side"), t.alias("_lo"), (t + 1 + tolerance).alias("_hi"))
    rows = a.unionByName(b, allowMissingColumns=True).dropna(subset=[stratum, "at"])
    order = W.partitionBy(stratum).orderBy("_lo", "_hi")
    reach = F.max("_hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("_lo") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    side = lambda n, value: F.collect_list(F.when(F.col("_side") == n, value))
    runs = rows.groupBy(stratum, "_run").agg(side(0, F.struct("at", *columns)).alias("own"), F.sort_array(side(1, F.col("at"))).alias("fixed"))
    return runs.where("size(own) > 0").drop("_run")


def matched_draws(moved: DataFrame, fixed: DataFrame, stratum: str, tolerance: int, width: int) -> DataFrame:
    """stratum, draw, matched: most pairs of each draw of moved (stratum, draw, moved) with fixed (stratum, t)."""
    kind = moved.schema[stratum].dataType.simpleString()
    runs = in_runs(moved.withColumn("at", F.col("moved")), fixed, stratum, tolerance, width, "draw").where("size(fixed) > 0")
    bounded_batches(moved.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for row in range(batch.num_rows):
                own, b = batch.column("own")[row].values, batch.column("fixed")[row].values.to_numpy()
                drawn, at = own.field("draw").to_numpy(), own.field("at").to_numpy()
                for draw in np.unique(drawn):
                    owners.append(row)
                    found.append((int(draw), int(most_pairs(np.sort(at[drawn == draw]), b, tolerance))))
            columns = [batch.column(stratum).take(pa.array(owners, pa.int64())), pa.array([d for d, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())]
            yield pa.record_batch(columns, names=[stratum, "draw", "matched"])

    return runs.mapInArrow(count, f"`{stratum}` {kind}, draw int, matched long").groupBy(stratum, "draw").agg(F.sum("matched").alias("matched"))


def matched_null(rows: DataFrame, fixed: DataFrame, stratum: str, key: str, time: str, seed: int, tolerance: int, width: int, count: int = DRAWS) -> DataFrame:
    """stratum, events, still (events without room), matched: a row for each stratum of `feasible` rows. matched is an array:
    most pairs of the events that have room with fixed (stratum, t), where they are and then in each of the draws of `draws`.

    Offsets are drawn where a run has met, so shuffles carry an event as one row and not as one for each draw; all draws of a
    run are matched together.
    """
    kind = rows.schema[stratum].dataType.simpleString()
    runs = in_runs(rows.withColumns({"at": F.col(time), "_key": F.col(key)}), fixed, stratum, tolerance, width, "_key", "pieces", "room")
    room = F.filter("own", lambda e: e["room"] > 0)
    runs = runs.select(stratum, F.size("own").alias("events"), F.size(room).alias("room"), F.when(F.size("fixed") > 0, room).otherwise(F.slice("own", 1, 0)).alias("own"), "fixed")
    drawn = lambda e: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda d: offset(e["_key"], e["room"], d, seed))
    each = {"at": F.transform("own", lambda e: e["at"]), "pieces": F.transform("own", lambda e: e["pieces"]), "left": F.flatten(F.transform("own", drawn))}
    runs = runs.select(stratum, "events", "room", *(c.alias(n) for n, c in each.items()), "fixed")
    bounded_batches(rows.sparkSession)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left = batch.column("at").flatten().to_numpy(), batch.column("left").flatten().to_numpy().reshape(-1, count)
            every = np.column_stack([at, taken_back(left, batch.column("pieces").flatten())])
            ends = [np.cumsum(batch.column(c).value_lengths().to_numpy())[:-1] for c in ("at", "fixed")]
            a, b = np.split(every, ends[0]), np.split(batch.column("fixed").flatten().to_numpy(), ends[1])
            found = np.zeros((batch.num_rows, count + 3), np.int64)
            found[:, 0] = batch.column("events").to_numpy()
            found[:, 1] = found[:, 0] - batch.column("room").to_numpy()
            for row in np.flatnonzero(batch.column("at").value_lengths().to_numpy()):
                found[row, 2:] = most_pairs(np.sort(a[row], axis=0), b[row], tolerance)
            owner = batch.column(stratum).dictionary_encode()
            sums = np.zeros((len(owner.dictionary), count + 3), np.int64)
            np.add.at(sums, owner.indices.to_numpy(), found)
            yield pa.record_batch([owner.dictionary, pa.array(list(sums), pa.list_(pa.int64()))], names=[stratum, "sums"])

    parts = runs.mapInArrow(match, f"`{stratum}` {kind}, sums array<bigint>").groupBy(stratum).agg(F.collect_list("sums").alias("parts"))
    none = F.array_repeat(F.lit(0).cast("long"), count + 3)
    sums = parts.select(stratum, F.aggregate("parts", none, lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("sums"))
    return sums.select(stratum, F.get("sums", F.lit(0)).alias("events"), F.get("sums", F.lit(1)).alias("still"), F.slice("sums", 3, count + 1).alias("matched"))


def statistics_of(values: Column, count: int = DRAWS) -> list[Column]:
    """draws, low, middle, high, reason of ascending values: see `order_statistics`."""
    whole = F.size(values) == count
    at = lambda p: F.when(whole, F.element_at(values, F.lit((count + 1) * p // 100)))
    return [F.size(values).alias("draws"), at(5).alias("low"), at(50).alias("middle"), at(95).alias("high"), F.when(~whole, NOT_ESTIMABLE).alias("reason")]


def order_statistics(values: DataFrame, stratum: str, value: str, count: int = DRAWS) -> DataFrame:
    """stratum, draws, low, middle, high, reason: the 5th, 50th and 95th of exactly 99 values; NOT_ESTIMABLE for any other number."""
    held = values.groupBy(stratum).agg(F.sort_array(F.collect_list(value)).alias("_v"))  # as many as there are draws
    return held.select(stratum, *statistics_of(F.col("_v"), count), "_v")
