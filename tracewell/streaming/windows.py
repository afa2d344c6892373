"""Structured Streaming counterparts: the same results as the batch queries, from a stream that is read to its end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream; event time in UTC."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def folder_of(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tracewell-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def finish(df: DataFrame) -> DataFrame:
    """Run the stream over all there is and read its last complete result, which executors write; no row passes the driver."""
    folder, written = folder_of(df.sparkSession), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        written.append(f"{folder}/{number}")

    stream = df.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state")
    stream.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(written[-1]) if written else df.sparkSession.createDataFrame([], df.schema)


def q_stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    windows = stream_of(spark, sf).withWatermark("ts", "30 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    found = windows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return finish(found).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def q_stream_session(spark: SparkSession, sf: str) -> DataFrame:
    sessions = stream_of(spark, sf).withWatermark("ts", "30 days").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id")
    found = sessions.agg(F.count("*").alias("n"))
    return finish(found).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def peaks(stream: DataFrame) -> DataFrame:
    """user_id, event_id, value of events whose value is above the one before and the one after, as a stream.

    The state of a user is the last two events, so a peak at the seam of two batches is found, and memory is two events a
    user. Events of a user must come in time order across batches; within a batch they are sorted.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
        last = state.get if state.exists else (None, None, None)  # value before, event, value
        out = []
        for event, value in zip(part["event_id"].tolist(), part["value"].tolist(), strict=True):
            before, held, top = last
            if before is not None and top > before and top > value:
                out.append((key[0], held, top))
            last = (top, event, value)
        state.update(last)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value"])

    rows = stream.where("value IS NOT NULL").select("user_id", "event_id", "value", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, value double", "before double, event_id long, value double", "append", "NoTimeout")


def append_to(stream: DataFrame, folder: str) -> None:
    """Run a stream over what there is since its last run, into Parquet; the folder's checkpoint lets it go on where it was."""
    to = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    to.trigger(availableNow=True).start().awaitTermination()


def closed_windows(stream: DataFrame, folder: str, delay: str = "1 day", width: str = "1 day") -> dict[str, int]:
    """Append the windows that the watermark has closed since the last run to a folder's rows, and forget them.

    A window is written once, when the watermark passes its end; its state goes then, so state holds the windows of the delay
    alone. A row that comes after its window was closed is late: it changes nothing and is counted. Returns batches, late
    rows, and the most windows that were in state.
    """
    windows = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    rows = windows.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")
    run = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    state = [s for p in run.recentProgress for s in p["stateOperators"]]
    return {"batches": len(run.recentProgress), "late": sum(s["numRowsDroppedByWatermark"] for s in state), "held": max((s["numRowsTotal"] for s in state), default=0)}


def q_stream_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Days that ended at least a day before the last event, from a stream whose result only grows."""
    folder = folder_of(spark)
    closed_windows(stream_of(spark, sf), folder)
    return spark.read.schema("start_us long, event_type string, n long, total double").parquet(f"{folder}/rows")


def q_stream_peaks(spark: SparkSession, sf: str) -> DataFrame:
    folder = folder_of(spark)
    append_to(peaks(stream_of(spark, sf)), folder)
    return spark.read.schema("user_id long, event_id long, value double").parquet(f"{folder}/rows")


QUERIES = {"q_stream_closed": q_stream_closed, "q_stream_peaks": q_stream_peaks, "q_stream_tumbling": q_stream_tumbling, "q_stream_session": q_stream_session}
ORACLES = {
    "q_stream_closed": """
WITH m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 AS mark FROM events)
SELECT (epoch_us(ts) // 86400000000) * 86400000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE (epoch_us(ts) // 86400000000 + 1) * 86400000000 <= (SELECT mark FROM m) GROUP BY 1, 2""",
    "q_stream_peaks": """
WITH d AS (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, value FROM d WHERE value > a AND value > b""",
    "q_stream_tumbling": """
SELECT (epoch_us(ts) // 86400000000) * 86400000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "q_stream_session": """
WITH d AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
}
