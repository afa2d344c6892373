"""Blocks processed once with receipts, and tables published in versions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import chunks
from tracewell.operators.processing import BlockLedger
from tracewell.plans.recordings import samples
from tracewell.session import table
from tracewell.sources import publishing
from tracewell.streaming.windows import folder_of

BLOCK = 40


def event_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """block (user:number), user_id, x: every block of BLOCK places of a recording, the last one and those with gaps too."""
    chunks.bounded_batches(spark)
    rows = samples(spark, sf).groupBy("user_id", F.floor(F.col("k") / BLOCK).alias("number"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("x"))
    return rows.select(F.concat_ws(":", "user_id", "number").alias("block"), "user_id", "x")


def extremes(row: dict) -> list[tuple]:
    """The largest and the smallest sample of a block, and where they are; a block with a gap, or one cut short, is refused."""
    x = list(row["x"])
    if any(v is None or math.isnan(v) for v in x):
        raise ValueError("MISSING_SAMPLE")
    if len(x) < BLOCK:
        raise ValueError("INCOMPLETE_BLOCK")
    return [(kind, x.index(f(x)), float(f(x))) for kind, f in (("max", max), ("min", min))]


def q_block_processor(spark: SparkSession, sf: str) -> DataFrame:
    """Every block's receipt and results after a run that ends early and one that goes on from there."""
    ledger = BlockLedger(spark, folder_of(spark), "block", "string", "kind string, place int, value double")
    blocks = event_blocks(spark, sf)
    ledger.run(blocks, extremes, waves=4, most=2)
    ledger.run(blocks, extremes)
    return ledger.blocks().select("block", "status", "reason", F.explode_outer("results").alias("r")).select("block", "status", "reason", "r.*")


AUDITS = [
    publishing.unique_key("nation", "n_nationkey"),
    publishing.unique_key("customer", "c_custkey"),
    publishing.unique_key("orders", "o_orderkey"),
    publishing.no_nulls("orders", "o_orderkey", "o_custkey"),
    publishing.foreign_key("customer", "c_nationkey", "nation", "n_nationkey"),
    publishing.foreign_key("orders", "o_custkey", "customer", "c_custkey"),
]


def q_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of three tables: what a good one holds when read again, and what came of four attempts to publish."""
    folder = folder_of(spark)
    good = {n: table(spark, sf, n) for n in ("nation", "customer", "orders")}
    orphans = good | {"customer": good["customer"].where("c_custkey % 2 = 0")}
    changed = good | {"nation": good["nation"].where("n_nationkey >= 0").withColumn("n_name", F.lower("n_name"))}
    attempts = []
    for name, version, made in (("first", "v1", good), ("orphans", "v2", orphans), ("again", "v1", {k: t.repartition(3) for k, t in good.items()}), ("changed", "v1", changed)):
        try:
            status = "PUBLISHED" if publishing.publish(spark, folder, version, made, AUDITS) else "ALREADY_PUBLISHED"
        except publishing.AuditFailed as failed:
            status = "AUDIT_FAILED: " + ", ".join(failed.found)
        except publishing.Refused:
            status = "REFUSED"
        attempts.append((name, None, None, status))
    rows = spark.createDataFrame(attempts, "table_name string, rows long, found long, status string")
    return publishing.verify(spark, folder, "v1").unionByName(rows)


QUERIES = {"q_block_processor": q_block_processor, "q_publish": q_publish}
ORACLES = {
    "q_block_processor": f"""
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
b AS (SELECT concat(user_id, ':', k // {BLOCK}) AS block, list(value ORDER BY k) AS x, count(*) AS n, count(value) AS held FROM e GROUP BY user_id, k // {BLOCK})
SELECT block, 'COMPLETE' AS status, CAST(NULL AS varchar) AS reason, kind, CAST(CASE WHEN kind = 'max' THEN list_position(x, list_max(x)) ELSE list_position(x, list_min(x)) END - 1 AS integer) AS place,
  CASE WHEN kind = 'max' THEN list_max(x) ELSE list_min(x) END AS value FROM b CROSS JOIN (VALUES ('max'), ('min')) AS k(kind) WHERE n = {BLOCK} AND held = n
UNION ALL SELECT block, 'FAILED', CASE WHEN held < n THEN 'MISSING_SAMPLE' ELSE 'INCOMPLETE_BLOCK' END, NULL, NULL, NULL FROM b WHERE n < {BLOCK} OR held < n""",
    "q_publish": """
SELECT 'nation' AS table_name, count(*) AS rows, count(*) AS found, 'OK' AS status FROM nation UNION ALL SELECT 'customer', count(*), count(*), 'OK' FROM customer UNION ALL SELECT 'orders', count(*), count(*), 'OK' FROM orders
UNION ALL SELECT * FROM (VALUES ('first', CAST(NULL AS bigint), CAST(NULL AS bigint), 'PUBLISHED'), ('orphans', NULL, NULL, 'AUDIT_FAILED: orders.o_custkey in customer.c_custkey'), ('again', NULL, NULL, 'ALREADY_PUBLISHED'), ('changed', NULL, NULL, 'REFUSED'))""",
}
