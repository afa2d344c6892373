"""Evidence-catalogue queries: coverage, totals, duplicates, bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import table


def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage by dataset and status; unknown sizes stay unknown and are counted on their own."""
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    sessions = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    joined = people.join(sessions, people.c_custkey == sessions.o_custkey, "left")
    return joined.groupBy(F.col("c_nationkey").alias("dataset"), F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("recordings"),
        F.countDistinct("c_custkey").alias("people"),
        F.countDistinct(F.concat("c_mktsegment", F.lit(":"), F.col("c_custkey").cast("string"))).alias("groups"),
        F.round(F.sum("o_totalprice") / 3600, 6).alias("hours"),
        F.count_if(F.col("o_totalprice").isNull()).alias("unknown"),
    )


QUERIES = {"q_coverage": q_coverage}
ORACLES = {
    "q_coverage": """
SELECT c_nationkey AS dataset, o_orderstatus AS status, count(*) AS recordings, count(DISTINCT c_custkey) AS people,
       count(DISTINCT c_mktsegment || ':' || c_custkey::VARCHAR) AS groups, round(sum(o_totalprice) / 3600, 6) AS hours,
       count(*) FILTER (o_totalprice IS NULL) AS unknown
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
}
