"""Queries whose work is a numeric kernel in Arrow batches, greedy selection, matching, or MLlib."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import kernels, relocation
from tracewell.operators.matching import optimal_match, select_peaks
from tracewell.operators.shards import fill_shards
from tracewell.plans import sequences
from tracewell.session import table

DAY, REACH, SEED = 86_400_000_000, 7_200_000_000, 12012


def timing_null(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clicks with their feasible pieces, their 99 draws, views) in microseconds.

    A click may move within its own day where the recording is supported: from its first to its last event, less the spans
    that error events mark as bad, as many minutes as their value says.
    """
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    spans = e.groupBy("user_id").agg(F.min("t").alias("lo"), (F.max("t") + 1).alias("hi"))
    bad = e.where("event_type = 'error'").withColumn("to", F.col("t") + F.floor(F.col("value") * 60).cast("long") * 1_000_000)
    support = relocation.without(spans, relocation.joined(bad, "user_id", "t", "to"), "user_id")
    clicks = relocation.feasible(e.where("event_type = 'click'").select("user_id", "event_id", "t"), support, "user_id", "t", DAY)
    return clicks, relocation.draws(clicks, "event_id", SEED), e.where("event_type = 'view'").select("user_id", "t")


def q_timing_null(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks matched with views within two hours, against 99 draws in which each click moves within what is feasible for it.

    Every draw is matched anew. For each recording with clicks: those that can't move, the matches of those that can, order
    statistics of the draws, and the share of draws (with the observed one) that match as many.
    """
    clicks, _, views = timing_null(spark, sf)
    found = relocation.matched_null(clicks, views, "user_id", "event_id", "t", SEED, REACH, DAY)
    every = F.when(F.col("events") > F.col("still"), F.col("matched"))
    rows = found.select("user_id", F.col("events").alias("clicks"), F.col("still").alias("fixed"), F.get(every, F.lit(0)).alias("matched"), F.sort_array(F.slice(every, 2, relocation.DRAWS)).alias("_v"))
    rows = rows.select("*", *relocation.statistics_of(F.col("_v")))
    above = F.size(F.filter("_v", lambda v: v >= F.col("matched")))
    reason = F.when(F.col("clicks") == F.col("fixed"), relocation.NO_PLACE).otherwise(F.col("reason"))
    return rows.select("user_id", "clicks", "fixed", "matched", "low", "middle", "high", F.when(F.col("clicks") > F.col("fixed"), (1 + above) / 100.0).alias("p_value"), reason.alias("reason"))


def contingency(spark: SparkSession, sf: str) -> np.ndarray:
    rows = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("code")).count().toPandas()  # labels x codes
    return rows.pivot(index="event_type", columns="code", values="count").fillna(0).to_numpy().astype(int)


def q_ami(spark: SparkSession, sf: str) -> DataFrame:
    counts = contingency(spark, sf)
    n, rows, columns = int(counts.sum()), counts.sum(1).tolist(), counts.sum(0).tolist()
    if n < 2:
        return spark.createDataFrame([(None,)], "ami double")

    # The chance term sums over all counts that a cell may have, so each task takes cells of the table.
    def work(batches):
        for batch in batches:
            yield pd.DataFrame({"expected": [kernels.chance_information(x, y, n) for x, y in zip(batch["x"].tolist(), batch["y"].tolist(), strict=True)]})

    cells = spark.createDataFrame([(x, y) for x in rows for y in columns], "x long, y long").repartition(len(rows) * len(columns))
    expected = cells.mapInPandas(work, "expected double").agg(F.sum("expected")).first()[0]
    return spark.createDataFrame([(kernels.adjusted_mutual_information(counts, expected),)], "ami double")


def q_nms_peaks(spark: SparkSession, sf: str) -> DataFrame:
    peaks = sequences.QUERIES["q_local_maxima"](spark, sf).select("user_id", "k", "score")
    return select_peaks(peaks, ["user_id"], "k", "score", 4.0)


def q_optimal_match(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    a, b = (e.where(F.col("event_type") == kind).drop("event_type") for kind in ("click", "view"))
    return optimal_match(a, b, ["user_id"], "t", "event_id", 7200.0)


def q_pooled_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks, views and their one-to-one matches of each user, summed by variant.

    Its SQL counts matches by walking both lists of times from the left, which finds as many pairs as any matching has.
    """
    variant = (F.col("user_id") % 10).alias("variant")
    kinds = [F.when(F.col("event_type") == kind, 1).otherwise(0).alias(name) for kind, name in (("click", "na"), ("view", "nb"))]
    sides = table(spark, sf, "events").select(variant, *kinds, F.lit(0).alias("matched"))
    pairs = q_optimal_match(spark, sf).select(variant, F.lit(0).alias("na"), F.lit(0).alias("nb"), F.lit(1).alias("matched"))
    sums = sides.unionByName(pairs).groupBy("variant").agg(*(F.sum(c).alias(c) for c in ("na", "nb", "matched")))
    return sums.withColumn("f1", F.round(2.0 * F.col("matched") / F.nullif(F.col("na") + F.col("nb"), F.lit(0)), 9))


def q_shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each source, in order, into shards of at most 20,000 units; a file has a header of 512."""
    files = table(spark, sf, "documents").select("source", "doc_id", (F.col("n_chars") + 512).alias("size"))
    return fill_shards(files, ["source"], "doc_id", "size", 20_000).drop("size")


def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Standardise, project and cluster on even keys; codes for all vectors, and those farther out than 99 % of a code's even ones."""
    v = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    train = v.where("vec_id % 2 = 0")
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(train)
    pca = PCA(k=20, inputCol="scaled", outputCol="features").fit(scaler.transform(train))
    fitted = pca.transform(scaler.transform(v)).select("vec_id", "label", "features")
    model = KMeans(k=8, seed=17, maxIter=50, featuresCol="features", predictionCol="code").fit(fitted.where("vec_id % 2 = 0"))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]  # eight centres of 20 numbers
    own = F.get(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("code"))
    far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), own, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, v: a + v))
    coded = model.transform(fitted).withColumn("distance", far)
    limits = coded.where("vec_id % 2 = 0").groupBy("code").agg(F.percentile("distance", 0.99).alias("limit"))
    rows = coded.join(F.broadcast(limits), "code", "left")
    return rows.select("vec_id", "label", "code", F.round("distance", 9).alias("distance"), (F.col("distance") > F.col("limit")).alias("outlier"))


NAMES = "q_timing_null q_ami q_nms_peaks q_optimal_match q_pooled_f1 q_shard_plan q_tokenize"
QUERIES = {n: globals()[n] for n in NAMES.split()}
ORACLES = {
    "q_pooled_f1": """
WITH RECURSIVE t AS (SELECT user_id, event_type, list(epoch_us(ts) ORDER BY ts) AS ts FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type),
u AS (SELECT a.user_id, a.ts AS a, b.ts AS b FROM t a JOIN t b ON b.user_id = a.user_id AND a.event_type = 'click' AND b.event_type = 'view'),
w AS (SELECT user_id, a, b, 1 AS i, 1 AS j, 0 AS m FROM u
  UNION ALL SELECT user_id, a, b, CASE WHEN abs(a[i] - b[j]) <= 7200000000 OR a[i] < b[j] THEN i + 1 ELSE i END, CASE WHEN abs(a[i] - b[j]) <= 7200000000 OR a[i] >= b[j] THEN j + 1 ELSE j END,
         CASE WHEN abs(a[i] - b[j]) <= 7200000000 THEN m + 1 ELSE m END FROM w WHERE i <= len(a) AND j <= len(b)),
p AS (SELECT user_id, max(m) AS m FROM w GROUP BY user_id),
c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS na, count(*) FILTER (WHERE event_type = 'view') AS nb FROM events GROUP BY user_id)
SELECT c.user_id % 10 AS variant, sum(na) AS na, sum(nb) AS nb, coalesce(sum(p.m), 0) AS matched, round(2 * CAST(coalesce(sum(p.m), 0) AS double) / nullif(sum(na) + sum(nb), 0), 9) AS f1
FROM c LEFT JOIN p ON p.user_id = c.user_id GROUP BY c.user_id % 10""",
    "q_nms_peaks": "WITH RECURSIVE m AS ("
    + sequences.ORACLES["q_local_maxima"]
    + """), r AS (SELECT user_id, k, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, k) AS n FROM m),
g AS (SELECT user_id, n, k, score, [k] AS kept, true AS ok FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.k, r.score, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - r.k) < 4)) = 0 THEN list_append(g.kept, r.k) ELSE g.kept END,
         len(list_filter(g.kept, lambda x: abs(x - r.k) < 4)) = 0 FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1)
SELECT user_id, k, score FROM g WHERE ok""",
    "q_shard_plan": """
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars + 512 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, size AS filled, 0 AS shard FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN f.filled + o.size > 20000 THEN o.size ELSE f.filled + o.size END, CASE WHEN f.filled + o.size > 20000 THEN f.shard + 1 ELSE f.shard END
  FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1)
SELECT source, doc_id, CAST(shard AS bigint) AS shard, CAST(filled AS bigint) AS filled FROM f""",
}
