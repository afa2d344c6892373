"""Mixing sources to target weights by hash-threshold histograms.

Documents get a 48-bit hash of their key. Tokens are summed by (source, hash bucket); the bucket in which a source's
budget ends is refined three times, so four small histograms find the threshold and a filter applies it: nothing is sorted.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null key hashes as the
empty string; repeated keys share a hash and are taken together; an empty table gives no rows; columns other than the
three named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import materialize
from tracewell.session import table

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, LEVEL_BITS = 4, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash48(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """One row per source: its share of all sizes by weight, no more than `ceiling` times its size, the excess reshared.

    Resharing until none is above ends where every open source stands at weight x level; sources close in the order of
    ceiling / weight, so a prefix sum over that order finds the level. `sizes` has one row per source.
    """
    lcm = 1
    for w in weights:
        lcm *= w
    pick = F.array(*map(F.lit, weights))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy((F.col("cap") * (F.lit(lcm) / F.col("weight")).cast("long")), F.col("source").asc_nulls_last())
    whole = lambda c: c.cast("decimal(38,0)")
    s = (
        sizes.withColumn("weight", F.get(pick, (F.row_number().over(ordered) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * ceiling)
        .withColumn("closed", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("rest", F.col("total") - F.col("closed"))
        .withColumn("fits", whole(F.col("rest")) * F.col("weight") <= whole(F.col("cap")) * F.col("open_weight"))
    )
    first = F.min(F.when(F.col("fits"), F.struct("at", "rest", "open_weight"))).over(W.partitionBy())
    s = s.withColumn("first", first)
    level = (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.open_weight").cast("double")
    return s.select(
        "source", "key", "source_size",
        F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double")).otherwise(level).alias("target"),
    )


def source_key(source: Column) -> Column:
    """A key that is never null: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("key"),
        word_count(F.col(text)).alias("size"), hash48(F.col(key)).alias("hash"),
    )


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """Per source: key, source_size, target, and `times` and `cut`: documents with a hash below cut go in once more than times."""
    sums = sized.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    plan = targets(sums, weights, ceiling)
    plan = plan.withColumn("times", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)))
    plan = plan.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    edge = materialize(plan.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")), "plan")
    for level in range(LEVELS):
        edge = materialize(refine(sized, edge, 48 - LEVEL_BITS * (level + 1)), f"edge{level}")
    # The last cell holds one hash; it is taken if that brings the source nearer to its target.
    nearer = (F.col("before") + F.col("cell")) - F.col("budget") < F.col("budget") - F.col("before")
    return edge.select("key", "source_size", "target", "times", (F.col("prefix") + F.coalesce(nearer, F.lit(False)).cast("long")).alias("cut"))


def repeats_of(hash_: Column) -> Column:
    return (F.col("times") + (hash_ < F.col("cut")).cast("long")).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    ceiling: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per document: key, source, size, source_size, target of its source, taken (size x the times it is repeated)."""
    sized = materialize(measure(docs, key, text, source), "sized")
    mixed = sized.join(plan_mix(sized, weights, ceiling), "key")
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats_of(F.col("hash"))).alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it; rows without words stay as they are."""
    sized = materialize(measure(docs, key, text, source), "sized")
    plan = plan_mix(sized, weights, ceiling).select(F.col("key").alias("mix_key"), "times", "cut")
    rows = docs.withColumn("mix_key", source_key(F.col(source))).join(plan, "mix_key")
    times = F.when(word_count(F.col(text)) == 0, F.lit(1)).otherwise(repeats_of(hash48(F.col(key))))
    return rows.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def refine(sized: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
    """Histogram the bucket `prefix` of each source one level finer and find the cell where its budget ends."""
    own = edge.select("key", "prefix", "budget", "before")
    cells = (
        sized.join(own, "key")
        .where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        .groupBy("key", F.shiftright("hash", shift).alias("cell_prefix"))
        .agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before"))
    )
    upto = W.partitionBy("key").orderBy("cell_prefix").rowsBetween(W.unboundedPreceding, 0)
    run = cells.withColumn("after", F.col("before") + F.sum("n").over(upto))
    over = F.col("after") > F.col("budget")
    found = run.groupBy("key").agg(
        F.min(F.when(over, F.struct("cell_prefix", "n", "after"))).alias("edge"), F.max("cell_prefix").alias("last")
    )
    none = F.col("edge").isNull()
    return edge.drop("prefix", "before", "cell").join(found, "key", "left").select(
        *[c for c in edge.columns if c not in ("prefix", "before", "cell")],
        F.coalesce(F.when(none, F.col("last") + 1).otherwise(F.col("edge.cell_prefix")), F.lit(0)).cast("long").alias("prefix"),
        F.coalesce(F.when(~none, F.col("edge.after") - F.col("edge.n")), F.lit(0)).cast("long").alias("before"),
        F.coalesce(F.col("edge.n"), F.lit(0)).cast("long").alias("cell"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * 3 AS cap FROM sums),
o AS (SELECT *, row_number() OVER r AS pos,
             coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
             sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             sum(source_size) OVER () AS total
      FROM w WINDOW r AS (ORDER BY cap * (10 // weight), source NULLS LAST)),
f AS (SELECT pos AS first_pos, total - closed AS rest, open_weight FROM o
      WHERE (total - closed) * weight <= cap::HUGEINT * open_weight ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN pos < first_pos THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / f.open_weight::DOUBLE END AS target FROM o, f),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS times,
             target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS budget FROM t),
cells AS (SELECT source, h, sum(size) AS n FROM sized GROUP BY source, h),
runs AS (SELECT c.source, h, n, budget, sum(n) OVER (PARTITION BY c.source ORDER BY h) AS after
         FROM cells c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
edge AS (SELECT source, min(h) FILTER (after > budget) AS h,
                arg_min(after - n, h) FILTER (after > budget) AS before, arg_min(n, h) FILTER (after > budget) AS n FROM runs GROUP BY source)
SELECT doc_id, size, p.source_size, target,
       (size * (times + CASE WHEN e.h IS NULL OR s.h < e.h OR (s.h = e.h AND before + n - budget < budget - before) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN p ON s.source IS NOT DISTINCT FROM p.source JOIN edge e ON e.source IS NOT DISTINCT FROM s.source
"""
