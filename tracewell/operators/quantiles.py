"""Exact quantiles of columns of any size, without a task that holds their distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A sketch's ranks are right to 1 / ACCURACY of all; the bracket reaches ten times as far.
ACCURACY, MARGIN, FEW = 2000, 0.005, 5000


def quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row, a column for each name of wanted (column, share): what `percentile` gives, null without any value.

    A sketch finds a narrow bracket around each quantile; then values below it are counted and those inside ranked, by
    distinct value. Both passes are partial aggregates.
    """
    values = rows.select(*(c.cast("double").alias(n) for n, (c, _) in wanted.items()))

    def bracket(name: str, share: float) -> Column:
        v, n = F.col(name), F.count(name)
        plain = (n <= FEW) | F.coalesce(F.bool_or(F.isnan(v)), F.lit(False))  # sketches don't order NaN
        near = F.percentile_approx(v, F.array(F.lit(max(0.0, share - MARGIN)), F.lit(min(1.0, share + MARGIN))), F.lit(ACCURACY))
        ends = [F.when(plain, end(v)).otherwise(near[i]) for i, end in enumerate((F.min, F.max))]
        return F.struct(ends[0].alias("lo"), ends[1].alias("hi"), ((n - 1) * F.lit(share)).alias("at")).alias(f"_{name}")

    held = values.join(F.broadcast(values.agg(*(bracket(n, share) for n, (_, share) in wanted.items()))))
    part = lambda n: F.when(F.col(n) <= F.col(f"_{n}.hi"), F.struct(F.lit(n).alias("name"), F.col(f"_{n}.at").alias("at"), F.when(F.col(n) >= F.col(f"_{n}.lo"), F.col(n)).alias("v")))
    each = held.select(F.explode(F.array(*map(part, wanted))).alias("p")).where("p IS NOT NULL").select("p.*")
    order = W.partitionBy("name").orderBy("v").rowsBetween(W.unboundedPreceding, 0)  # null, what lies below, comes first
    counts = each.groupBy("name", "at", "v").count().withColumn("upto", F.sum("count").over(order))
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    found = counts.groupBy("name", "at").agg(first(F.floor("at")).alias("low"), first(F.ceil("at")).alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    return found.agg(*(F.max(F.when(F.col("name") == n, value)).alias(n) for n in wanted))
