"""Vector comparisons, exact tests and agreement measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.plans.sql import both
from tracewell.session import table

#: Vectors as blocks of 28 patches.
V = "v AS (SELECT vec_id, @idiv(vec_id / 28.0) AS block, vec_id % 28 AS k, label, @vec(embedding) AS x FROM embeddings WHERE embedding IS NOT NULL)"
#: Cosine distance of all pairs within a block, and the label distance they are compared with.
P = f"""{V}, n AS (SELECT *, sqrt(@dot(x, x)) AS norm FROM v),
pairs AS (SELECT a.block, a.k AS i, b.k AS j, CASE WHEN a.norm > 1e-12 AND b.norm > 1e-12 THEN 1 - @dot(a.x, b.x) / (a.norm * b.norm) END AS d,
  @float(abs(a.label - b.label)) AS e FROM n a JOIN n b ON a.block = b.block AND a.k < b.k)"""
RANKS = """r AS (SELECT block, rank() OVER (PARTITION BY block ORDER BY d) + (count(*) OVER (PARTITION BY block, d) - 1) / 2.0 AS rd,
  rank() OVER (PARTITION BY block ORDER BY e) + (count(*) OVER (PARTITION BY block, e) - 1) / 2.0 AS re, d, e FROM %s WHERE d IS NOT NULL)"""
E = "e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
CONTINGENCY = "t AS (SELECT event_type AS a, user_id % 4 AS b, @float(count(*)) AS n FROM events GROUP BY event_type, user_id % 4)"

TEXTS = {
    "q_pairwise_cosine": f"WITH {P} SELECT block, i, j, round(d, 6) AS distance FROM pairs",
    "q_adjacent_cosine": f"WITH {P} SELECT block, i, round(d, 6) AS distance FROM pairs WHERE j = i + 1",
    # Differences are scaled by the largest one, so that no square overflows or vanishes.
    "q_rms_distance": f"""
WITH {V}, d AS (SELECT a.block, a.k, @minus(a.x, b.x) AS x FROM v a JOIN v b ON a.block = b.block AND b.k = a.k + 1),
m AS (SELECT block, k, x, @largest(x) AS most FROM d), s AS (SELECT block, k, most, @scaled() AS x FROM m)
SELECT block, k, CASE WHEN most = 0 THEN 0.0 ELSE round(most * sqrt(@dot(x, x) / @items(x)), 6) END AS rms FROM s""",
    "q_spearman_geometry": f"""
WITH {P}, {RANKS % "pairs"}
SELECT block, count(*) AS n, CASE WHEN count(*) >= 28 AND min(d) < max(d) AND min(e) < max(e) THEN round(corr(@float(rd), @float(re)), 6) END AS rho,
       CASE WHEN count(*) < 28 THEN 'INSUFFICIENT_SUPPORT' WHEN min(d) = max(d) OR min(e) = max(e) THEN 'CONSTANT_DISTANCE_VECTOR' END AS reason FROM r GROUP BY block""",
    "q_spearman_change": f"""
WITH {P}, adjacent AS (SELECT * FROM pairs WHERE j = i + 1), {RANKS % "adjacent"}
SELECT block, count(*) AS n, CASE WHEN count(*) >= 7 AND min(d) < max(d) AND min(e) < max(e) THEN round(corr(@float(rd), @float(re)), 6) END AS rho,
       CASE WHEN count(*) < 7 THEN 'INSUFFICIENT_SUPPORT' WHEN min(d) = max(d) OR min(e) = max(e) THEN 'CONSTANT_DISTANCE_VECTOR' END AS reason FROM r GROUP BY block""",
    "q_permutation_test": """
WITH m AS (SELECT user_id % 3 AS i, event_type, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id % 3, event_type),
d AS (SELECT a.i, b.i AS j, abs(a.v - b.v) AS d FROM m a CROSS JOIN m b WHERE a.event_type = 'click' AND b.event_type = 'view'),
z AS (SELECT x.j AS a, y.j AS b, w.j AS c, x.d + y.d + w.d AS total FROM d x JOIN d y ON x.i = 0 AND y.i = 1 AND y.j <> x.j JOIN d w ON w.i = 2 AND w.j <> x.j AND w.j <> y.j)
SELECT count(*) AS permutations, round(@float(@count_if(total <= o + 1e-12)) / count(*), 9) AS p_value FROM (SELECT z.*, (SELECT sum(d) FROM d WHERE i = j) AS o FROM z) AS q""",
    "q_occupancy": """
WITH c AS (SELECT user_id, event_type, @float(count(*)) AS n FROM events GROUP BY user_id, event_type), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, count(*) AS occupied, round(exp(-sum(p * ln(p))), 9) AS effective, round(max(p), 9) AS largest FROM p GROUP BY user_id""",
    "q_ari": f"""
WITH {CONTINGENCY}, s AS (SELECT sum(n * (n - 1) / 2) AS cells, max(total) AS total FROM (SELECT n, sum(n) OVER () AS total FROM t) AS x),
a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT a, sum(n) AS n FROM t GROUP BY a) AS y), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT b, sum(n) AS n FROM t GROUP BY b) AS z)
SELECT round((cells - a.s * b.s / (total * (total - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (total * (total - 1) / 2)), 9) AS ari FROM s CROSS JOIN a CROSS JOIN b""",
    "q_mse_ratio": """
WITH m AS (SELECT event_type, avg(value) AS center FROM events GROUP BY event_type), g AS (SELECT avg(value) AS center FROM events)
SELECT e.event_type, round(avg(power(value - m.center, 2)) / nullif(avg(power(value - g.center, 2)), 0), 9) AS ratio FROM events e JOIN m ON m.event_type = e.event_type CROSS JOIN g GROUP BY e.event_type""",
    # A label's centroid is the mean of its vectors, component by component.
    "q_nearest_centroid": f"""
WITH {V}, c AS (SELECT label, i, avg(@item(x, i)) AS m FROM (SELECT label, x, @numbers(@items(x)) AS i FROM v) AS e GROUP BY label, i),
k AS (SELECT label AS code, @gather(i, m) AS x FROM c GROUP BY label), d AS (SELECT v.vec_id, k.code, round(@dot(v.x, v.x) - 2 * @dot(v.x, k.x) + @dot(k.x, k.x), 9) AS far FROM v CROSS JOIN k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY far, code) AS r FROM d) SELECT vec_id, code FROM r WHERE r = 1""",
}
#: Queries over blocks that together cover all rows.
BLOCKS = {
    # A block's shifts are as many as its events; a block whose profiles have no correlation has no p value.
    "q_cyclic_shift_null": """
WITH e AS (SELECT user_id, value, @float(@json(props, '$.k')) AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events),
p AS (SELECT user_id, @idiv(r / 27.0) AS block, r % 27 AS k, value AS a, other AS b, count(*) OVER (PARTITION BY user_id, @idiv(r / 27.0)) AS n FROM e),
s AS (SELECT p.user_id, p.block, p.n, p.k, p.a, shift FROM (SELECT *, @numbers(n) AS shift FROM p) AS p),
c AS (SELECT s.user_id, s.block, s.shift, max(s.n) AS n, covar_pop(s.a, q.b) / nullif(stddev_pop(CASE WHEN q.b IS NOT NULL THEN s.a END) * stddev_pop(CASE WHEN s.a IS NOT NULL THEN q.b END), 0) AS rho FROM s JOIN p q ON q.user_id = s.user_id AND q.block = s.block AND q.k = (s.k + s.shift) % s.n GROUP BY s.user_id, s.block, s.shift),
o AS (SELECT user_id, block, max(CASE WHEN shift = 0 THEN rho END) AS observed FROM c GROUP BY user_id, block)
SELECT c.user_id, c.block, max(c.n) AS n, round(max(o.observed), 6) AS observed, @count_if(shift > 0 AND rho >= observed - 1e-12) AS above,
       CASE WHEN max(o.observed) IS NOT NULL THEN round(@float(1 + @count_if(shift > 0 AND rho >= observed - 1e-12)) / max(c.n), 6) END AS p_value
FROM c JOIN o ON o.user_id = c.user_id AND o.block = c.block GROUP BY c.user_id, c.block""",
    "q_signflip": """
WITH x AS (SELECT user_id % 25 AS g, row_number() OVER (PARTITION BY user_id % 25 ORDER BY user_id) - 1 AS r, avg(value) - 50 AS effect FROM events GROUP BY user_id),
f AS (SELECT g, @idiv(r / 6.0) AS block, r % 6 AS k, effect FROM x), s AS (SELECT f.*, assignment FROM (SELECT *, @numbers(64) AS assignment FROM f) AS f),
t AS (SELECT g, block, assignment, sum(effect * CASE WHEN @idiv(assignment / power(2, k)) % 2 = 1 THEN -1 ELSE 1 END) AS total, sum(effect) AS observed, count(*) AS n FROM s GROUP BY g, block, assignment)
SELECT g, block, max(n) AS people, CASE WHEN max(n) >= 2 THEN round(@float(@count_if(abs(total) >= abs(observed) - 1e-12)) / count(*), 9) END AS p_value,
       CASE WHEN max(n) >= 2 THEN round(least(1.0, 4 * @float(@count_if(abs(total) >= abs(observed) - 1e-12)) / count(*)), 9) END AS p_bonferroni FROM t GROUP BY g, block""",
    "q_order_stats": f"""
WITH {E}, b AS (SELECT user_id, @idiv((k - 1) / 60.0) AS block, event_id, value FROM e),
s AS (SELECT user_id, block, value, row_number() OVER (PARTITION BY user_id, block ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id, block) AS n FROM b)
SELECT user_id, block, max(n) AS n, max(CASE WHEN r = 3 AND n = 60 THEN value END) AS low, max(CASE WHEN r = 30 AND n = 60 THEN value END) AS middle, max(CASE WHEN r = 58 AND n = 60 THEN value END) AS high,
       CASE WHEN max(n) < 60 THEN 'NOT_ESTIMABLE' END AS reason FROM s GROUP BY user_id, block""",
}
QUERIES, ORACLES = both(TEXTS | BLOCKS)
SHIFTED = 27


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation [block] of the pairs of a and b [block, place] that are both known; a masked one where there is none."""
    known = ~(np.ma.getmaskarray(a) | np.ma.getmaskarray(b))
    count, first = known.sum(1), known.argmax(1)[:, None]
    with np.errstate(all="ignore"):
        each = []
        for x in (a.data, b.data):
            d = np.where(known, x - np.take_along_axis(x, first, 1), 0.0)  # equal values become zeros, whatever their size
            each.append(np.where(known, d - (d.sum(1) / count)[:, None], 0.0))
        spread = [np.sqrt((d * d).sum(1) / count) for d in each]
        scale = spread[0] * spread[1]
        return np.ma.array((each[0] * each[1]).sum(1) / count / scale, mask=(count == 0) | (scale == 0))


def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their correlation and how many of the cyclic shifts have one that is no smaller (NaN: larger than any)."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        observed, above = np.ma.masked_all(len(n), float), np.zeros(len(n), np.int64)
        ends = np.cumsum(n)
        flat = [batch.column(c).flatten() for c in ("a", "b")]
        flat = [(x.is_null().to_numpy(zero_copy_only=False), x.fill_null(0.0).to_numpy()) for x in flat]
        for size in np.unique(n):  # at most as many as a block has places
            rows = np.flatnonzero(n == size)
            at = (ends[rows] - size)[:, None] + np.arange(size)
            a, b = (np.ma.array(x[at], mask=null[at]) for null, x in flat)
            own = correlations(a, b)
            observed[rows] = own
            for shift in range(1, size):
                rho = correlations(a, np.ma.array(np.roll(b.data, -shift, 1), mask=np.roll(b.mask, -shift, 1)))
                hit = np.isnan(rho.data) | (rho.data >= own.data - 1e-12)
                above[rows] += hit & ~np.ma.getmaskarray(rho) & ~np.ma.getmaskarray(own)
        columns = [batch.column("user_id"), batch.column("block"), batch.column("n"), pa.array(observed.data, pa.float64(), mask=np.ma.getmaskarray(observed)), pa.array(above)]
        yield pa.record_batch(columns, names=["user_id", "block", "n", "observed", "above"])


def q_cyclic_shift_null(spark: SparkSession, sf: str) -> DataFrame:
    """What the SQL of this name says, with a block as a row: the shifts are made where the block has met, so an event is
    shuffled once and not once a shift."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").where("user_id IS NOT NULL")
    kind = e.schema["user_id"].dataType.simpleString()
    e = e.select("user_id", "ts", "event_id", F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("bigint").cast("double").alias("b"))
    e = e.withColumn("r", F.row_number().over(order) - 1)
    blocks = e.groupBy("user_id", F.floor(F.col("r") / SHIFTED).alias("block")).agg(F.array_sort(F.collect_list(F.struct("r", "a", "b"))).alias("s"))
    blocks = blocks.select("user_id", "block", F.size("s").cast("long").alias("n"), F.transform("s", lambda s: s["a"]).alias("a"), F.transform("s", lambda s: s["b"]).alias("b"))
    rows = blocks.mapInArrow(shifted, f"user_id {kind}, block long, n long, observed double, above long")
    p_value = F.when(F.col("observed").isNotNull(), F.round((1 + F.col("above")).cast("double") / F.col("n"), 6))
    return rows.select("user_id", "block", "n", F.round("observed", 6).alias("observed"), "above", p_value.alias("p_value"))


QUERIES |= {"q_cyclic_shift_null": q_cyclic_shift_null}
