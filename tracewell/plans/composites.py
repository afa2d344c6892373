"""Passes that compose single steps: scores to peaks to geometry to matches, control variants, nulls, ledger round trips."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import kernels
from tracewell.operators.chunks import bounded_batches
from tracewell.operators.matching import matched_sides, optimal_match, select_peaks
from tracewell.operators.quantiles import quantiles
from tracewell.plans.recordings import samples
from tracewell.session import table
from tracewell.sources import ledger
from tracewell.streaming.windows import folder_of

REACH, SEPARATION, TOLERANCE = 4, 4.0, 2.0
STRATA = (("click", "view"), ("click", "error"), ("view", "purchase"), ("error", "signup"))
TOLERANCES = (600.0, 3600.0, 7200.0)
BLOCK = 40


def seconds(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


#: The two views of a recording, columns of a row each.
VIEWS = ("value", "props")


def places(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, event_id, ts, k, value, props: recordings with both views of each event in time order."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("props"))
    return e.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


def stacked(rows: DataFrame, *names: str) -> DataFrame:
    """user_id, view, k and names: a row for each view; of a name's columns `name_view` each takes its own."""
    each = F.array(*(F.struct(F.lit(v).alias("view"), *(F.col(f"{n}_{v}").alias(n) for n in names)) for v in VIEWS))
    return rows.select("user_id", "k", F.explode(each).alias("_v")).select("user_id", "_v.view", "k", *(f"_v.{n}" for n in names))


def views(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, view, k, x: two views of each recording's events in time order."""
    return stacked(places(spark, sf).withColumnsRenamed({v: f"x_{v}" for v in VIEWS}), "x")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, k, and for each view x_view and score_view; path: the sum of steps around a place, as q_transition_geometry has it.

    Both views are columns of one row, so all that asks for scores reads one shuffle of the events.
    """
    e = places(spark, sf)
    x = table(spark, sf, "events").select("user_id", "value", F.get_json_object("props", "$.k").cast("double").alias("props")).where("user_id % 2 = 0")
    spread = quantiles(x, {f"{end}_{v}": (F.col(v), share) for v in VIEWS for end, share in (("q1", 0.25), ("q3", 0.75))})
    spread = spread.select(*((F.col(f"q3_{v}") - F.col(f"q1_{v}")).alias(f"spread_{v}") for v in VIEWS))
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    sides, near = [by.rowsBetween(-REACH, -1), by.rowsBetween(0, REACH - 1)], by.rowsBetween(-2, 2)
    e = e.withColumns({f"change_{v}": F.when((F.count(v).over(sides[0]) == REACH) & (F.count(v).over(sides[1]) == REACH), F.abs(F.avg(v).over(sides[1]) - F.avg(v).over(sides[0]))) for v in VIEWS})
    e = e.withColumn("step", F.abs(F.col("value") - F.lag("value").over(by))).withColumn("inside", (F.col("k") > 3) & F.lead("k", 2).over(by).isNotNull())
    e = e.withColumn("path", F.when(F.col("inside"), F.round(F.sum("step").over(near), 9)))
    score = lambda v: (F.col(f"change_{v}") / F.nullif(F.col(f"spread_{v}"), F.lit(0.0))).alias(f"score_{v}")
    return e.join(F.broadcast(spread)).select("user_id", "ts", "event_id", "k", "path", *(F.col(v).alias(f"x_{v}") for v in VIEWS), *map(score, VIEWS))


def peaks_of(scores: DataFrame) -> DataFrame:
    """user_id, view, k, path, score: of the places of `scored` rows that stand out, those that are far enough apart."""
    least = quantiles(scores, {f"least_{v}": (F.when(F.col("user_id") % 2 == 0, F.col(f"score_{v}")), 0.8) for v in VIEWS})
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = {f"{side}_{v}": F.coalesce(f(f"score_{v}").over(by), F.lit(-1.0)) for v in VIEWS for side, f in (("left", F.lag), ("right", F.lead))}
    top = lambda v: F.expr(f"score_{v} >= least_{v} AND score_{v} > left_{v} AND score_{v} >= right_{v}")
    tops = scores.withColumns(ahead).join(F.broadcast(least)).withColumns({f"top_{v}": top(v) for v in VIEWS}).where("top_value OR top_props")
    tops = stacked(tops.withColumns({f"path_{v}": F.col("path") for v in VIEWS}), "path", "score", "top").where("top").drop("top")
    return select_peaks(tops, ["user_id", "view"], "k", "score", SEPARATION)


def boundary_peaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(scores, peaks): the change of the mean at each place, scaled by the view's spread, and the places that stand out.

    Scale and threshold of a view come from even recordings alone. A place without REACH valid samples on both sides has
    no score.
    """
    rows = scored(spark, sf)
    return stacked(rows, "x", "score"), peaks_of(rows).select("user_id", "view", "k", "score")


def agreement(matched: Column, a: Column, b: Column) -> Column:
    """F1 of a one-to-one matching; 1 where both sides are empty."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.round(2.0 * matched / F.nullif(a + b, F.lit(0)), 9))


def q_evaluate_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording: scored places and peaks of each view, the peaks' mean path length, and how the views' peaks match."""
    scores = scored(spark, sf)
    counts = scores.groupBy("user_id").agg(*(F.count(f"score_{v}").alias(f"scored_{v}") for v in VIEWS))
    side = F.when(F.col("view") == VIEWS[0], 0).otherwise(1)
    peaks = peaks_of(scores).select("user_id", F.col("k").cast("double").alias("_t"), F.struct("k", "path").alias("_key"), side.alias("_side"))
    found = matched_sides(peaks, ["user_id"], TOLERANCE, every=True).groupBy("user_id").agg(
        F.count("a_key").alias("peaks_value"), F.count("b_key").alias("peaks_props"), F.round(F.avg("a_key.path"), 6).alias("mean_path"),
        F.count("lag").alias("matched"), F.round(F.percentile(F.abs("lag"), 0.5), 6).alias("median_error"),
    )
    rows = counts.join(found, "user_id", "left").fillna(0, ["peaks_value", "peaks_props", "matched"])
    return rows.withColumn("f1", agreement(F.col("matched"), F.col("peaks_value"), F.col("peaks_props")))


def q_record_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording and view: valid share, median against the even recordings' centre and spread, peaks a scored minute."""
    scores, peaks = boundary_peaks(spark, sf)
    x = views(spark, sf)
    reference = x.where("user_id % 2 = 0").groupBy("view").agg(F.percentile("x", 0.5).alias("centre"), (F.percentile("x", 0.75) - F.percentile("x", 0.25)).alias("spread"))
    rows = scores.groupBy("user_id", "view").agg(F.count("*").alias("windows"), F.count("x").alias("valid"), F.percentile("x", 0.5).alias("median"), F.count("score").alias("scored"))
    rows = rows.join(peaks.groupBy("user_id", "view").agg(F.count("*").alias("peaks")), ["user_id", "view"], "left").fillna(0, ["peaks"]).join(F.broadcast(reference), "view")
    return rows.select(
        "user_id", "view", "windows", F.round(F.col("valid") / F.col("windows"), 9).alias("valid_share"),
        F.round((F.col("median") - F.col("centre")) / F.nullif(F.col("spread"), F.lit(0.0)), 9).alias("standardized_median"),
        "scored", "peaks", F.round(60.0 * F.col("peaks") / F.nullif(F.col("scored"), F.lit(0)), 9).alias("peaks_per_minute"),
    )


def q_native_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording, stratum and tolerance: events of both kinds, their best one-to-one matches, F1, and total lag."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", seconds().alias("t"))
    sides = []
    for side in (0, 1):
        kinds = F.array(*(F.struct(F.lit(f"{a}:{b}").alias("stratum"), F.lit((a, b)[side]).alias("kind")) for a, b in STRATA))
        sides.append(e.select("user_id", "event_id", "t", "event_type", F.explode(kinds).alias("s")).where("event_type = s.kind").select(F.col("s.stratum").alias("stratum"), "user_id", "event_id", "t"))
    keys = ["stratum", "user_id"]
    counts = sides[0].groupBy(*keys).agg(F.count("*").alias("n_a")).join(sides[1].groupBy(*keys).agg(F.count("*").alias("n_b")), keys, "full").fillna(0)
    out = []
    for tolerance in TOLERANCES:
        pairs = optimal_match(*sides, keys, "t", "event_id", tolerance).groupBy(*keys).agg(F.count("*").alias("matched"), F.round(F.sum(F.abs("lag")), 6).alias("total_lag"))
        out.append(counts.join(pairs, keys, "left").fillna(0).withColumn("tolerance", F.lit(tolerance)))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("f1", agreement(F.col("matched"), F.col("n_a"), F.col("n_b")))


def q_detector_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as truth, views as detections: matched, missed and extra in each recording's interior, edges censored.

    Pairs across the interior's edge count for neither side: their inner event is censored. So truth less censored truth
    is matched and missed, and detections less censored ones are matched and extra (`reconciled`).
    """
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", seconds().alias("t"))
    ends = e.groupBy("user_id").agg((F.min("t") + 43_200).alias("lo"), (F.max("t") - 43_200).alias("hi"))
    e = e.join(ends, "user_id").withColumn("core", (F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
    truth, seen = (e.where(F.col("event_type") == kind) for kind in ("click", "view"))
    pairs = optimal_match(truth.select("user_id", "event_id", "t"), seen.select("user_id", "event_id", "t"), ["user_id"], "t", "event_id", 7200.0)
    core = e.select("event_id", "core")
    pairs = pairs.join(core.toDF("a_key", "a_core"), "a_key").join(core.toDF("b_key", "b_core"), "b_key")
    n = lambda c, name: F.sum(F.expr(c).cast("int")).cast("long").alias(name)
    pairs = pairs.groupBy("user_id").agg(
        n("a_core AND b_core", "matched"), n("a_core AND NOT b_core", "edge_truth"), n("b_core AND NOT a_core", "edge_detected"),
        F.round(F.avg(F.when(F.col("a_core") & F.col("b_core"), F.col("lag"))), 6).alias("bias"),
    )
    rows = e.groupBy("user_id").agg(n("core AND event_type = 'click'", "core_truth"), n("core AND event_type = 'view'", "core_detected"))
    rows = rows.join(pairs, "user_id", "left").fillna(0, ["matched", "edge_truth", "edge_detected"])
    rows = rows.withColumns({"missed": F.expr("core_truth - edge_truth - matched"), "extra": F.expr("core_detected - edge_detected - matched")})
    return rows.withColumn("reconciled", F.expr("missed >= 0 AND extra >= 0"))


def q_prepared_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """Every block of 28 vectors: rank correlation of vector and label distances, of the originals and of vectors with random phases.

    The pairs that take part are fixed before any value is seen; a block abstains, with a reason, if it has too few.
    """
    v = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 28).alias("block"), "label", F.col("embedding").cast("array<double>").alias("x"))

    def ranks(d: np.ndarray) -> np.ndarray:
        return pd.Series(d).rank().to_numpy()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        block, x = int(part["block"].iloc[0]), np.stack([np.asarray(r, float) for r in part["x"]])
        i, j = np.triu_indices(len(x), 1)
        e = np.abs(part["label"].to_numpy(float)[i] - part["label"].to_numpy(float)[j])
        rho = []
        for y in (x, kernels.phase_surrogate(x, 12012 + block)):
            unit = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            d = 1 - np.einsum("nd,nd->n", unit[i], unit[j])
            rho.append(float(np.corrcoef(ranks(d), ranks(e))[0, 1]) if len(d) >= 28 and np.ptp(d) > 0 and np.ptp(e) > 0 else None)
        reason = "INSUFFICIENT_SUPPORT" if len(i) < 28 else "CONSTANT_DISTANCE_VECTOR" if None in rho else None
        a, b = rho if reason is None else (None, None)
        return pd.DataFrame({"block": [block], "pairs": [len(i)], "original": [a], "phase": [b], "effect": [None if reason else round(a - b, 9)], "reason": [reason]}).astype({"original": float, "phase": float, "effect": float})

    return v.where("x IS NOT NULL AND label IS NOT NULL").groupBy("block").applyInPandas(run, "block long, pairs long, original double, phase double, effect double, reason string")


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, block, x, reason: every block of BLOCK places of a recording. A null sample keeps its place.

    reason: MISSING_SAMPLE (the block has a null), INCOMPLETE_BLOCK (the recording ends in it), null if it can be used.
    """
    bounded_batches(spark)
    rows = samples(spark, sf).groupBy("user_id", F.floor(F.col("k") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    x = F.transform("s", lambda s: s["value"])
    reason = F.when(F.exists(x, lambda v: v.isNull() | F.isnan(v)), "MISSING_SAMPLE").when(F.size("s") < BLOCK, "INCOMPLETE_BLOCK")
    return rows.select("user_id", "block", x.alias("x"), reason.alias("reason"))


def q_control_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every block (four channels) under every control: root mean square, likeness to the original, changed and valid samples.

    A block that can't be used has one row with its reason.
    """
    names = ["user_id", "block", "variant", "rms", "likeness", "changed", "valid", "reason"]

    def run(batches):
        for batch in batches:
            rows = []
            for user, block, x, reason in zip(batch["user_id"], batch["block"], batch["x"], batch["reason"], strict=True):
                if reason is not None:
                    rows.append((user, block, None, None, None, None, None, reason))
                    continue
                own = np.asarray(x, float).reshape(4, -1)
                for name in kernels.CONTROLS:
                    y, valid = kernels.control(own, name, int(user) * 1009 + int(block))
                    a, b = own[valid] - own[valid].mean(), y[valid] - y[valid].mean()
                    like = float((a * b).sum() / max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-12))
                    rows.append((user, block, name, round(float(np.sqrt((y[valid] ** 2).mean())), 6), round(like, 6), int((y != own)[valid].sum()), int(valid.sum()), None))
            yield pd.DataFrame(rows, columns=names).astype({"rms": float, "likeness": float, "changed": "Int64", "valid": "Int64"})

    return blocks_of(spark, sf).mapInPandas(run, "user_id long, block long, variant string, rms double, likeness double, changed long, valid long, reason string")


def q_token_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every block: its features by waveform, spectrum, and time and frequency, as one row each, or one row with the reason why not."""
    names = ["user_id", "block", "method", "width", "features", "reason"]

    def run(batches):
        for batch in batches:
            bad = batch[batch["reason"].notna()]
            if len(bad):
                yield bad.assign(method=None, width=None, features=None)[names].astype({"width": "Int32"})
            good = batch[batch["reason"].isna()]
            if len(good):
                x = np.stack([np.asarray(v, float) for v in good["x"]])
                for method in kernels.FEATURES:
                    f = np.round(kernels.token_features(x, method, 20.0), 6)
                    yield pd.DataFrame({"user_id": good["user_id"], "block": good["block"], "method": method, "width": f.shape[1], "features": list(f), "reason": None})

    return blocks_of(spark, sf).mapInPandas(run, "user_id long, block long, method string, width int, features array<double>, reason string")


def q_filter_support(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording: the samples that the filters leave beyond their support at both ends; none where it is too short."""
    guard = kernels.filter_support(np.vstack([kernels.butterworth_sos(2, 5.0, 40.0, 100.0)]), 100.0, smoothing=3)
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("value").alias("samples"))
    usable = F.col("samples") - 2 * F.lit(guard)
    if guard is None:
        return rows.select("user_id", "samples", F.lit(None).cast("int").alias("guard"), F.lit(0).cast("long").alias("usable"), F.lit("FILTER_SUPPORT_UNRESOLVED").alias("reason"))
    return rows.select("user_id", "samples", F.lit(guard).alias("guard"), F.greatest(usable, F.lit(0)).cast("long").alias("usable"), F.when(usable <= 0, "SHORT_SUPPORT").alias("reason"))


def q_label_null(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted Rand index of two labellings and its distribution over 100 permutations of one of them.

    A permutation only changes the contingency table, which then is a random one with the same margins; so a draw costs
    its cells, not its rows, and tasks take the draws.
    """
    rows = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("code")).count().toPandas()  # labels x codes
    counts = rows.pivot(index="event_type", columns="code", values="count").fillna(0).to_numpy().astype(int)

    def draw(batches):
        for batch in batches:
            found = []
            for n in batch["id"]:
                rng, left, drawn = np.random.default_rng([9001, int(n)]), counts.sum(0), []
                for total in counts.sum(1)[:-1]:
                    drawn.append(rng.multivariate_hypergeometric(left, int(total), method="marginals"))
                    left = left - drawn[-1]
                found.append(kernels.adjusted_rand(np.array([*drawn, left])))
            yield pd.DataFrame({"draw": batch["id"], "ari": found})

    nulls = spark.range(0, 100, 1, 10).mapInPandas(draw, "draw long, ari double")
    at = lambda p, name: F.round(F.percentile("ari", p), 12).alias(name)
    observed = round(kernels.adjusted_rand(counts), 12)
    return nulls.agg(F.count("*").alias("draws"), at(0.025, "low"), at(0.5, "middle"), at(0.975, "high")).withColumn("observed", F.lit(observed))


def q_ledger_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a ledger, read again, and compared with themselves in both directions, by partition."""
    rows = table(spark, sf, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    folder, part = folder_of(spark), F.col("user_id") % 8
    ledger.write_ledger(rows, folder, part)
    found, audit = ledger.read_ledger(spark, folder, rows.schema)
    found = found.select(*rows.columns)
    missing, extra = (x.exceptAll(y).groupBy(part.cast("int").alias("part")).agg(F.count("*").alias(n)) for x, y, n in ((rows, found, "missing"), (found, rows, "extra")))
    return audit.join(missing, "part", "left").join(extra, "part", "left").fillna(0, ["missing", "extra"])


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as gzip CSV (texts hold quotes, commas and line ends) and back: rows, and what differs in either direction."""
    rows = table(spark, sf, "conversations")
    folder = folder_of(spark)
    ledger.write_csv(rows, folder)
    found = ledger.read_csv(spark, folder, rows.schema)
    lost, new = rows.exceptAll(found), found.exceptAll(rows)
    every = rows.select("role", F.lit("rows").alias("what")).unionByName(lost.select("role", F.lit("missing").alias("what"))).unionByName(new.select("role", F.lit("extra").alias("what")))
    n = lambda w: F.count(F.when(F.col("what") == w, 1)).alias(w if w != "rows" else "rows_n")
    return every.groupBy("role").agg(n("rows"), n("missing"), n("extra"))


def q_array_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as float32 frames and as NumPy archives, a file each, and read again: their length, sum and checks."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(F.floor(F.col("vec_id") / 50).alias("key"), F.col("vec_id"), "embedding")
    arrays = rows.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])).alias("values"))
    out = []
    for kind in ("frames", "npz"):
        folder = folder_of(spark)
        path = f"{folder}-written"
        ledger.write_arrays(arrays, folder, kind).write.parquet(path)
        back = ledger.read_arrays(spark, folder, kind).join(spark.read.parquet(path).select("key", F.col("crc32").alias("written")), "key", "full")
        total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
        out.append(back.select("key", F.lit(kind).alias("kind"), F.size("values").alias("n"), F.round(total, 3).alias("total"), F.col("crc32").eqNullSafe(F.col("written")).alias("same"), "reason"))
    return reduce(DataFrame.unionByName, out)



NAMES = (
    "q_evaluate_arrays q_record_metrics q_native_matches q_detector_scores q_prepared_comparisons q_control_variants q_token_features q_filter_support "
    "q_label_null q_ledger_roundtrip q_csv_roundtrip q_array_roundtrip"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}
ORACLES = {
    "q_ledger_roundtrip": "SELECT CAST(user_id % 8 AS integer) AS part, count(*) AS declared, count(*) AS found, 'OK' AS status, 0 AS missing, 0 AS extra FROM events GROUP BY user_id % 8",
    "q_csv_roundtrip": "SELECT role, count(*) AS rows_n, 0 AS missing, 0 AS extra FROM conversations GROUP BY role",
    "q_array_roundtrip": """
WITH v AS (SELECT vec_id // 50 AS key, len(embedding) AS n, list_sum(CAST(embedding AS double[])) AS s FROM embeddings WHERE embedding IS NOT NULL)
SELECT key, kind, CAST(sum(n) AS integer) AS n, round(sum(s), 3) AS total, true AS same, CAST(NULL AS varchar) AS reason FROM v CROSS JOIN (VALUES ('frames'), ('npz')) AS k(kind) GROUP BY key, kind""",
}
