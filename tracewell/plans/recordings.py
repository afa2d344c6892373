"""Kernels over recordings: samples of events in chunks with halos, cut at gaps; oscillation events; the bootstrap of medians.

A recording is a user's events in time order, one channel at RATE samples a second. A null value is a gap. Recordings and
runs that are too short for a kernel have rows that say so.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import chunks, kernels, oscillations
from tracewell.operators.chunks import Run, each_sample, each_window, on_chunks
from tracewell.session import table

RATE = 250.0
WIDTH, HOP = 30, 10
#: Bands that recordings of some tens of samples hold three cycles of; the operator's own are those of its definition.
BANDS = ((40.0, 60.0), (60.0, 80.0), (80.0, 110.0))
#: How far, in samples, a landmark's flanks are followed.
FLANK = 256
SLOPE_GATE, FLANK_GATE, GUARD = 100.0, 2.0, 5


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, k, value: all events of a recording (user) in time order, nulls too."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return chunks.places(e, "user_id", ["us", "event_id"], F.floor(F.col("us") / 86_400_000_000)).select("user_id", "k", "value")


def chunked(spark: SparkSession, sf: str, halo: int, size: int = chunks.SIZE) -> DataFrame:
    return chunks.chunked(samples(spark, sf), "user_id", "k", "value", halo, size)


def rounded(values: list[np.ndarray], digits: tuple[int, ...]) -> list[np.ndarray]:
    return [np.round(v, d) for v, d in zip(values, digits, strict=True)]


def q_halo_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over eleven samples, in cents, from chunks of sixteen: as if recordings were whole."""
    work = lambda signals: [[np.convolve(np.round(x * 100), np.ones(11), "full")[5 : 5 + len(x)].astype(np.int64)] for x in signals]
    return on_chunks(chunked(spark, sf, 5, 16), "user_id", each_sample(work, ["total"]), "total long", 1, 16, missing=True)


def filter_sections() -> list[np.ndarray]:
    return [kernels.butterworth_sos(4, 1.0, 40.0, RATE), kernels.notch_sos(60.0, 30.0, RATE)]


@cache
def filter_reach() -> int:
    """Samples over which the filters' responses die away, one after the other."""
    return sum(kernels.filter_support(s, RATE, longest=20.0, least=1e-12) for s in filter_sections())


def zero_phase(signals: list[np.ndarray]) -> list[list[np.ndarray]]:
    for sections in filter_sections():
        signals = kernels.zero_phase_each(sections, signals)
    return [[np.round(y, 6)] for y in signals]


def q_filter_zero_phase(spark: SparkSession, sf: str) -> DataFrame:
    return on_chunks(chunked(spark, sf, filter_reach()), "user_id", each_sample(zero_phase, ["filtered"]), "filtered double", 1, missing=True)


def q_periodogram(spark: SparkSession, sf: str) -> DataFrame:
    """Log power by bands of 2 Hz of windows, padded to four seconds."""
    low = np.arange(1, 39, 2)

    def work(x: np.ndarray) -> list:
        f, p = kernels.periodogram(x, RATE, int(4 * RATE))
        power = np.stack([p[:, (f >= lo) & (f < lo + 2)].sum(1) * (f[1] - f[0]) for lo in low], 1)
        return [list(np.round(np.log10(power + 1e-12), 6))]

    rows = on_chunks(chunked(spark, sf, WIDTH + HOP), "user_id", each_window(work, ["powers"], WIDTH, HOP), "first long, powers array<double>", WIDTH + HOP - 1)
    bands = F.array(*(F.lit(int(lo)) for lo in low))
    each = F.explode_outer(F.arrays_zip(bands.alias("band"), F.col("powers").alias("log_power"))).alias("b")
    return rows.select("user_id", "first", "reason", each).select("user_id", "first", "b.band", "b.log_power", "reason")


def q_savgol(spark: SparkSession, sf: str) -> DataFrame:
    def work(signals: list[np.ndarray]) -> list[list[np.ndarray]]:
        return [rounded([kernels.savitzky_golay(x, 7, 3, d, 1 / RATE) for d in (1, 2)], (4, 1)) for x in signals]

    return on_chunks(chunked(spark, sf, 7), "user_id", each_sample(work, ["slope", "curvature"]), "slope double, curvature double", 7, missing=True)


def q_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Four samples for five: place m stands at 1.25 m, on one grid for the whole recording."""
    up, down = 4, 5

    def kernel(runs: list[Run]) -> list[dict[str, np.ndarray]]:
        out = []
        for r in runs:
            pad = r.first % down  # the grid begins at a multiple of `down`
            y = kernels.resample(np.concatenate([np.zeros(pad), r.x]), up, down)
            m = (r.first - pad) // down * up + np.arange(len(y))
            inside = m * down >= r.first * up
            out.append({"k2": (2 * m * down // up)[inside], "m": m[inside], "value": np.round(y[inside], 6)})
        return out

    return on_chunks(chunked(spark, sf, 16), "user_id", kernel, "m long, value double", 1)


def q_view_features(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of each window, and how its five parts go together as channels."""
    names = "log_rms log_mobility complexity lag_correlation correlation_median correlation_iqr correlation_size lead_share effective_rank".split()

    def work(x: np.ndarray) -> list:
        if not len(x):
            return [np.zeros(0)] * len(names)
        every = np.concatenate([kernels.morphology(x, RATE), kernels.coordination(x.reshape(len(x), 5, -1))], 1)
        return list(np.round(every, 6).T)

    schema = "first long, " + ", ".join(f"{n} double" for n in names)
    return on_chunks(chunked(spark, sf, WIDTH + HOP), "user_id", each_window(work, names, WIDTH, HOP), schema, WIDTH + HOP - 1)


def q_phase_surrogate(spark: SparkSession, sf: str) -> DataFrame:
    """Each window with random phases: how its mean moves, and whether its spectrum stays."""

    def work(x: np.ndarray) -> list:
        y = np.stack([kernels.phase_surrogate(w[None], 610 + len(w))[0] for w in x]) if len(x) else x
        drift = np.abs(np.abs(np.fft.rfft(x)) - np.abs(np.fft.rfft(y))).max(1, initial=0)
        return [np.round(y.mean(1) - x.mean(1), 6) + 0.0, drift < 1e-6 * np.maximum(1, np.abs(x).max(1, initial=0)) * x.shape[1]]

    return on_chunks(chunked(spark, sf, WIDTH + HOP), "user_id", each_window(work, ["mean_change", "spectrum_kept"], WIDTH, HOP), "first long, mean_change double, spectrum_kept boolean", WIDTH + HOP - 1)


LANDMARK = "family string, place double, kind string, support_start long, support_stop long, steepness double, flank double, accepted boolean, reasons array<string>"


def landmarks(runs: list[Run]) -> list[dict[str, np.ndarray]]:
    """Extrema (the slope changes sign) and inflections (the curvature does) of runs, each with all gates that it fails.

    Gates: samples of one sign on both sides; the filter's reach at both ends; a slope (curvature) of at least SLOPE_GATE on
    both flanks; for extrema, a rise and fall of at least FLANK_GATE within the support, which is how far the signs hold,
    FLANK samples at most.
    """
    out = []
    for r in runs:
        x, rows = r.x, []
        for family, order in (("extremum", 1), ("inflection", 2)):
            d = kernels.savitzky_golay(x, 7, 3, order, 1 / RATE)
            sign = np.sign(d)
            changes = np.flatnonzero(np.diff(sign)) + 1  # where a stretch of one sign begins
            for index, place, held in kernels.crossings(d, dead=1e-9):
                left = max(int(changes[np.searchsorted(changes, index - 1, "right") - 1]) if (changes <= index - 1).any() else 0, index - FLANK, 0)
                after = np.searchsorted(changes, index, "right")
                right = min(int(changes[after]) - 1 if after < len(changes) else len(x) - 1, index + FLANK)
                steep = min(np.abs(d[left:index]).max(initial=0), np.abs(d[index : right + 1]).max(initial=0))
                flank = min(abs(x[index] - x[left]), abs(x[right] - x[index]))
                gates = (
                    (held, "INSUFFICIENT_SIGN_SUPPORT"),
                    (GUARD <= index - 1 <= len(x) - GUARD - 2, "SIGN_FLANK_FILTER_GUARD"),
                    (steep >= SLOPE_GATE, "LOW_SLOPE"),
                    (family == "inflection" or flank >= FLANK_GATE, "LOW_FLANK"),
                )
                reasons = [why for ok, why in gates if not ok]
                up = d[max(0, index - 1)] > 0
                kind = ("peak" if up else "trough") if family == "extremum" else ("curvature_positive_to_negative" if up else "curvature_negative_to_positive")
                rows.append((index + r.first, family, np.nan if place is None else place + r.first, kind, left + r.first, right + r.first, round(float(steep), 6), round(float(flank), 6), not reasons, reasons))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
        names = ["k", *(f.split()[0] for f in LANDMARK.split(", "))]
        out.append({n: np.array(c, np.int64) if n in ("k", "support_start", "support_stop") else list(c) for n, c in zip(names, columns, strict=True)})
    return out


def q_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    return on_chunks(chunked(spark, sf, 2 * FLANK), "user_id", landmarks, LANDMARK, 7)


def q_oscillation_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of every recording and band by two thresholds of its envelope, accepted or with all reasons."""
    rows = oscillations.magnitudes(chunked(spark, sf, oscillations.reach(RATE, BANDS)), "user_id", RATE, BANDS)
    found = oscillations.bursts(rows, "user_id", RATE, BANDS)
    return found.select("user_id", "band", "first", "last", F.round("peak", 6).alias("peak"), F.round("median", 6).alias("median"), "accepted", F.array_join("reasons", ",").alias("reasons"))


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return oscillations.cycles(chunked(spark, sf, oscillations.reach(RATE, BANDS)), "user_id", RATE, BANDS)


def q_oscillation_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Every cycle of every recording and band: places, features, whether it is in a burst, and all reasons."""
    numbers = ("height", "amplitude_fraction", "amplitude_consistency", "period_consistency", "monotonicity")
    places = ("rise_middle", "peak", "decay_middle", "stop")
    return cycles(spark, sf).select("user_id", "band", "k", *places, *(F.round(c, 6).alias(c) for c in numbers), "in_burst", "accepted", F.array_join("reasons", ",").alias("reasons"))


def q_cycle_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of at least three cycles that touch and pass all thresholds."""
    return oscillations.cycle_bursts(cycles(spark, sf), "user_id").withColumn("reasons", F.array_join("reasons", ","))


def q_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """The middle 95 % of 1,000 bootstrap medians of each recording.

    The median of n draws with replacement is the value, or the mean of the values, at the ranks where the middle order
    statistics of n uniform numbers fall. So a draw takes two numbers, whatever n, and only values at drawn ranks are read.
    """
    values = table(spark, sf, "events").where("value IS NOT NULL").select("user_id", "value")
    everyone = table(spark, sf, "events").groupBy("user_id").agg(F.count("value").alias("n"))

    def draw(batches):
        for batch in batches:
            for user, n in zip(batch["user_id"].tolist(), batch["n"].tolist(), strict=True):
                rng, m = np.random.default_rng([17, user]), (n + 1) // 2
                low = rng.beta(m, n - m + 1, 1000)
                high = low if n % 2 else low + (1 - low) * (1 - rng.random(1000) ** (1 / (n - m)))
                ranks = np.minimum(np.floor(np.stack([low, high]) * n).astype(np.int64), n - 1)
                pairs, times = np.unique(ranks, axis=1, return_counts=True)
                yield pd.DataFrame({"user_id": user, "a": pairs[0], "b": pairs[1], "times": times})

    pairs = everyone.where("n > 1").mapInPandas(draw, "user_id long, a long, b long, times long")
    ranked = values.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("value")) - 1)
    side = lambda r, v: ranked.select("user_id", F.col("rank").cast("long").alias(r), F.col("value").alias(v))
    drawn = pairs.join(side("a", "x"), ["user_id", "a"]).join(side("b", "y"), ["user_id", "b"])
    at = lambda p: F.round(F.percentile((F.col("x") + F.col("y")) / 2, F.lit(p), F.col("times")), 6)
    return everyone.join(drawn.groupBy("user_id").agg(at(0.025).alias("low"), at(0.975).alias("high")), "user_id", "left")


NAMES = (
    "q_halo_chunks q_filter_zero_phase q_periodogram q_savgol q_resample q_view_features q_phase_surrogate q_landmarks q_oscillation_bursts "
    "q_oscillation_cycles q_cycle_bursts q_bootstrap_ci"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}

_RUNS = """e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
g AS (SELECT user_id, k, value, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS run FROM e WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id, run) AS n, min(k) OVER (PARTITION BY user_id, run) AS run_first, max(k) OVER (PARTITION BY user_id, run) AS run_last
  FROM g WINDOW w AS (PARTITION BY user_id, run ORDER BY k))"""


def savgol_sql() -> str:
    """The fit as weights of seven samples for each place in their window."""
    unit = np.eye(7)
    rows = [[kernels.savitzky_golay(unit[j], 7, 3, d, 1 / RATE) for d in (1, 2)] for j in range(7)]
    weights = ", ".join(f"({t}, {j}, {float(rows[j][0][t])!r}, {float(rows[j][1][t])!r})" for t in range(7) for j in range(7))
    return f"""
WITH {_RUNS}, w(t, j, w1, w2) AS (VALUES {weights}),
p AS (SELECT user_id, run, k, n, greatest(0, least(i - 3, n - 7)) AS s, i FROM r WHERE n >= 7),
v AS (SELECT p.user_id, p.k, sum(w1 * r.value) AS a, sum(w2 * r.value) AS b FROM p JOIN r ON r.user_id = p.user_id AND r.run = p.run AND r.i BETWEEN p.s AND p.s + 6 JOIN w ON w.t = p.i - p.s AND w.j = r.i - p.s GROUP BY p.user_id, p.k)
SELECT e.user_id, e.k, round(v.a, 4) AS slope, round(v.b, 1) AS curvature, CASE WHEN e.value IS NULL THEN 'MISSING_SAMPLE' WHEN v.k IS NULL THEN 'SHORT_SUPPORT' END AS reason
FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.k = e.k"""


def bursts_sql() -> str:
    taps, bands = [], []
    for b, (lo, hi) in enumerate(BANDS):
        f = oscillations.band_kernel(RATE, lo, hi)
        taps += [f"({b}, {o}, {float(c.real)!r}, {float(c.imag)!r})" for o, c in zip(range(-(len(f) // 2), len(f) // 2 + 1), f, strict=True)]
        bands.append(f"({b}, {len(f)}, {oscillations.CYCLES * RATE / lo!r})")
    return f"""
WITH {_RUNS}, f(band, o, re, im) AS (VALUES {", ".join(taps)}), s(band, taps, floor) AS (VALUES {", ".join(bands)}),
m AS (SELECT r.user_id, r.run, s.band, r.k, r.run_first, r.run_last, sqrt(power(sum(f.re * q.value), 2) + power(sum(f.im * q.value), 2)) AS magnitude
  FROM r JOIN s ON r.n > s.taps JOIN f ON f.band = s.band JOIN r AS q ON q.user_id = r.user_id AND q.run = r.run AND q.k = r.k - f.o GROUP BY r.user_id, r.run, s.band, r.k, r.run_first, r.run_last),
d AS (SELECT user_id, band, quantile_cont(magnitude, 0.5) AS median FROM m GROUP BY user_id, band),
h AS (SELECT m.*, d.median, m.k - row_number() OVER (PARTITION BY m.user_id, m.band ORDER BY m.k) AS island FROM m JOIN d ON d.user_id = m.user_id AND d.band = m.band WHERE d.median > 0 AND m.magnitude >= d.median),
b AS (SELECT user_id, band, min(k) AS first, max(k) AS last, max(magnitude) AS peak, max(median) AS median, min(run_first) AS run_first, max(run_last) AS run_last FROM h GROUP BY user_id, band, island HAVING max(magnitude) >= 2 * max(median)),
w AS (SELECT b.*, concat_ws(',', CASE WHEN last - first + 1 < s.floor THEN 'SHORT_DURATION' END, CASE WHEN first - run_first < s.taps // 2 OR run_last - last < s.taps // 2 THEN 'CENSORED_GUARD_BOUNDARY' END) AS reasons FROM b JOIN s ON s.band = b.band)
SELECT user_id, band, first, last, round(peak, 6) AS peak, round(median, 6) AS median, reasons = '' AS accepted, reasons FROM w
UNION ALL SELECT u.user_id, s.band, NULL, NULL, NULL, d.median, false, CASE WHEN d.median IS NULL THEN 'UNSUPPORTED_SHORT_RUN' ELSE 'DEGENERATE_NORMALIZATION' END
FROM (SELECT DISTINCT user_id FROM events) AS u CROSS JOIN s LEFT JOIN d ON d.user_id = u.user_id AND d.band = s.band WHERE d.median IS NULL OR d.median <= 0"""


ORACLES = {
    "q_halo_chunks": f"""
WITH {_RUNS}, t AS (SELECT user_id, k, sum(CAST(round(value * 100) AS bigint)) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS total FROM r)
SELECT e.user_id, e.k, CAST(t.total AS bigint) AS total, CASE WHEN e.value IS NULL THEN 'MISSING_SAMPLE' END AS reason FROM e LEFT JOIN t ON t.user_id = e.user_id AND t.k = e.k""",
    "q_savgol": savgol_sql(),
    "q_oscillation_bursts": bursts_sql(),
}
