"""Oscillation events: bursts of an analytic envelope by two thresholds, and cycles with their contiguous groups.

Envelope: the size of a run's convolution with an analytic band-pass (a windowed band-pass and its quadrature), so its
reach is half a kernel. Bursts: samples of at least `low` times the recording's median envelope that hang together and of
which one reaches `high` times the median. Cycles: from trough to trough of the samples, where the band-passed signal's
changes of sign say between which places to look; flanks are cut where they cross their half height. A cycle is in a burst
if its amplitude, its likeness to its neighbours and its flanks pass their thresholds, in groups of cycles that touch.

Everything that is rejected stays, with all of its reasons.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import chunks
from tracewell.operators.chunks import Run

#: Bands in hertz, cycles of the lowest frequency that a kernel spans and a burst lasts, factors of the median.
BANDS = ((4.0, 8.0), (8.0, 13.0), (13.0, 30.0))
CYCLES, LOW, HIGH = 3, 1.0, 2.0
#: What a cycle in a burst exceeds, and how many of them make one.
AMPLITUDE_FRACTION, AMPLITUDE_CONSISTENCY, PERIOD_CONSISTENCY, MONOTONICITY, LEAST_CYCLES = 0.3, 0.4, 0.5, 0.8, 3

Bands = tuple[tuple[float, float], ...]


def band_kernel(rate: float, low: float, high: float, cycles: float = CYCLES) -> np.ndarray:
    """Analytic band-pass, an odd number of complex taps: the real part passes the band with a gain of 1 at its middle."""
    half = int(np.ceil(cycles * rate / low)) // 2
    t = np.arange(-half, half + 1) / rate
    turn = lambda f: 2 * np.pi * f * t
    safe = np.where(t == 0, 1.0, np.pi * t)
    real = np.where(t == 0, 2 * (high - low), (np.sin(turn(high)) - np.sin(turn(low))) / safe)
    imaginary = np.where(t == 0, 0.0, (np.cos(turn(low)) - np.cos(turn(high))) / safe)
    window = 0.54 + 0.46 * np.cos(np.pi * np.arange(-half, half + 1) / max(1, half))
    gain = abs(np.sum(real * window * np.exp(-1j * turn((low + high) / 2))))
    return (real + 1j * imaginary) * window / gain


def reach(rate: float, bands: Bands = BANDS) -> int:
    """Samples beyond a chunk that its envelopes and cycles depend on: a kernel and four cycles of the lowest frequency."""
    return max(len(band_kernel(rate, lo, hi)) + 1 + int(np.ceil(4 * rate / lo)) for lo, hi in bands)


def magnitudes(chunked: DataFrame, recording: str, rate: float, bands: Bands = BANDS, size: int = chunks.SIZE) -> DataFrame:
    """recording, k, band (its number), magnitude: the envelope at every sample of a run that is longer than the kernel;
    else a null magnitude."""
    filters = [band_kernel(rate, lo, hi) for lo, hi in bands]
    names = [f"m{b}" for b in range(len(bands))]

    def work(signals: list[np.ndarray]) -> list[list[np.ndarray]]:
        return [[np.abs(np.convolve(x, f, "same")) if len(x) > len(f) else np.full(len(x), np.nan) for f in filters] for x in signals]

    least = min(map(len, filters)) + 1
    rows = chunks.on_chunks(chunked, recording, chunks.each_sample(work, names), ", ".join(f"{n} double" for n in names), least, size, missing=True)
    stacked = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(n).alias("magnitude")) for b, n in enumerate(names)))).alias("s")
    return rows.select(recording, "k", "reason", stacked).select(recording, "k", "s.band", "s.magnitude", "reason")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median: exact, of groups of any size: values in a narrow bracket around the middle are ranked, others counted."""
    value = F.col(value)
    few = F.count(value) <= 1000
    near = lambda p, end: F.when(few, end(value)).otherwise(F.percentile_approx(value, F.lit(p), F.lit(10_000)))
    bracket = rows.groupBy(*keys).agg(F.count(value).alias("n"), near(0.48, F.min).alias("_lo"), near(0.52, F.max).alias("_hi")).where("n > 0")
    held = rows.where(value.isNotNull()).join(bracket, keys)
    below = held.groupBy(*keys).agg(F.sum((value < F.col("_lo")).cast("long")).alias("_below"))
    order = W.partitionBy(*keys).orderBy("_v")
    inside = held.where(value.between(F.col("_lo"), F.col("_hi"))).select(*keys, "n", value.alias("_v")).withColumn("_nth", F.row_number().over(order))
    ranked = inside.join(below, keys).withColumn("_rank", F.col("_nth") + F.col("_below"))
    middle = ranked.where("_rank IN ((n + 1) DIV 2, n DIV 2 + 1)")
    return middle.groupBy(*keys).agg(F.first("n").alias("n"), F.avg("_v").alias("median"))


def islands(rows: DataFrame, keys: list[str], place: str, sums: dict[str, Column], size: int = chunks.SIZE) -> DataFrame:
    """keys, first, last and the maxima `sums` of runs of consecutive places: runs within chunks, then chunks that touch."""
    cut = rows.withColumn("_chunk", F.floor(F.col(place) / size))
    inner = W.partitionBy(*keys, "_chunk").orderBy(place)
    new = lambda gap: F.coalesce(gap, F.lit(True)).cast("int")
    cut = cut.withColumn("_new", new(F.col(place) - F.lag(place).over(inner) != 1)).withColumn("_run", F.sum("_new").over(inner))
    parts = cut.groupBy(*keys, "_chunk", "_run").agg(F.min(place).alias("first"), F.max(place).alias("last"), *(F.max(c).alias(n) for n, c in sums.items()))
    outer = W.partitionBy(*keys).orderBy("first")
    parts = parts.withColumn("_new", new(F.col("first") - F.lag("last").over(outer) != 1)).withColumn("_run", F.sum("_new").over(outer))
    return parts.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *(F.max(n).alias(n) for n in sums)).drop("_run")


def bursts(rows: DataFrame, recording: str, rate: float, bands: Bands = BANDS, size: int = chunks.SIZE, low: float = LOW, high: float = HIGH) -> DataFrame:
    """recording, band, first, last, peak, median, accepted, reasons: every burst of `magnitudes` rows.

    Reasons: SHORT_DURATION (under three cycles of the band's lowest frequency), CENSORED_GUARD_BOUNDARY (within half a
    kernel of the run's ends). A band that a recording can't have bursts in has a row of its own, without places:
    UNSUPPORTED_SHORT_RUN (no run is longer than the kernel), DEGENERATE_NORMALIZATION (the median envelope is 0).
    """
    keys = [recording, "band"]
    known = rows.where("magnitude IS NOT NULL")
    middle = medians(known, keys, "magnitude")
    scored = known.join(middle.where("median > 0"), keys)
    runs = islands(known, keys, "k", {}, size).select(*keys, F.col("first").alias("run_first"), F.col("last").alias("run_last"))
    found = islands(scored.where(F.col("magnitude") >= low * F.col("median")), keys, "k", {"peak": F.col("magnitude"), "median": F.col("median")}, size)
    found = found.where(F.col("peak") >= high * F.col("median"))
    # A burst lies in the last run that begins at or before it.
    marks = runs.select(*keys, F.col("run_first").alias("first"), F.lit(0).alias("_side"), "run_first", "run_last", *(F.lit(None).cast(t).alias(c) for c, t in (("last", "long"), ("peak", "double"), ("median", "double"))))
    events = found.select(*keys, "first", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("run_first"), F.lit(None).cast("long").alias("run_last"), "last", "peak", "median")
    order = W.partitionBy(*keys).orderBy("first", "_side")
    both = marks.unionByName(events)
    both = both.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("run_first", "run_last")}).where("_side = 1")
    numbers = lambda f: F.element_at(F.array(*(F.lit(f(lo, hi)) for lo, hi in bands)), F.col("band") + 1)
    guard, floor = numbers(lambda lo, hi: len(band_kernel(rate, lo, hi)) // 2), numbers(lambda lo, hi: float(CYCLES * rate / lo))
    reasons = F.array_compact(F.array(
        F.when(F.col("last") - F.col("first") + 1 < floor, "SHORT_DURATION"),
        F.when((F.col("first") - F.col("run_first") < guard) | (F.col("run_last") - F.col("last") < guard), "CENSORED_GUARD_BOUNDARY"),
    ))
    events = both.select(*keys, "first", "last", "peak", "median", reasons.alias("reasons"))
    every = rows.groupBy(*keys).agg(F.count("magnitude").alias("n")).join(middle.select(*keys, "median"), keys, "left")
    why = F.when(F.col("n") == 0, "UNSUPPORTED_SHORT_RUN").otherwise("DEGENERATE_NORMALIZATION")
    without = every.where("n = 0 OR median <= 0").select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in (("first", "long"), ("last", "long"), ("peak", "double"))), "median", F.array(why).alias("reasons"))
    return events.unionByName(without).withColumn("accepted", F.size("reasons") == 0)


CYCLE = "band int, rise_middle long, peak long, decay_middle long, stop long, rise double, decay double, monotonicity double, inside boolean"


def cycles_of(x: np.ndarray, kernel: np.ndarray) -> dict[str, np.ndarray]:
    """Cycles of a run: places of trough, rise's middle, peak, decay's middle and next trough, heights of both flanks, and
    the share of steps that go up on the rise and down on the decay."""
    up = np.convolve(x, kernel.real, "same") >= 0
    turns = np.flatnonzero(up[1:] != up[:-1]) + 1
    ends = [(int(a), int(b)) for a, b in zip(turns[:-1], turns[1:], strict=True)]
    extrema = [(a + int(np.argmax(x[a:b])), True) if up[a] else (a + int(np.argmin(x[a:b])), False) for a, b in ends]

    def middle(a: int, b: int) -> int:
        flank = (x[a : b + 1] - (x[a] + x[b]) / 2) * (1 if x[b] >= x[a] else -1)
        over = np.flatnonzero((flank[:-1] < 0) & (flank[1:] >= 0)) + 1
        return a + int(np.median(over)) if len(over) else (a + b) // 2

    out = []
    for (left, top), (peak, _), (right, _) in zip(extrema, extrema[1:], extrema[2:], strict=False):
        if not top:
            steps = np.diff(x[left : right + 1])
            share = (np.mean(steps[: peak - left] > 0) + np.mean(steps[peak - left :] < 0)) / 2
            out.append((left, middle(left, peak), peak, middle(peak, right), right, x[peak] - x[left], x[peak] - x[right], share))
    names = ("trough", "rise_middle", "peak", "decay_middle", "stop", "rise", "decay", "monotonicity")
    made = np.array(out, float).reshape(-1, len(names)).T
    return {n: v if n in ("rise", "decay", "monotonicity") else v.astype(np.int64) for n, v in zip(names, made, strict=True)}


def cycles(chunked: DataFrame, recording: str, rate: float, bands: Bands = BANDS, size: int = chunks.SIZE) -> DataFrame:
    """recording, k (first trough), band, the places and features of every cycle, in_burst, accepted, reasons.

    Reasons: FILTER_GUARD (within half a kernel of the run's ends), UNSCORABLE_CYCLE (a neighbour doesn't touch it), then
    LOW_AMPLITUDE_FRACTION, LOW_AMPLITUDE_CONSISTENCY, LOW_PERIOD_CONSISTENCY, LOW_MONOTONICITY, FEW_CYCLES, by which it is
    in no burst; a cycle is accepted if its places are certain, in a burst or not. A run too short for every band has a row
    with `reason`.
    """
    filters = [band_kernel(rate, lo, hi) for lo, hi in bands]

    def kernel(runs: list[Run]) -> list[dict[str, np.ndarray]]:
        out = []
        for r in runs:
            parts = []
            for b, f in enumerate(filters):
                if len(r.x) > len(f):
                    c = cycles_of(r.x, f)
                    inside = (c["trough"] >= len(f) // 2) & (c["stop"] <= len(r.x) - 1 - len(f) // 2)
                    places = {n: c[n] + r.first for n in ("rise_middle", "peak", "decay_middle", "stop")}
                    parts.append({"k": c["trough"] + r.first, "band": np.full(len(inside), b, np.int32), **places, **{n: c[n] for n in ("rise", "decay", "monotonicity")}, "inside": inside})
            out.append({n: np.concatenate([p[n] for p in parts]) for n in parts[0]})
        return out

    rows = chunks.on_chunks(chunked, recording, kernel, CYCLE, min(map(len, filters)) + 1, size)
    order = W.partitionBy(recording, "band").orderBy("k")
    by_height = W.partitionBy(recording, "band").orderBy("height")
    like = lambda a, b: F.when(F.greatest(a, b) > 0, F.greatest(F.least(a, b), F.lit(0.0)) / F.greatest(a, b)).otherwise(0.0)
    rows = rows.withColumns({"period": F.col("stop") - F.col("k"), "height": (F.col("rise") + F.col("decay")) / 2})
    ahead, behind = (lambda c: F.lead(c).over(order)), (lambda c: F.lag(c).over(order))
    touching = F.coalesce(behind("stop") == F.col("k"), F.lit(False)) & F.coalesce(ahead("k") == F.col("stop"), F.lit(False))
    period = F.col("period").cast("double")
    rows = rows.withColumns({
        "touching": touching,
        "amplitude_fraction": F.rank().over(by_height) / F.count("*").over(W.partitionBy(recording, "band")),
        "amplitude_consistency": F.least(like(F.col("rise"), F.col("decay")), like(F.col("rise"), behind("decay")), like(F.col("decay"), ahead("rise"))),
        "period_consistency": F.least(like(period, behind("period").cast("double")), like(period, ahead("period").cast("double"))),
    })
    low = [
        (F.col("amplitude_fraction") <= AMPLITUDE_FRACTION, "LOW_AMPLITUDE_FRACTION"),
        (F.col("touching") & (F.col("amplitude_consistency") <= AMPLITUDE_CONSISTENCY), "LOW_AMPLITUDE_CONSISTENCY"),
        (F.col("touching") & (F.col("period_consistency") <= PERIOD_CONSISTENCY), "LOW_PERIOD_CONSISTENCY"),
        (F.col("monotonicity") <= MONOTONICITY, "LOW_MONOTONICITY"),
    ]
    failed = F.array_compact(F.array(F.when(~F.col("inside"), "FILTER_GUARD"), F.when(~F.col("touching"), "UNSCORABLE_CYCLE"), *(F.when(c, n) for c, n in low)))
    rows = rows.withColumn("reasons", F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(failed))
    good = (F.size(F.array_except("reasons", F.array(F.lit("FILTER_GUARD")))) == 0) & F.col("reason").isNull()
    rows = rows.withColumn("_good", good)
    joined = F.col("_good") & F.coalesce(behind("_good"), F.lit(False)) & F.coalesce(behind("stop") == F.col("k"), F.lit(False))
    rows = rows.withColumn("_group", F.sum((~joined).cast("int")).over(order))
    group = W.partitionBy(recording, "band", "_group")
    in_burst = F.col("_good") & (F.count("*").over(group) >= LEAST_CYCLES)
    rows = rows.withColumn("in_burst", in_burst)
    reasons = F.when(F.col("_good") & ~F.col("in_burst"), F.array_append("reasons", F.lit("FEW_CYCLES"))).otherwise(F.col("reasons"))
    return rows.withColumn("reasons", reasons).withColumn("accepted", F.coalesce("inside", F.lit(False)))


def cycle_bursts(rows: DataFrame, recording: str) -> DataFrame:
    """recording, band, first, last (troughs), cycles, accepted, reasons: groups of touching cycles in bursts."""
    groups = rows.where("in_burst").groupBy(recording, "band", "_group").agg(F.min("k").alias("first"), F.max("stop").alias("last"), F.count("*").alias("cycles"), F.min("accepted").alias("accepted"))
    return groups.select(recording, "band", "first", "last", "cycles", "accepted", F.when(F.col("accepted"), F.array().cast("array<string>")).otherwise(F.array(F.lit("CENSORED_GUARD_BOUNDARY"))).alias("reasons"))
