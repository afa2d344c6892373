"""Chunks with halos give what whole recordings give; kernels on short and gappy recordings; oscillations by force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import chunks, kernels, oscillations
from tracewell.plans import recordings, registry

RATE = 250.0


def frame(spark, signals):
    """signals: recording -> samples (NaN: null)."""
    rows = [(r, k, None if np.isnan(v) else float(v)) for r, x in signals.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec long, k long, value double").repartition(3)


def packets(rng, n, gaps=()):
    t = np.arange(n) / RATE
    x = rng.normal(0, 3, n)
    for start, f in ((n // 6, 6.0), (n // 2, 10.0), (3 * n // 4, 20.0)):
        x += 60 * np.exp(-(((t - start / RATE) / 0.35) ** 2)) * np.sin(2 * np.pi * f * t)
    x[list(gaps)] = np.nan
    return x


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(1)
    return {1: packets(rng, 2600), 2: packets(rng, 1900, gaps=(5, 700, 701, 960)), 3: packets(rng, 40), 4: np.array([np.nan]), 5: np.full(300, 2.5), 6: np.array([1.0, np.nan, 2.0])}


def test_chunks_own_every_sample_once(spark, signals):
    got = chunks.chunked(frame(spark, signals), "rec", "k", "value", 10, 64).collect()
    own = sorted((r.rec, k) for r in got for k in r.ks if k // 64 == r.chunk)
    assert own == sorted((r, k) for r, x in signals.items() for k in range(len(x)))
    assert all(r.ks[0] == max(0, r.chunk * 64 - 10) and r.ks[-1] == min(len(signals[r.rec]), (r.chunk + 1) * 64 + 10) - 1 for r in got)


KERNELS = {
    "zero_phase": (chunks.each_sample(recordings.zero_phase, ["y"]), "y double", 1, True, None),
    "savgol": (chunks.each_sample(lambda xs: [[kernels.savitzky_golay(x, 7, 3, 1, 1 / RATE)] for x in xs], ["y"]), "y double", 7, True, 7),
    "windows": (chunks.each_window(lambda x: [x.sum(1), x.max(1, initial=-1e9)], ["y", "z"], 20, 6), "first long, y double, z double", 25, False, 26),
    "landmarks": (recordings.landmarks, recordings.LANDMARK, 7, False, 2 * recordings.FLANK),
}


@pytest.mark.parametrize("name", KERNELS)
def test_chunks_are_as_whole_recordings(spark, signals, name):
    kernel, schema, least, missing, halo = KERNELS[name]
    halo = halo or recordings.filter_reach()
    runs = [chunks.on_chunks(chunks.chunked(frame(spark, signals), "rec", "k", "value", halo, size), "rec", kernel, schema, least, size, missing).toPandas() for size in (97, 10**6)]
    by = [c for c in ("rec", "k", "first", "family") if c in runs[0]]
    parts, whole = (r.sort_values(by).reset_index(drop=True) for r in runs)
    assert len(parts) == len(whole) > 100
    for c in whole:
        if whole[c].dtype == float:
            assert np.allclose(parts[c], whole[c], atol=1e-5, rtol=1e-6, equal_nan=True), c
        else:
            assert parts[c].map(str).tolist() == whole[c].map(str).tolist(), c
    if missing:  # every sample has a row, and a gap says so
        assert len(whole) == sum(map(len, signals.values())) and (whole.reason == "MISSING_SAMPLE").sum() == sum(int(np.isnan(x).sum()) for x in signals.values())


def brute_bursts(x, band, rate):
    """Bursts of one recording and band: by walking over its runs."""
    kernel = oscillations.band_kernel(rate, *band)
    good = np.flatnonzero(np.isfinite(x))
    runs = [r for r in np.split(good, np.flatnonzero(np.diff(good) != 1) + 1) if len(r)]
    held = [(r, np.abs(np.convolve(x[r], kernel)[len(kernel) // 2 :][: len(r)])) for r in runs if len(r) > len(kernel)]
    if not held:
        return [(None, None, ("UNSUPPORTED_SHORT_RUN",))]
    median = np.median(np.concatenate([m for _, m in held]))
    if not median > 0:
        return [(None, None, ("DEGENERATE_NORMALIZATION",))]
    out = []
    for r, m in held:
        k = 0
        while k < len(m):
            if m[k] < median:
                k += 1
                continue
            end = k
            while end + 1 < len(m) and m[end + 1] >= median:
                end += 1
            if m[k : end + 1].max() >= 2 * median:
                why = ("SHORT_DURATION",) * (end - k + 1 < 3 * rate / band[0]) + ("CENSORED_GUARD_BOUNDARY",) * (k < len(kernel) // 2 or len(m) - 1 - end < len(kernel) // 2)
                out.append((int(r[k]), int(r[end]), why))
            k = end + 1
    return out


@pytest.mark.parametrize("size", [73, 10**6])
def test_bursts_by_force(spark, signals, size):
    signals = signals | {7: np.zeros(400)}
    rows = oscillations.magnitudes(chunks.chunked(frame(spark, signals), "rec", "k", "value", oscillations.reach(RATE), size), "rec", RATE, size=size)
    got = sorted(((r.rec, r.band, r["first"], r["last"], tuple(r.reasons)) for r in oscillations.bursts(rows, "rec", RATE, size=size).collect()), key=str)
    want = sorted(((rec, b, *e) for rec, x in signals.items() for b, band in enumerate(oscillations.BANDS) for e in brute_bursts(x, band, RATE)), key=str)
    assert got == want
    accepted = {(r[0], r[1]) for r in got if not r[4]}
    assert {(1, 0), (1, 1), (1, 2)} <= accepted and any("SHORT_DURATION" in r[4] for r in got)


def test_the_kernel_is_an_analytic_band_pass():
    kernel = oscillations.band_kernel(RATE, 8.0, 13.0)
    t = np.arange(2000) / RATE
    inside = np.abs(np.convolve(7 * np.sin(2 * np.pi * 10.5 * t), kernel, "same"))[300:-300]
    outside = np.abs(np.convolve(7 * np.sin(2 * np.pi * 40 * t), kernel, "same"))[300:-300]
    assert np.allclose(inside, 7, atol=0.2) and outside.max() < 0.1 and len(kernel) % 2


def test_cycles_of_a_tone_and_their_groups(spark, signals):
    t = np.arange(1500) / RATE
    tone = 40 * np.sin(2 * np.pi * 10 * t)
    c = oscillations.cycles_of(tone, oscillations.band_kernel(RATE, 8.0, 13.0))
    assert (np.diff(c["trough"]) == 25).all() and (c["stop"] - c["trough"] == 25).all() and (c["trough"][1:] == c["stop"][:-1]).all()
    assert np.allclose(c["rise"], 80, atol=1) and (np.abs(c["peak"] - c["trough"] - 12.5) <= 1).all() and (c["monotonicity"] == 1).all()
    mixed = tone.copy()
    mixed[600:900] = np.random.default_rng(0).normal(0, 5, 300)
    rows = {}
    for size in (101, 10**6):
        made = oscillations.cycles(chunks.chunked(frame(spark, signals | {9: mixed}), "rec", "k", "value", oscillations.reach(RATE), size), "rec", RATE, size=size)
        rows[size] = sorted(map(str, made.drop("reason", "_good", "_group").collect())), [r.asDict() for r in oscillations.cycle_bursts(made, "rec").collect()]
    assert rows[101][0] == rows[10**6][0] and len(rows[101][0]) > 100
    bursts = sorted((b["first"], b["last"], b["cycles"], b["accepted"]) for b in rows[101][1] if b["rec"] == 9 and b["band"] == 1)
    assert len(bursts) >= 2 and all(n >= 3 for _, _, n, _ in bursts) and bursts[0][1] <= 640 and bursts[-1][0] >= 860
    assert "UNSUPPORTED" not in str(bursts) and any("SHORT_SUPPORT" in r for r in rows[101][0])


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(0, 1, 5001), 2: rng.integers(0, 3, 4000).astype(float), 3: rng.random(2), 4: rng.random(1), 5: rng.random(999)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(6, None)], "g long, v double")
    got = {r.g: (r.n, r.median) for r in oscillations.medians(rows, ["g"], "v").collect()}
    assert got.keys() == groups.keys() and all(got[g][0] == len(x) and got[g][1] == np.median(x) for g, x in groups.items())


LENGTHS = (0, 1, 3, 6, 7, 25, 26, 30, 39, 64)


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    """Events of recordings of awkward lengths, some with null values."""
    rng, rows = np.random.default_rng(4), []
    for gappy in (False, True):
        for n in LENGTHS:
            x = np.round(rng.normal(50, 20, n), 2)
            if gappy and n:
                x[[n // 2, 0]] = np.nan
            rows += [(len(rows) + k, 100 * gappy + n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * k), "click", None if np.isnan(v) else float(v), '{"k": 1}') for k, v in enumerate(x)]
    folder = tmp_path_factory.mktemp("awkward")
    table = pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "event_type", "value", "props"])
    table["ts"] = table["ts"].astype("datetime64[us]")
    table.to_parquet(folder / "events.parquet", index=False)
    return str(folder), table


@pytest.mark.parametrize("name", recordings.NAMES.split())
def test_awkward_recordings_have_rows(spark, awkward, name):
    folder, table = awkward
    got = registry.QUERIES[name](spark, folder).toPandas()
    users = set(table.user_id)
    if name not in ("q_cycle_bursts", "q_oscillation_bursts"):  # which have events alone
        assert set(got.user_id) == users
    if "reason" in got and name != "q_resample":
        known = got[got.reason.isnull()]
        assert set(got.reason.dropna()) <= {"MISSING_SAMPLE", "SHORT_SUPPORT"} and set(known.user_id) <= {u for u in users if u % 100 >= 3}| {1, 3, 101, 103}
        assert set(got[got.reason == "SHORT_SUPPORT"].user_id) or name in ("q_filter_zero_phase", "q_halo_chunks")
    if name in ("q_halo_chunks", "q_filter_zero_phase", "q_savgol"):
        assert len(got) == len(table) and (got.reason == "MISSING_SAMPLE").sum() == table.value.isna().sum()


def test_bootstrap_is_that_of_draws(spark, awkward):
    folder, table = awkward
    rng = np.random.default_rng(9)
    for r in registry.QUERIES["q_bootstrap_ci"](spark, folder).collect():
        x = table[table.user_id == r.user_id].value.dropna().to_numpy()
        assert r.n == len(x) and (r.low is None) == (len(x) < 2)
        if len(x) > 20:
            draws = np.median(rng.choice(x, (4000, len(x))), 1)
            assert (draws < r.low - 1e-6).mean() < 0.04 < 0.96 < (draws < r.high + 1e-6).mean()
            assert (draws <= r.low + 1e-6).mean() > 0.01 and (draws <= r.high - 1e-6).mean() < 0.99


def test_places_number_a_recording_over_slices(spark):
    rows = spark.createDataFrame([(u, t, i) for u in (1, 2) for i, t in enumerate([5, 3, 3, 900, 1000, 40])], "u long, t long, key long")
    got = chunks.places(rows, "u", ["t", "key"], F.floor(F.col("t") / 100)).collect()
    assert sorted((r.u, r.k, r.key) for r in got) == [(u, k, key) for u in (1, 2) for k, key in enumerate([1, 2, 0, 5, 3, 4])]
