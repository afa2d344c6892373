"""Registered queries against their SQL, and hand values for the kernels."""

import os

import duckdb
import numpy as np
import pytest

from tracewell.operators import kernels
from tracewell.operators.matching import match_times, suppress
from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows, columns):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v:.7g}" if isinstance(v, float) else str(v)

    order = np.argsort(columns)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    want = oracle.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()]
    assert cells(rows, got.columns) == cells(found, want.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def brute(a, b, tolerance):
    best = (0, 0.0)

    def go(i, j, n, cost):
        nonlocal best
        if (-n, cost) < (-best[0], best[1]):
            best = (n, cost)
        for x in range(i, len(a)):
            for y in range(j, len(b)):
                if abs(a[x] - b[y]) <= tolerance:
                    go(x + 1, y + 1, n + 1, cost + abs(a[x] - b[y]))

    go(0, 0, 0, 0.0)
    return best


def test_matching_is_optimal():
    rng = np.random.default_rng(19)
    for _ in range(40):
        a, b = np.sort(rng.uniform(0, 5, 5)), np.sort(rng.uniform(0, 5, 6))
        pairs = match_times(a, b, 0.7)
        n, cost = brute(a, b, 0.7)
        assert len(pairs) == n and abs(sum(abs(a[i] - b[j]) for i, j in pairs) - cost) < 1e-9


def test_matching_at_scale_and_edges():
    a = np.arange(3000) * 1.0
    assert len(match_times(a, a + 0.1, 0.2)) == 3000
    assert match_times(np.array([]), np.array([1.0]), 1.0) == []
    assert len(match_times(np.array([1.0, 1.0]), np.array([1.0]), 1.0)) == 1


def test_suppression_keeps_stronger_then_earlier():
    index, score = np.array([2.0, 5.0, 7.0]), np.array([3.0, 4.0, 3.0])
    assert suppress(index, score, 3).tolist() == [0, 1]


def test_zero_phase_keeps_band_and_drops_line():
    t = np.arange(2500) / 250
    sos = kernels.butterworth_sos(4, 1.0, 40.0, 250.0)
    inside, outside = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 90 * t)
    middle = slice(500, 2000)
    assert np.abs(kernels.zero_phase(sos, inside) - inside)[middle].max() < 0.02
    assert np.abs(kernels.zero_phase(sos, outside))[middle].max() < 0.02
    notch = kernels.notch_sos(60.0, 30.0, 250.0)
    assert np.abs(kernels.zero_phase(notch, np.sin(2 * np.pi * 60 * t)))[middle].max() < 0.05


def test_filtering_side_by_side_is_filtering_each():
    rng = np.random.default_rng(4)
    signals = [rng.normal(size=n) for n in (400, 7, 1, 90, 91)]
    sos = kernels.butterworth_sos(4, 1.0, 40.0, 250.0)
    for x, y in zip(signals, kernels.zero_phase_each(sos, signals)):
        assert len(x) == len(y) and (len(x) == 1 or np.allclose(y, kernels.zero_phase(sos, x)))


def test_derivatives_periodogram_and_resampling():
    t = np.arange(200) / 100
    slope = kernels.savitzky_golay(t**3, 7, 3, 1, 0.01)
    assert np.abs(slope - 3 * t**2).max() < 1e-6
    f, p = kernels.periodogram(np.sin(2 * np.pi * 8 * np.arange(1000) / 200), 200.0)
    assert abs(f[p.argmax()] - 8) < 0.3 and abs(p.sum() * (f[1] - f[0]) - 0.5) < 0.01
    x = np.sin(2 * np.pi * 3 * np.arange(500) / 250)
    y = kernels.resample(x, 4, 5)
    assert len(y) == 400 and np.abs(y - np.sin(2 * np.pi * 3 * np.arange(400) / 200))[40:360].max() < 0.02


def test_surrogates_crossings_and_agreement():
    x = np.random.default_rng(1).normal(size=(2, 128))
    y = kernels.phase_surrogate(x, 610)
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y)))
    found = kernels.crossings(np.array([1, 1, -1, -1, 2, 2, 0, 0, -2, -2.0]), 1e-9)
    assert [i for i, _, _ in found] == [2, 4, 6] and found[0][1] == 1.5 and abs(found[1][1] - 10 / 3) < 1e-9 and found[2][1] is None
    assert abs(kernels.adjusted_mutual_information(np.diag([5, 5, 5])) - 1) < 1e-9
    assert kernels.adjusted_mutual_information(np.array([[1]])) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_landmarks_tokens_and_timing_null(spark):
    rows = registry.QUERIES["q_landmarks"](spark, SF).collect()
    rows = [r for r in rows if r.reason is None]
    assert {r.family for r in rows} == {"extremum", "inflection"} and any(r.accepted for r in rows) and any(len(r.reasons) > 1 for r in rows)
    assert all((not r.reasons) == r.accepted and r.support_start < r.k <= r.support_stop for r in rows)
    assert all(r.steepness >= 100 and (r.family == "inflection" or r.flank >= 2) for r in rows if r.accepted)
    tokens = registry.QUERIES["q_tokenize"](spark, SF).toPandas()
    even = tokens[tokens.vec_id % 2 == 0]
    for code, part in even.groupby("code"):
        limit = np.quantile(part.distance, 0.99)
        own = tokens[tokens.code == code]
        assert (own.outlier == (own.distance > limit + 1e-9)).mean() > 0.98
    null = registry.QUERIES["q_timing_null"](spark, SF).toPandas()
    again = registry.QUERIES["q_timing_null"](spark, SF).toPandas()
    assert null.sort_values("user_id").values.tolist() == again.sort_values("user_id").values.tolist()
    assert (null.low <= null.middle).all() and (null.middle <= null.high).all() and null.p_value.between(0.01, 1).all()
    assert 0.2 < (null.p_value <= 0.5).mean() < 0.95  # clicks and views have no common times here
