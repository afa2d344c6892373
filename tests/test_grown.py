"""Queries whose work must grow with their input and no faster: equal results to the plain way, and what their plans hold."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracewell.operators import relocation
from tracewell.operators.matching import match_times, matched_sides, optimal_match, select_peaks, suppress
from tracewell.plans import registry

from test_whole import EVENTS, events, run


def plan_of(spark, folder, name):
    return registry.QUERIES[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()


def test_draws_meet_as_if_each_were_a_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    support = [(u, lo, lo + int(rng.integers(1, 30))) for u in range(6) for lo in np.cumsum(rng.integers(25, 60, 12)).tolist()]
    own = [(100 * u + i, u, int(t)) for u in range(7) for i, t in enumerate(rng.integers(0, 500, 14))] + [(900, None, 3), (901, 2, None)]
    fixed = [(u, int(t)) for u in range(5) for t in rng.integers(-20, 520, 25)] + [(None, 4), (3, None)]
    spans = relocation.joined(spark.createDataFrame(support, "u long, lo long, hi long"), "u", "lo", "hi")
    rows = relocation.feasible(spark.createDataFrame(own, "id long, u long, t long"), spans, "u", "t", 40)
    views = spark.createDataFrame(fixed, "u long, t long")
    want = {u: [len([1 for r in own if r[1] == u]), 0, np.zeros(100, int)] for u in range(7)}
    drawn = {}
    for r in rows.collect():
        if r.room:
            drawn.setdefault((r.u, 0), []).append(r.t)
        elif r.u in want:
            want[r.u][1] += 1
    want[2][0] -= 1  # an event without a time takes no part
    for r in relocation.draws(rows, "id", 7).collect():
        drawn.setdefault((r.u, r.draw + 1), []).append(r.moved)
    for (u, d), ts in drawn.items():
        want[u][2][d] = relocation.most_pairs(np.sort(ts), np.sort([t for v, t in fixed if v == u and t is not None]).astype(int), 5)
    got = {r.u: (r.events, r.still, r.matched) for r in relocation.matched_null(rows, views, "u", "id", "t", 7, 5, 40).collect()}
    assert got == {u: (n, still, m.tolist()) for u, (n, still, m) in want.items()}
    assert any(m.any() for _, _, m in want.values()) and got[6][1] == 14 and got[5][2] == [0] * 100  # no support, no fixed times
    slow = relocation.matched_draws(relocation.draws(rows, "id", 7).select("u", "draw", "moved"), views, "u", 5, 40).collect()
    assert all(got[r.u][2][r.draw + 1] == r.matched for r in slow) and slow


def test_a_click_is_shuffled_once_not_once_a_draw(spark, tmp_path):
    rows = events(300, 4, 1)
    got = {r.user_id: r.clicks for r in run(spark, tmp_path, "q_timing_null", events=(rows, EVENTS))}
    assert got == {u: n for u in range(4) if (n := sum(r[2] == u and r[3] == "click" for r in rows))}
    plan = plan_of(spark, tmp_path, "q_timing_null")
    assert "FlatMapGroups" not in plan and "explode(sequence(0, 98" not in plan.replace("Some(", "")


def odd_events():
    """Null values, events without k, constant and periodic blocks, NaN, a null user, users of one and of 28 events."""
    rows = [list(r) for r in events(600, 6, 9)]
    for i, r in enumerate(rows):
        if r[2] == 0 and i % 3 == 0:
            r[4] = None
        if r[2] == 1 and i % 2:
            r[5] = '{"j": 1}' if i % 4 == 1 else None
        if r[2] == 2:
            r[4] = 0.1
        if r[2] == 3:
            r[5] = '{"k": 7}'
    at = rows[0][1]
    for user, n in ((7, 1), (8, 28), (9, 54), (10, 27), (11, 12), (None, 30)):
        for k in range(n):
            value = float("nan") if user == 10 and k == 3 else 1e9 + (k % 9) * 0.01 if user == 9 else None if user == 11 else float(k % 3)
            rows.append([10_000 + 100 * (user or 50) + k, at, user, "view", value, '{"k": %d}' % (k % 9 if user == 9 else k % 4)])
    return [tuple(r) for r in rows]


def test_shifts_agree_with_their_sql(spark, tmp_path):
    from tracewell.plans import sql, statistics

    rows = odd_events()
    got = run(spark, tmp_path, "q_cyclic_shift_null", events=(rows, EVENTS))
    want = sql.query(statistics.BLOCKS["q_cyclic_shift_null"])(spark, str(tmp_path))
    assert registry.QUERIES["q_cyclic_shift_null"](spark, str(tmp_path)).dtypes == want.dtypes
    key = lambda r: tuple(None if v is None else "NaN" if v != v else v for v in r)
    want = sorted(map(key, want.collect()), key=lambda r: r[:2])
    assert sorted(map(key, got), key=lambda r: r[:2]) == want
    assert {r[0] for r in want} == {*range(12)} - {6} and sum(r[2] for r in want) == len(rows) - 30
    assert any(r[3] is None for r in want) and any(r[3] == "NaN" for r in want) and any(r[0] == 9 and r[4] >= 2 for r in want)


def test_an_event_is_shuffled_once_not_once_a_shift(spark, tmp_path):
    run(spark, tmp_path, "q_cyclic_shift_null", events=(events(300, 4, 1), EVENTS))
    plan = plan_of(spark, tmp_path, "q_cyclic_shift_null")
    assert "Join" not in plan and "explode" not in plan


@pytest.fixture
def short_batches(spark):
    """Batches of three rows, so that runs go on over several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_peaks_of_runs_are_those_of_whole_strata(spark, short_batches):
    rng = np.random.default_rng(8)
    rows = [(f"s{s}", int(k), float(v), f"{s}/{k}") for s in range(5) for k, v in zip(np.sort(rng.choice(120, 40, False)), rng.integers(0, 9, 40), strict=True)]
    rows += [("down", 2 * k, 50.0 - k, "d") for k in range(25)] + [("alone", 7, 1.0, "a"), (None, 3, 1.0, "n"), (None, 4, 2.0, "n"), ("s0", None, 99.0, "nowhere")]
    df = spark.createDataFrame(rows, "s string, k long, score double, more string").repartition(3)
    got = select_peaks(df, ["s"], "k", "score", 4.0)
    assert got.schema == df.schema
    want = set()
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s and r[1] is not None), key=lambda r: r[1])
        want |= {own[i] for i in suppress(np.array([r[1] for r in own], float), np.array([r[2] for r in own]), 4.0)}
    got = [tuple(r) for r in got.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) < len(rows) - 20


def test_sides_are_matched_over_batches_as_in_whole_strata(spark, short_batches):
    rng = np.random.default_rng(4)
    sides = [[(g, float(t), 100 * side + i) for g in range(4) for i, t in enumerate(rng.choice(300, n, False) / 3)] for side, n in enumerate((40, 30))]
    sides[0] += [(9, 1.0, 900), (None, 1.0, 901), (1, None, 902)]
    frames = [spark.createDataFrame(rows, "g int, t double, key long") for rows in sides]
    pairs = optimal_match(*frames, ["g"], "t", "key", 1.5).collect()
    time = {(s, r[0], r[2]): r[1] for s, rows in enumerate(sides) for r in rows}
    for g in range(4):
        a, b = (np.sort([r[1] for r in rows if r[0] == g and r[1] is not None]) for rows in sides)
        best = match_times(a, b, 1.5)
        own = [r for r in pairs if r.g == g]
        assert len(own) == len(best) and abs(sum(abs(r.lag) for r in own) - sum(abs(a[i] - b[j]) for i, j in best)) < 1e-9
        assert all(r.lag == time[1, g, r.b_key] - time[0, g, r.a_key] for r in own)
    both = frames[0].withColumn("_side", F.lit(0)).unionByName(frames[1].withColumn("_side", F.lit(1))).withColumnsRenamed({"t": "_t", "key": "_key"})
    every = matched_sides(both, ["g"], 1.5, every=True).collect()
    assert sorted(r for r in every if r.lag is not None) == sorted(pairs)
    alone = [(r.g, r.a_key, r.b_key) for r in every if r.lag is None]
    paired = {(r.g, r.a_key) for r in pairs}, {(r.g, r.b_key) for r in pairs}
    left = [[(r[0], r[2]) for r in rows if r[0] is not None and r[1] is not None and (r[0], r[2]) not in paired[s]] for s, rows in enumerate(sides)]
    assert sorted(alone, key=str) == sorted([(g, k, None) for g, k in left[0]] + [(g, None, k) for g, k in left[1]], key=str)


def test_peaks_are_found_once_and_not_in_a_group_a_recording(spark, tmp_path):
    rows = odd_events()
    got = {r.user_id: r for r in run(spark, tmp_path, "q_evaluate_arrays", events=(rows, EVENTS))}
    assert got.keys() == {r[2] for r in rows} and sum(r.peaks_value for r in got.values()) > 20 and sum(r.matched for r in got.values()) > 5
    assert (got[None].peaks_value, got[None].matched, got[None].f1, got[None].scored_value) == (0, 0, 1.0, 23)  # not a recording: counted only
    assert got[7].scored_value == 0 and got[7].f1 == 1.0 and got[11].scored_value == 0
    plan = plan_of(spark, tmp_path, "q_evaluate_arrays")
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2


def test_quantiles_are_exact_without_a_map_of_all_values(spark, monkeypatch):
    from tracewell.operators import quantiles as q

    rng = np.random.default_rng(2)
    columns = [rng.normal(size=4001), rng.integers(0, 7, 4001).astype(float), np.where(rng.random(4001) < 0.3, None, rng.lognormal(3, 3, 4001)), np.full(4001, 2.5), np.full(4001, None), np.where(np.arange(4001) < 3, float("nan"), 1.0 * np.arange(4001))]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in zip(*columns, strict=True)], ", ".join(f"c{i} double" for i in range(6))).repartition(5)
    wanted = {f"q{i}_{int(1000 * p)}": (F.col(f"c{i}"), p) for i in range(6) for p in (0.0, 0.001, 0.25, 0.8, 0.9999, 1.0)}
    for rows in (df, df.limit(3), df.limit(1), df.limit(0)):
        rows = rows.localCheckpoint()
        want = rows.agg(*(F.percentile(c, p).alias(n) for n, (c, p) in wanted.items())).first()
        for few in (5000, 1000):
            monkeypatch.setattr(q, "FEW", few)
            got = q.quantiles(rows, wanted).first()
            assert [str(v) for v in got] == [str(v) for v in want]


def test_scores_are_not_gathered_to_set_their_threshold(spark, tmp_path):
    run(spark, tmp_path, "q_evaluate_arrays", events=(events(300, 4, 1), EVENTS))
    assert "percentile(score" not in (plan := plan_of(spark, tmp_path, "q_evaluate_arrays")) and "percentile(value" not in plan
    assert "percentile_approx" in plan
