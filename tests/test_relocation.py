"""Events that move within what is feasible for them."""

import os

import numpy as np
import pytest

from tracewell.operators import relocation
from tracewell.operators.matching import match_times
from tracewell.plans import registry, signals

SF = "/root/testdata/sf0.001"


def test_draws_stay_in_their_own_pieces(spark):
    support = relocation.joined(spark.createDataFrame([("a", 3, 7), ("a", 7, 9), ("a", 8, 12), ("a", 25, 26), ("a", 40, 40), ("b", 0, 100), (None, 0, 9)], "s string, x long, y long"), "s", "x", "y")
    assert sorted(map(tuple, support.collect())) == [("a", 3, 12), ("a", 25, 26), ("b", 0, 100)]
    events = spark.createDataFrame([(1, "a", 0), (2, "a", 11), (3, "a", 29), (4, "a", 35), (5, "b", 99), (6, None, 1), (7, "a", None), (8, "c", 5)], "key long, s string, t long")
    rows = relocation.feasible(events, support, "s", "t", 10)
    got = {r.key: ([tuple(p) for p in r.pieces], r.room) for r in rows.collect()}
    assert got == {1: ([(3, 10)], 7), 2: ([(10, 12)], 2), 3: ([(25, 26)], 1), 4: ([], 0), 5: ([(90, 100)], 10), 8: ([], 0)}
    drawn = relocation.draws(rows, "key", 7)
    held = {}
    for r in drawn.collect():
        held.setdefault(r.key, []).append(r.moved)
        assert any(lo <= r.moved < hi for lo, hi in got[r.key][0])
    assert {k: len(v) for k, v in held.items()} == {1: 99, 2: 99, 3: 99, 5: 99}
    assert set(held[1]) == set(range(3, 10)) and set(held[2]) == {10, 11}  # every place is drawn
    again = {(r.key, r.draw): r.moved for r in relocation.draws(rows.repartition(7), "key", 7).collect()}
    assert again == {(r.key, r.draw): r.moved for r in drawn.collect()}


def test_gaps_are_taken_out(spark):
    spans = spark.createDataFrame([("a", 0, 50), ("b", 5, 9), ("c", 0, 10)], "s string, lo long, hi long")
    gaps = spark.createDataFrame([("a", 10, 20), ("a", 30, 60), ("c", 0, 10)], "s string, lo long, hi long")
    assert sorted(map(tuple, relocation.without(spans, gaps, "s").collect())) == [("a", 0, 10), ("a", 20, 30), ("b", 5, 9)]


def test_order_statistics_need_99_draws(spark):
    rows = spark.createDataFrame([("x", v) for v in range(99)] + [("y", v) for v in range(98)], "s string, v long")
    got = {r.s: (r.draws, r.low, r.middle, r.high, r.reason) for r in relocation.order_statistics(rows, "s", "v").collect()}
    assert got == {"x": (99, 4, 49, 94, None), "y": (98, None, None, None, "NOT_ESTIMABLE")}


def test_walk_counts_as_many_as_a_matching(spark):
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.sort(rng.integers(0, 60, int(rng.integers(0, 12)))).astype(float) for _ in range(2))
        assert relocation.most_pairs(a, b, 3.0) == len(match_times(a, b, 3.0))
    moved = [(u, d, int(t)) for u in range(3) for d in range(4) for t in rng.integers(0, 500, 15)]
    fixed = [(u, int(t)) for u in range(3) for t in rng.integers(0, 500, 20)]
    got = relocation.matched_draws(spark.createDataFrame(moved, "u long, draw int, moved long"), spark.createDataFrame(fixed, "u long, t long"), "u", 4, 10)
    side = lambda rows, u, d=None: np.sort([r[-1] for r in rows if r[0] == u and (d is None or r[1] == d)])
    assert {(r.u, r.draw): r.matched for r in got.collect() if r.matched} == {(u, d): n for u in range(3) for d in range(4) if (n := relocation.most_pairs(side(moved, u, d), side(fixed, u), 4))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_the_null_of_the_events(spark):
    clicks, drawn, _ = signals.timing_null(spark, SF)
    pieces = {r.event_id: [tuple(p) for p in r.pieces] for r in clicks.collect()}
    rows = drawn.collect()
    assert len(rows) == 99 * sum(bool(p) for p in pieces.values()) and all(any(lo <= r.moved < hi for lo, hi in pieces[r.event_id]) for r in rows)
    for r in registry.QUERIES["q_timing_null"](spark, SF).collect():
        assert (r.p_value is None) == (r.clicks == r.fixed) and (r.reason == "NO_FEASIBLE_PLACE") == (r.clicks == r.fixed)
        assert r.p_value is None or 0.01 <= r.p_value <= 1 and r.low <= r.middle <= r.high and r.matched <= r.clicks - r.fixed
