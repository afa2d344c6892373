"""Queries that cover all rows, on small tables against brute force."""

import itertools
import math
import os
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tracewell.operators import kernels
from tracewell.plans import registry

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        if not os.path.exists(f"{folder}/{t}.parquet"):
            spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
    return registry.QUERIES[name](spark, str(folder)).collect()


def events(n, users, seed, hours=200):
    rng = np.random.default_rng(seed)
    start, kinds = datetime(2024, 1, 1), ["click", "view", "error", "purchase", "signup"]
    rows = []
    for i in range(n):
        at = start + timedelta(microseconds=int(rng.integers(0, hours * 3_600_000_000)))
        rows.append((i, at, int(rng.integers(0, users)), kinds[rng.integers(0, 5)], round(float(rng.uniform(0, 100)), 2), '{"k": %d}' % rng.integers(0, 100)))
    return rows


def most_pairs(a, b, tolerance):
    """The size of the largest one-to-one matching, by augmenting paths."""
    partner = {}

    def place(i, seen):
        for j in range(len(b)):
            if abs(a[i] - b[j]) <= tolerance and j not in seen:
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def test_pooled_f1_counts_matches_in_time(spark, tmp_path):
    rows = [r for r in events(260, 14, 1) if not (r[2] == 3 and r[3] == "click") and not (r[2] == 4 and r[3] == "view")]
    times = defaultdict(lambda: ([], []))
    for _, ts, user, kind, *_ in rows:
        if kind in ("click", "view"):
            times[user][kind == "view"].append((ts - datetime(2024, 1, 1)).total_seconds())
    want = defaultdict(lambda: np.zeros(3, int))
    for user in {r[2] for r in rows}:
        a, b = times[user]
        want[user % 10] += [len(a), len(b), most_pairs(a, b, 7200.0)]
    got = {r.variant: r for r in run(spark, tmp_path, "q_pooled_f1", events=(rows, EVENTS))}
    assert {v: (r.na, r.nb, r.matched) for v, r in got.items()} == {v: tuple(w) for v, w in want.items()}
    assert all(abs(r.f1 - 2 * r.matched / (r.na + r.nb)) < 1e-8 for r in got.values())
    assert sum(r.matched for r in got.values()) < sum(min(map(len, times[u])) for u in times)


def test_lineage_edges_link_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 60, n))
    items = [(i, say(int(rng.integers(1, 30)))) for i in range(12)] + [(12, "solo"), (13, "two words"), (14, "only three here"), (15, ""), (16, None)]
    docs = [(i, say(int(rng.integers(1, 200)))) for i in range(40)]
    for i in range(20):
        docs.append((100 + i, f"{say(60)}\n{items[i % 15][1]}{['', '.', 'x y', ' z'][i % 4]}"))
    docs += [(200, f"pre{items[3][1]}post {items[5][1]}"), (201, items[4][1][:-1]), (202, None), (203, ""), (204, "a two  words b"), (205, items[9][1])]
    want = {d: min(found) for d, t in docs if (found := [i for i, x in items if x and t and x in t])}
    got = run(spark, tmp_path, "q_lineage_edges", documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    assert {r.child: r.parent for r in got} == want and len(got) == len(want) and {r.relation for r in got} == {"reads"}


def test_lineage_closure_walks_from_every_document(spark, tmp_path):
    keys = [0, 1, 2, 3, 399, 400, 5000, 6560, 6561, 3**39, 2**63 - 1]
    want = {}
    for k in keys[1:]:
        way, at = [], k
        while at > 0:
            at //= 3
            way.append(at)
        want[k] = (len(way), len(way), 0)
    got = run(spark, tmp_path, "q_lineage_closure", documents=([(k, "t") for k in keys], "doc_id long, text string"))
    assert {r.child: (r.depth, r.ancestors, r.root) for r in got} == want


def test_domain_completion_counts_all_orders(spark, tmp_path):
    orders = [(i, i, "FO"[i % 2], f"{i % 3}-P", float(i)) for i in range(1000) if i % 6 != 5]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double"
    got = run(spark, tmp_path, "q_domain_completion", orders=(orders, schema))
    want = {(s, f"{p}-P"): sum(o[2] == s and o[3] == f"{p}-P" for o in orders) for s in "FO" for p in range(3)}
    assert {(r.o_orderstatus, r.o_orderpriority): r.n for r in got} == want and 0 in want.values()
    assert all((r.reason is None) == (r.n > 0) for r in got)


def test_ami_uses_the_counts_of_a_large_table(spark, tmp_path):
    counts = np.array([[15000, 40, 3, 900], [60, 9000, 1, 2], [5, 300, 8, 1]])
    rows = [(i, None, j, f"k{a}", 0.0, None) for a, row in enumerate(counts) for j, n in enumerate(row) for i in range(n)]
    n, x, y = int(counts.sum()), counts.sum(1).tolist(), counts.sum(0).tolist()
    log = lambda k: math.lgamma(k + 1)
    expected = 0.0
    for a in x:
        for b in y:
            for k in range(max(1, a + b - n), min(a, b) + 1):
                chance = log(a) + log(b) + log(n - a) + log(n - b) - log(n) - log(k) - log(a - k) - log(b - k) - log(n - a - b + k)
                expected += k / n * math.log(n * k / (a * b)) * math.exp(chance)
    entropy = lambda v: -sum(t / n * math.log(t / n) for t in v)
    mutual = sum(c / n * math.log(n * c / (x[i] * y[j])) for (i, j), c in np.ndenumerate(counts))
    want = (mutual - expected) / ((entropy(x) + entropy(y)) / 2 - expected)
    assert n > 20_000
    assert abs(run(spark, tmp_path, "q_ami", events=(rows, EVENTS))[0].ami - want) < 1e-9


def test_chance_information_in_chunks():
    for x, y, n in ((1, 1, 2), (5, 3, 8), (40, 70, 100), (700, 20, 900), (2, 900, 900), (1200, 1100, 2000)):
        want = 0.0
        for k in range(max(1, x + y - n), min(x, y) + 1):
            want += k / n * math.log(n * k / (x * y)) * (math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y))
        for chunk in (7, 1 << 20):
            assert abs(kernels.chance_information(x, y, n, chunk) - want) < 1e-12


def by_user(rows):
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        own[r[2]].append(r)
    return own


def test_signflip_takes_all_users(spark, tmp_path):
    rows = events(900, 260, 2)
    effect = {u: np.mean([r[4] for r in own]) - 50 for u, own in by_user(rows).items()}
    want = {}
    for g in range(25):
        users = sorted(u for u in effect if u % 25 == g)
        for at in range(0, len(users), 6):
            x = np.array([effect[u] for u in users[at : at + 6]])
            signs = np.array(list(itertools.product([1, -1], repeat=len(x))))
            want[g, at // 6] = (len(x), float((abs(signs @ x) >= abs(x.sum()) - 1e-12).mean()) if len(x) > 1 else None)
    got = run(spark, tmp_path, "q_signflip", events=(rows, EVENTS))
    assert {(r.g, r.block): (r.people, r.p_value and round(r.p_value, 8)) for r in got} == {k: (n, p and round(p, 8)) for k, (n, p) in want.items()}
    assert sum(r.people for r in got) == len(effect) > 150


def test_blocks_and_bins_cover_all_events(spark, tmp_path):
    rows = events(700, 3, 6) + [(900, datetime(2024, 1, 5), 7, "view", 5.0, '{"k": 5}')]
    rows += [(901 + i, datetime(2024, 1, 5 + i), 8, "view", 5.0, '{"k": %d}' % i) for i in range(2)]
    own = by_user(rows)
    shifts, stats, bins = {}, {}, {}
    for u, es in own.items():
        for at in range(0, len(es), 27):
            a, b = np.array([e[4] for e in es[at : at + 27]]), np.array([float(e[5][6:-1]) for e in es[at : at + 27]])
            rho = [np.corrcoef(a, np.roll(b, -s))[0, 1] for s in range(len(a))] if len(set(a)) > 1 else [None]
            above = sum(r >= rho[0] - 1e-12 for r in rho[1:])
            shifts[u, at // 27] = (len(a), above, (1 + above) / len(a) if rho[0] is not None else None)
        for at in range(0, len(es), 60):
            v = sorted(e[4] for e in es[at : at + 60])
            stats[u, at // 60] = (len(v), v[2], v[29], v[57], None) if len(v) == 60 else (len(v), None, None, None, "NOT_ESTIMABLE")
        for k in range(-(-len(es) // 20)):
            for kind in ["click", "view", "error", "purchase", "signup"]:
                bins[u, kind, k] = sum(e[3] == kind for e in es[20 * k : 20 * k + 20])
    got = run(spark, tmp_path, "q_cyclic_shift_null", events=(rows, EVENTS))
    assert {(r.user_id, r.block): (r.n, r.above) for r in got} == {k: v[:2] for k, v in shifts.items()}
    assert all(r.p_value == shifts[r.user_id, r.block][2] or abs(r.p_value - shifts[r.user_id, r.block][2]) < 1e-5 for r in got)
    got = run(spark, tmp_path, "q_order_stats", events=(rows, EVENTS))
    assert {(r.user_id, r.block): (r.n, r.low, r.middle, r.high, r.reason) for r in got} == stats
    got = run(spark, tmp_path, "q_event_bins", events=(rows, EVENTS))
    assert {(r.user_id, r.event_type, r.bin): r.n for r in got} == bins and sum(r.n for r in got) == len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_streams_write_their_result_to_files(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    for name in ("q_stream_session", "q_stream_tumbling"):
        got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sum(r.n for r in got.collect()) == n and got.inputFiles()


def test_a_stream_that_is_restarted_goes_on_where_it_was(spark, tmp_path):
    """Peaks at the seams of two runs are found once, from the state in the checkpoint."""
    from pyspark.sql import functions as F

    from tracewell.streaming.windows import append_to, peaks

    rows = sorted((r[:2] + r[2:] for r in events(400, 5, 11)), key=lambda r: (r[1], r[0]))
    source, folder = f"{tmp_path}/source", f"{tmp_path}/out"
    for part in (rows[:150], rows[150:290], rows[290:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
        append_to(peaks(stream), folder)
    want = set()
    for user in {r[2] for r in rows}:
        own = [(r[0], r[4]) for r in rows if r[2] == user]
        want |= {(user, own[i][0]) for i in range(1, len(own) - 1) if own[i][1] > max(own[i - 1][1], own[i + 1][1])}
    got = [(r.user_id, r.event_id) for r in spark.read.parquet(f"{folder}/rows").collect()]
    assert sorted(got) == sorted(want)
