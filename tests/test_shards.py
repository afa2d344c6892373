"""Shards filled by pointers against a walk over all files."""

import numpy as np
import pytest

from tracewell.operators.shards import fill_shards


def walk(files, capacity):
    out, now = [], {}
    for group, order, size in sorted(files, key=lambda f: (str(f[0]), f[1])):
        shard, filled = now.get(group, (0, 0))
        if filled and filled + size > capacity:
            shard, filled = shard + 1, 0
        now[group] = shard, filled + size
        out.append((group, order, size, *now[group]))
    return out


@pytest.mark.parametrize("seed, capacity", [(0, 100), (1, 1000), (2, 7), (3, 10**6)])
def test_pointers_fill_as_a_walk_does(spark, seed, capacity):
    rng = np.random.default_rng(seed)
    files = [(g, int(k), int(s)) for g, n in (("a", 700), (None, 90), ("b", 1), ("c", 33)) for k, s in zip(rng.permutation(5000)[:n], rng.choice([1, 2, 5, 30, 99, 100, 101, 400], n))]
    rows = spark.createDataFrame(files, "g string, name long, size long").repartition(4)
    got = fill_shards(rows, ["g"], "name", "size", capacity)
    assert got.columns == ["g", "name", "size", "shard", "filled"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(walk(files, capacity), key=str)
    assert fill_shards(rows.limit(0), ["g"], "name", "size", capacity).count() == 0
