"""One-to-one event matching: most pairs within a tolerance, then the smallest total lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match_times(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Index pairs of a best matching of ascending times: most pairs at most `tolerance` apart, then the least total lag.

    A best matching need not cross, so it is an alignment: cell (i, j) of a table holds the best of the first i times of
    a and the first j of b. Only a band of the table counts: a time of a is weighed against the times of b in its reach,
    and before and after its band a row repeats its ends. Among equals a pair that can be left out is left out.
    """
    first, last = np.searchsorted(b, a - tolerance, "left"), np.searchsorted(b, a + tolerance, "right")
    # A pair is worth more than all lags together; so one number orders (pairs, lag), and sums stay exact enough.
    worth = 1.0 + tolerance * 2 * (1 + min(len(a), len(b)))
    rows: list[tuple[int, np.ndarray]] = [(0, np.zeros(1))]  # (j of its first cell, cells): before it 0 pairs more
    for t, lo, hi in zip(a, first, last, strict=True):
        base, cells = rows[-1]
        above = cells[np.clip(np.arange(lo, hi + 1) - base, 0, len(cells) - 1)]
        new = above.copy()
        new[1:] = np.maximum(above[1:], above[:-1] + worth - np.abs(b[lo:hi] - t))
        start = min(base, int(lo))
        whole = cells[np.clip(np.arange(start, max(base + len(cells) - 1, int(hi)) + 1) - base, 0, len(cells) - 1)].copy()
        whole[lo - start : hi + 1 - start] = new
        whole = np.maximum.accumulate(whole)
        keep = max(0, int(lo) - start)  # later times reach no further back
        rows.append((start + keep, whole[keep:]))
    pairs, j = [], len(b)
    for i in range(len(a), 0, -1):
        value = lambda row, j: rows[row][1][np.clip(j - rows[row][0], 0, len(rows[row][1]) - 1)]
        if value(i, j) == value(i - 1, j):
            continue
        while j > first[i - 1] + 1 and value(i, j - 1) == value(i, j):
            j -= 1
        j -= 1
        pairs.append((i - 1, j))
    return pairs[::-1]


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order as batches that end where a run ends; a run begins where `_first` is set, so many go to one call."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        cut = int(starts[-1]) if len(starts) else batch.num_rows
        held.append(batch.slice(0, cut))
        if len(starts):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = [batch.slice(cut)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def in_order(rows: DataFrame, stratum: list[str], order: list[str], gap: Column) -> DataFrame:
    """rows with `_first`, set where a run begins: at a stratum's first row and where gap holds. A stratum is in one partition, in order."""
    first = F.coalesce(gap, F.lit(True))
    return rows.withColumn("_first", first).sortWithinPartitions(*stratum, *order)  # the window's own order


def matched_sides(both: DataFrame, stratum: list[str], tolerance: float, every: bool = False) -> DataFrame:
    """stratum, a_key, b_key, lag (b - a) for rows stratum, _t, _key, _side (0, 1): as `optimal_match`.

    every: rows that have no partner come too, with the other key and the lag null.
    """
    fields = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in stratum), f"a_key {fields['_key']}", f"b_key {fields['_key']}", "lag double"])
    order = ["_t", "_side", "_key"]
    gap = F.col("_t") - F.lag("_t").over(W.partitionBy(*stratum).orderBy(*order)) > tolerance
    runs = in_order(both.select(*stratum, *order).dropna(subset=[*stratum, "_t"]), stratum, order, gap)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches):
            t, side = batch.column("_t").to_numpy(), batch.column("_side").to_numpy()
            run = np.cumsum(batch.column("_first").to_numpy(zero_copy_only=False)) - 1
            own = [np.flatnonzero(side == s) for s in (0, 1)]
            sizes = [np.bincount(run[i], minlength=batch.num_rows) for i in own]
            ends = [np.cumsum(n) for n in sizes]
            single = (sizes[0] == 1) & (sizes[1] == 1)  # neighbours that nothing cuts are a pair
            found = [np.column_stack([own[s][ends[s][single] - 1] for s in (0, 1)])]
            for r in np.flatnonzero((sizes[0] > 0) & (sizes[1] > 0) & ~single):
                x, y = (own[s][ends[s][r] - sizes[s][r] : ends[s][r]] for s in (0, 1))
                pairs = np.array(match_times(t[x], t[y], tolerance), int).reshape(-1, 2)
                found.append(np.column_stack([x[pairs[:, 0]], y[pairs[:, 1]]]))
            rows = np.concatenate(found)
            if every:
                for s, alone in enumerate((np.setdiff1d(own[0], rows[:, 0], True), np.setdiff1d(own[1], rows[:, 1], True))):
                    rows = np.concatenate([rows, np.column_stack([alone if s == 0 else np.full(len(alone), -1), alone if s else np.full(len(alone), -1)])])
            places = [pa.array(rows[:, s], pa.int64(), mask=rows[:, s] < 0) for s in (0, 1)]
            lag = pa.array(t[rows[:, 1]] - t[rows[:, 0]], mask=(rows < 0).any(1))
            owner = pa.array(rows.max(1))
            columns = [*(batch.column(c).take(owner) for c in stratum), *(batch.column("_key").take(i) for i in places), lag]
            yield pa.record_batch(columns, names=[*stratum, "a_key", "b_key", "lag"])

    return runs.mapInArrow(match, schema)


def optimal_match(a: DataFrame, b: DataFrame, stratum: list[str], time: str, key: str, tolerance: float) -> DataFrame:
    """stratum, a_key, b_key, lag (b - a): the best one-to-one matching within each stratum.

    The times of both sides are cut where none follows within the tolerance: no pair crosses such a gap, so what lies
    between two is matched apart, and a task holds one such run of times and a batch, not a stratum.

    Defined cases: a row with a null stratum or time has no pair; a side without rows gives no pairs.
    """
    side = lambda df, n: df.select(*stratum, F.col(time).cast("double").alias("_t"), F.col(key).alias("_key"), F.lit(n).alias("_side"))
    return matched_sides(side(a, 0).unionByName(side(b, 1)), stratum, tolerance)


def suppress(index: np.ndarray, score: np.ndarray, separation: float) -> np.ndarray:
    """Places kept by greedy suppression: stronger first, earlier on ties, at least `separation` from those kept."""
    kept: list[float] = []
    out = []
    for p in np.lexsort((index, -score)):
        at = np.searchsorted(kept, index[p])
        near = [abs(kept[k] - index[p]) for k in (at - 1, at) if 0 <= k < len(kept)]
        if all(d >= separation for d in near):
            kept.insert(int(at), index[p])
            out.append(p)
    return np.sort(np.array(out, int))


def select_peaks(scores: DataFrame, stratum: list[str], index: str, score: str, separation: float) -> DataFrame:
    """Rows of scores that greedy suppression keeps within each stratum.

    Places that far apart don't meet, so strata are cut into runs of nearer ones, of which a task holds one and a batch.

    Defined cases: a row with a null index takes no part; a null score is the weakest.
    """
    at = F.col(index).cast("double")
    rows = scores.withColumns({"_at": at, "_score": F.col(score).cast("double")}).where("_at IS NOT NULL")
    gap = F.col("_at") - F.lag("_at").over(W.partitionBy(*stratum).orderBy("_at")) >= separation
    names = scores.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches):
            at, score = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_at", "_score"))
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            ends = np.append(starts[1:], batch.num_rows)
            kept = [starts[ends - starts == 1]]
            for lo, hi in zip(starts, ends, strict=True):
                if hi - lo > 1:
                    kept.append(lo + suppress(at[lo:hi], score[lo:hi], separation))
            yield batch.take(pa.array(np.concatenate(kept))).select(names)

    return in_order(rows, stratum, ["_at"], gap).mapInArrow(run, scores.schema)
