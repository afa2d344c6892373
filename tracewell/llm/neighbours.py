"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes nearest point by one more coordinate, sqrt(largest squared norm - own squared norm).
Centroids are fitted by k-means on a bounded sample (at most `SAMPLE` vectors, by hash of the key), one for each `LIST`
vectors of the table and at most one for each two of the sample: lists keep their length until the table has `LIST` / 2
times as many vectors as the sample (a million, as it stands), and grow with the table from there; a larger sample moves
that point. Up to 4,096 centroids a vector's lists are exact, beyond they come from a walk of the graph, as a query's do.
Every vector goes to its
nearest centroid's list and, at the boundary, to each of the next few whose distance is within a ratio of the nearest.
Lists are cut into blocks of bounded size. A query walks a graph over the centroids held in memory, keeps every list whose
centroid's distance is within a ratio of the nearest, and is held against all blocks of these lists, block of queries by
block of vectors. A query's best among a few of the sample's vectors are candidates from the start, and the last of them
is a bound: blocks report only what reaches it. That ratio, a number of lists, and the number of replicas come from up to `ASKED` of the queries
themselves, by hash of the key, whose true neighbours one pass over the whole table finds: within them lie `TARGET` of
these neighbours, as the walk itself reads them, at the least reading. So queries unlike the indexed vectors get the lists
that they need; clustered vectors are found in a few lists, and vectors without structure, whose neighbours are scattered
over many, in many: recall is kept, and the work is what the data ask for.

Equal vectors are one entry with the k + 1 smallest of their keys: no result holds more of them, whatever their number.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null key; of rows with equal keys the one with the least vector (by components) counts; a query
with fewer candidates than k gets all found; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, partitions
from tracewell.session import table

#: Vectors that the fit reads at most, vectors of the table to a centroid, and centroids at most.
SAMPLE, LIST, CENTROIDS = 40_000, 50, 65_536
#: Lists that may hold a vector at most (one of these is chosen), and how much farther than the nearest their centroids may be.
REPLICAS, REPLICA_RATIO = (2, 4), 1.15
#: Share of the true neighbours that the lists read must hold, and queries that are asked for it.
TARGET, ASKED = 0.95, 256
#: Vectors of the sample that every query is held against first, and bytes of them, at most.
SEEDS, SEED_BYTES = 16_384, 16 << 20
BLOCK = 2048


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """k centroids; where k is large, of the clusters of a coarse clustering, so that work stays below n k."""
    if k > 1024:
        coarse = k_means(x, round(k**0.5), rng)
        own = nearest(x, coarse)
        parts = [np.flatnonzero(own == c) for c in range(len(coarse))]
        shares = [max(1, round(k * len(p) / len(x))) for p in parts]
        return np.concatenate([k_means(x[p], min(n, len(p)), rng) for p, n in zip(parts, shares, strict=True) if len(p)])
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        some = n > 0
        centroids[some] = total[some] / n[some, None]
        centroids[~some] = x[rng.integers(0, len(x), int((~some).sum()))]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])


@dataclass
class Index:
    """Centroids, their graph, the largest squared norm; lists that hold a vector; ratio of distances and number of lists to read."""

    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    norm: float
    replicas: int = 1
    ratio: float = 1.0
    most: int = 1

    @classmethod
    def fit(cls, vectors: np.ndarray, norm: float, count: int, neighbours: int = 20, target: float = TARGET, degree: int = 24, truth: Truth | None = None) -> Index:
        """An index of a sample of vectors; without the truth on some queries, the first of the sample are asked about the others."""
        x = lift(vectors, norm)
        rng = np.random.default_rng(11)
        centroids = k_means(x, max(1, min(count, len(x) // 2, CENTROIDS)), rng)
        k = len(centroids)
        near = np.concatenate([closest(distances(centroids[i : i + 512], centroids), degree + 1)[:, 1:] for i in range(0, k, 512)])
        if near.shape[1]:  # long links too, so that no part is cut off
            near = np.hstack([near, rng.integers(0, k, (k, 4))])
        index = cls(centroids, near, rng.permutation(k)[: max(1, min(k, 32))], norm)
        if truth is None:
            truth = Truth.among(vectors[rng.permutation(len(x))], norm, neighbours)
        if not len(truth.owner):
            return index
        cost = {}
        for index.replicas in REPLICAS:
            cost[index.replicas] = index.calibrate(vectors, truth, target)
        _, index.replicas, index.ratio, index.most = min((reads, r, ratio, most) for r, (reads, ratio, most) in cost.items())
        return index

    def calibrate(self, vectors: np.ndarray, truth: Truth, target: float) -> tuple[float, float, int]:
        """(vectors and lists read, ratio, most lists) so that `target` of the true neighbours are read, as `probes` reads."""
        k, owner, asked = len(self.centroids), truth.owner, flat(truth.asked, self.norm)
        far = np.sqrt(np.maximum(distances(asked, self.centroids), 0))
        place = np.argsort(np.argsort(far, 1, kind="stable"), 1, kind="stable")
        own, held = self.lists_of(truth.near)
        first = far.min(1)[owner]
        # A list as near as the nearest has the ratio 1, also where that is 0.
        ratios = np.where(held, np.where(far[owner[:, None], own] > first[:, None], far[owner[:, None], own] / np.maximum(first[:, None], 1e-300), 1.0), np.inf).min(1)
        ranks = np.where(held, place[owner[:, None], own], k).min(1)
        filled = np.zeros(k)
        for i in range(0, len(vectors), 4096):
            lists, keep = self.lists_of(vectors[i : i + 4096])
            filled += np.bincount(lists[keep], minlength=k)
        most_read = None
        for lost in ((1 - target) / 2, (1 - target) / 4, (1 - target) / 16, 0.0):  # each bound alone may lose half of what may be lost
            self.ratio, self.most = float(upper_quantile(ratios, truth.weight, 1 - lost)), int(upper_quantile(ranks, truth.weight, 1 - lost)) + 1
            read = np.zeros((len(asked), k), bool)
            for i in range(0, len(asked), step := self.step()):
                rows, lists = self.probes(asked[i : i + step])
                read[i + rows, lists] = True
            found = (read[owner[:, None], own] & held).any(1)
            most_read = float((read @ (filled + 20)).mean()), self.ratio, self.most  # a list costs as much as 20 vectors
            if found @ truth.weight >= target * truth.weight.sum():
                return most_read
        # The walk or the numbers' precision loses more than that: every list is read.
        self.ratio, self.most = np.inf, k
        return float((filled + 20).sum()), self.ratio, self.most

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, which of them hold it) for each vector."""
        x = lift(vectors, self.norm)
        n = min(self.replicas, len(self.centroids))
        if len(self.centroids) <= 4096:
            lists, far = [], []
            for i in range(0, len(x), 4096):
                d = distances(x[i : i + 4096], self.centroids)
                lists.append(np.argpartition(d, n - 1, 1)[:, :n])
                far.append(np.take_along_axis(d, lists[-1], 1))
            lists, far = np.concatenate(lists), np.maximum(np.concatenate(far), 0)
        else:
            walked = [self.walk(x[i : i + 512], n, 64) for i in range(0, len(x), 512)]
            lists, far = np.concatenate([w[0] for w in walked]), np.maximum(np.concatenate([w[1] for w in walked]), 0)
        return lists, far <= REPLICA_RATIO**2 * far.min(1)[:, None] + 1e-12

    def step(self) -> int:
        """Queries that a walk takes at once: it may keep a place for each centroid."""
        return max(16, min(512, (1 << 21) // len(self.centroids)))

    def probes(self, queries: np.ndarray, found: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists to read for each lifted query, by walks that widen as far as needed."""
        rows, out = np.arange(len(queries)), []
        if self.most >= len(self.centroids) and not np.isfinite(self.ratio):
            return np.repeat(rows, len(self.centroids)), np.tile(np.arange(len(self.centroids)), len(rows))
        while len(rows):
            lists, far = self.walk(queries[rows], found)
            near = (far <= self.ratio**2 * np.maximum(far[:, :1], 0) + 1e-12) & (np.arange(far.shape[1]) < self.most)
            open_ = near[:, -1] & (found < min(self.most, len(self.centroids)))
            r, c = np.nonzero(near & ~open_[:, None])
            out.append((rows[r], lists[r, c]))
            rows, found = rows[open_], min(2 * found, len(self.centroids))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def walk(self, queries: np.ndarray, found: int, breadth: int = 0, beam: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) nearest to each lifted query, by search of the graph from the nearest ones, nearest first."""
        rows, k = len(queries), len(self.centroids)
        found = min(found, k)
        breadth = min(k, max(breadth, found + found // 2))
        pool, far = np.full((rows, breadth), -1, np.int64), np.full((rows, breadth), np.inf)
        seen, done = np.zeros((rows, k), bool), np.zeros((rows, breadth), bool)
        new = np.broadcast_to(self.entry, (rows, len(self.entry)))
        live = np.arange(rows)
        norms = (self.centroids**2).sum(1)
        while len(live):
            new = np.sort(new, 1)
            fresh = ~seen[live[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[live[:, None], new] = True
            d = np.full(new.shape, np.inf)
            r, c = np.nonzero(fresh)
            d[r, c] = norms[new[r, c]] - 2 * np.einsum("nd,nd->n", queries[live[r]], self.centroids[new[r, c]])
            all_d, all_c = np.hstack([far[live], d]), np.hstack([pool[live], new])
            all_done = np.hstack([done[live], np.zeros_like(fresh)])
            best = np.argsort(all_d, 1, kind="stable")[:, :breadth]
            far[live], pool[live] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_c, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(far[live])
            live = live[~done[live].all(1)]
            if not len(live) or not self.graph.shape[1]:
                break
            ahead = np.argsort(done[live], 1, kind="stable")[:, :beam]  # the nearest that weren't looked at; done ones do no harm
            np.put_along_axis(view := done[live], ahead, True, 1)
            done[live] = view
            new = self.graph[pool[live[:, None], ahead]].reshape(len(live), -1)
        return pool[:, :found], far[:, :found] + (queries**2).sum(1)[:, None]


@dataclass
class Truth:
    """Queries and their true neighbours: vector near[i] belongs to query owner[i] and counts as weight[i] of its results."""

    asked: np.ndarray
    owner: np.ndarray
    near: np.ndarray
    weight: np.ndarray

    @classmethod
    def among(cls, vectors: np.ndarray, norm: float, neighbours: int) -> Truth:
        """The first vectors as queries, the others as candidates."""
        asked, n = vectors[:ASKED], min(neighbours, len(vectors) - 1)
        score = asked @ vectors.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argpartition(-score, n - 1, 1)[:, :n] if n > 0 else np.zeros((len(asked), 0), np.int64)
        return cls(asked, np.repeat(np.arange(len(asked)), near.shape[1]), vectors[near.ravel()], np.ones(near.size))


def closest(d: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least of each row, the least first."""
    n = min(n, d.shape[1])
    some = np.argpartition(d, n - 1, 1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def upper_quantile(values: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The least value that `share` of the weight doesn't exceed."""
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weight[order])
    return values[order][min(len(order) - 1, int(np.searchsorted(sums, share * sums[-1] - 1e-9)))]


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that makes all their norms equal."""
    return np.hstack([vectors, np.sqrt(np.maximum(0, norm - (vectors**2).sum(1)))[:, None]])


def flat(queries: np.ndarray, norm: float) -> np.ndarray:
    """Queries at the indexed vectors' scale, with 0 for that coordinate."""
    scale = np.sqrt(norm) / np.maximum(np.sqrt((queries**2).sum(1)), 1e-300)
    return np.hstack([queries * scale[:, None], np.zeros((len(queries), 1))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def prepare(rows: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(entries: entry, vector, keys; members: entry, key). An entry is a distinct vector, named by its smallest key."""
    good = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("key").isNotNull())
    good = good.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))  # -0.0 is 0.0
    width = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("vector") == (width["n"] if width else 0)).groupBy("key").agg(F.min("vector").alias("vector"))
    hashed = materialize(good.withColumn("h", F.md5(F.to_json("vector"))), "vectors")
    nth = W.partitionBy("h").orderBy("key")
    few = hashed.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)
    entries = few.groupBy("h").agg(F.min("key").alias("entry"), F.first("vector").alias("vector"), F.array_sort(F.collect_list("key")).alias("keys"))
    entries = materialize(entries, "entries")
    members = hashed.select("key", "h").join(entries.select("h", "entry"), "h").select("entry", "key")
    return entries.drop("h"), members


def true_neighbours(entries: DataFrame, queries: DataFrame, k: int) -> Truth:
    """The truth on up to `ASKED` of the queries, by hash of the entry: every task keeps the k + 1 best of its entries for each."""
    some = queries.orderBy(F.xxhash64("entry"), "entry").limit(ASKED).toArrow()
    if not some.num_rows:
        return Truth(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0))
    names, asked = some.column("entry").to_numpy(), matrix(some.column("vector"))
    shared = entries.sparkSession.sparkContext.broadcast((names, asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        score = np.zeros((len(q), 0))
        entry, copies = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                e, n = (batch.column(c).to_numpy()[None, :].repeat(len(q), 0) for c in ("entry", "copies"))
                n = n - (e == own[:, None])  # a query isn't its own candidate
                score, entry, copies = np.hstack([score, np.where(n > 0, q @ matrix(batch.column("vector")).T, -np.inf)]), np.hstack([entry, e]), np.hstack([copies, n])
                top = closest(-score, k + 1)
                score, entry, copies = (np.take_along_axis(v, top, 1) for v in (score, entry, copies))
        r, c = np.nonzero(copies > 0)
        yield pa.record_batch([pa.array(r), pa.array(entry[r, c]), pa.array(score[r, c]), pa.array(copies[r, c])], names=["owner", "entry", "score", "copies"])

    found = entries.select("entry", "vector", F.size("keys").cast("long").alias("copies")).mapInArrow(best, "owner long, entry long, score double, copies long")
    order = W.partitionBy("owner").orderBy(F.desc("score"), "entry")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = found.withColumn("weight", F.least(F.col("copies"), k - before)).where("weight > 0")
    near = materialize(counted.select("owner", "entry", "weight"), "truth").join(entries.select("entry", "vector"), "entry").toArrow()
    if not near.num_rows:
        return Truth(asked, np.zeros(0, np.int64), asked[:0], np.zeros(0))
    return Truth(asked, near.column("owner").to_numpy(), matrix(near.column("vector")), near.column("weight").to_numpy().astype(np.float64))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    list_size: int = LIST,
    target: float = TARGET,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product found for each row that is_query marks.

    is_query is an expression of a column `key`.
    """
    spark = rows.sparkSession
    entries, members = prepare(rows, key, vector, k)
    size = entries.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)).alias("m"), F.count("*").alias("n")).first()
    norm = size["m"]
    schema = "query_id long, rank int, vec_id long, score double"
    if norm is None:
        return spark.createDataFrame([], schema)
    asked = materialize(members.where(is_query), "asked")
    queries = materialize(entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "vector"), "queries")
    share = F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < F.lit(-(-(sample << 30) // size["n"]))  # all, if no more than `sample`
    drawn = entries.where(share).toArrow()
    if not drawn.num_rows:  # the hash may pass over a few vectors, not over many
        drawn = entries.limit(1).toArrow()
    taken = matrix(drawn.column("vector"))
    few = max(1, min(SEEDS, size["n"] // 8, SEED_BYTES // (8 * taken.shape[1])))  # the lists, not these, find the neighbours
    seeds = spark.sparkContext.broadcast((taken[:few].copy(), drawn.column("keys").slice(0, few).to_pylist()))
    del drawn
    fitted = Index.fit(taken, norm, size["n"] // list_size, k, target, truth=true_neighbours(entries, queries, k))
    del taken
    index = spark.sparkContext.broadcast(fitted)  # at most `CENTROIDS` centroids, and half as many as `sample`

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near, keep = at.lists_of(matrix(batch.column("vector")))
            r, c = np.nonzero(keep)
            yield pa.record_batch([batch.column("entry").take(pa.array(r)), batch.column("vector").take(pa.array(r)), batch.column("keys").take(pa.array(r)), pa.array(near[r, c].astype(np.int32))], names=["entry", "vector", "keys", "list"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, keys = seeds.value
        many = np.array([len(v) for v in keys])
        every = np.array([v for vs in keys for v in vs], np.int64)
        starts = np.cumsum(many) - many
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                q = matrix(batch.column("vector"))
                top = closest(-(q @ x.T), k + 1)
                score = (q[:, None, :] * x[top]).sum(2)
                # Of k + 1 vectors one may be the query's own; the bound is less by what sums of unlike order may differ.
                bound = score.min(1) - 1e-10 * np.sqrt(norm * (q**2).sum(1)) if top.shape[1] == k + 1 else np.full(len(q), -np.inf)
                near = [[{"vec_id": v, "score": s} for c, s in zip(row, scores, strict=True) for v in every[starts[c] : starts[c] + many[c]].tolist()] for row, scores in zip(top.tolist(), score.tolist(), strict=True)]
                yield pa.record_batch([batch.column("entry"), batch.column("vector"), pa.array(bound), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))], names=["query", "vector", "bound", "near"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for whole in batches:
            for lo in range(0, whole.num_rows, at.step()):
                batch = whole.slice(lo, at.step())
                r, lists = at.probes(flat(matrix(batch.column("vector")), at.norm))
                yield pa.record_batch([*(batch.column(c).take(pa.array(r)) for c in ("query", "vector", "bound")), pa.array(lists.astype(np.int32))], names=["query", "vector", "bound", "list"])

    postings = materialize(entries.mapInArrow(deal, "entry long, vector array<double>, keys array<long>, list int"), "postings")
    seeded = materialize(queries.mapInArrow(seed, "query long, vector array<double>, bound double, near array<struct<vec_id: long, score: double>>"), "seeded")
    routed = materialize(seeded.select("query", "vector", "bound").mapInArrow(route, "query long, vector array<double>, bound double, list int"), "routed")
    # Blocks: a list of n vectors and m queries makes ceil(n / BLOCK) x ceil(m / BLOCK) cells of bounded size.
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = materialize(blocks(postings, "rows").join(blocks(routed, "columns"), "list"), "grid")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = postings.join(grid, "list").withColumn("row", own("entry", "rows")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    right = routed.join(grid, "list").withColumn("column", own("query", "columns")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    cell = ["list", "row", "column"]

    def hold(vectors: pa.Table, asked_: pa.Table) -> pa.Table:
        out_schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not vectors.num_rows or not asked_.num_rows:
            return out_schema.empty_table()
        x, q = matrix(vectors.column("vector")), matrix(asked_.column("vector"))
        keys = vectors.column("keys").to_pylist()
        many = np.array([len(v) for v in keys])
        every = np.array([v for vs in keys for v in vs], np.int64)
        starts = np.cumsum(many) - many
        query, bound = asked_.column("query").to_numpy(), asked_.column("bound").to_numpy()
        parts: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(q), 256):
            score = q[lo : lo + 256] @ x.T
            n = min(k + 1, score.shape[1])
            cut = np.partition(score, score.shape[1] - n, 1)[:, score.shape[1] - n]
            cut = np.maximum(cut - 1e-9 * np.abs(cut), bound[lo : lo + 256])
            r, c = np.nonzero(score >= cut[:, None])  # ties at the end stay
            exact = (q[lo + r] * x[c]).sum(1)
            rep = many[c]
            at = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(starts[c], rep)
            rows_, ids, scores = np.repeat(query[lo + r], rep), every[at], np.repeat(exact, rep)
            order = np.lexsort((ids, -scores, rows_))
            rows_, ids, scores = rows_[order], ids[order], scores[order]
            first = np.searchsorted(rows_, rows_, side="left")
            keep = np.arange(len(rows_)) - first <= k
            for part, v in zip(parts, (rows_[keep], ids[keep], scores[keep]), strict=True):
                part.append(v)
        return pa.table([pa.array(np.concatenate(p)) for p in parts], schema=out_schema)

    left = left.select("entry", "vector", "keys", "list", "row", "column")
    right = right.select("query", "vector", "bound", *(F.col(c).alias(f"{c}_") for c in cell))
    found = left.groupBy(*cell).cogroup(right.groupBy(*(f"{c}_" for c in cell))).applyInArrow(hold, "query long, vec_id long, score double")
    found = found.unionByName(seeded.select("query", F.explode("near").alias("n")).select("query", "n.vec_id", "n.score"))
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))  # replicas find a vector more than once
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))).alias("near"))
    each = asked.join(lists, asked["entry"] == lists["query"])
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("key")), 1, k)
    rows_ = each.select(F.col("key").alias("query_id"), F.posexplode(others).alias("at", "n"))
    return rows_.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0)
