"""Near duplicates by ProbMinHash: signatures of weighted shingles, banding, verification, classes.

A document is the multiset of its five-word shingles (lower case, split at ASCII white space; a shorter text is one
shingle), a shingle weighs its count. Every shingle is a Poisson process with its weight as the rate; arrivals fall on
registers, and a register keeps the shingle that arrives first. A process stops at the first arrival later than every
register, so a document costs about m log m arrivals, whatever its length. Two registers agree with the probability
Jaccard of the two multisets. Bands of registers make buckets; a pair of different texts in a bucket is linked if its
exact probability Jaccard is at least the threshold, and classes are the connected components of links and equal texts.

Within a bucket every member is held against a pivot, the member with the most bucket mates. Members of buckets that
then still span several classes are joined on the rarest shingles, by a rule that loses no pair that can be linked: in
rounds, in which a shingle's holders meet one, then some more of its other holders, those first that can be nearest; classes
that a round links meet no more. So the pairs of a large bucket are never all made,
pairs inside a class are not made at all, and no partner, candidate or bucket is capped.

A node is a distinct text, named by its MD5; so copies are one node however many there are.

Defined cases: a null text counts as the empty text, and empty texts are copies of each other; rows with equal keys and
unlike texts are documents of their own; a null key gets a class (its class_id is the smallest key in it, null if there is
none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, materialize, releasing, scramble, small
from tracewell.llm.graph import components
from tracewell.session import table

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 8
#: Cells of a set's shape, by the high bits of its shingles.
SHAPE_BITS = 7
_M = 0xFFFFFFFFFFFFFFFF


def word_hashes(text: Column) -> Column:
    """array<long>: a hash of each word."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(lists: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of lists of word hashes: (list, shingle, count), by list and shingle."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    n = np.diff(offsets)
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), made)
    at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(offsets[:-1], made)
    size = np.minimum(n, k)[owner]
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            live = size > j
            value[live] = scramble(value[live] * np.uint64(0x9E3779B97F4A7C15) + words[at[live] + j] + np.uint64(j + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(value)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, lists: int, m: int) -> np.ndarray:
    """[lists, m] registers: the element whose Poisson process (rate: its weight) reaches the register first."""
    first = np.full(lists * m, np.inf)
    sign = np.zeros(lists * m, np.uint64)
    time, scale = np.zeros(len(element)), 1.0 / weight
    latest = np.full(lists, np.inf)
    step = 0
    while len(element):
        step += 1
        with np.errstate(over="ignore"):
            u = scramble(element + np.uint64(step * 0x9E3779B97F4A7C15 & _M))
            slot = (scramble(u ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64) + owner * m
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * scale
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        sign[slot[won]] = element[won]
        if step < 4 or step % 4 == 0:  # how late a list's slowest register is
            some = np.unique(owner) if step > 16 else np.arange(lists)
            latest[some] = first.reshape(lists, m)[some].max(1)
        go = time < latest[owner]
        element, owner, time, scale = element[go], owner[go], time[go], scale[go]
    return sign.reshape(lists, m)


def bands(sign: np.ndarray, count: int, rows: int) -> np.ndarray:
    """[lists, count] bucket hashes."""
    out = np.zeros((len(sign), count), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + sign[:, r::rows][:, :count])
        return scramble(out + (np.arange(count, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    (xa, wa), (xb, wb) = a, b
    every = np.union1d(xa, xb)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, xa)] = wa
    q[np.searchsorted(every, xb)] = wb
    shared = (p > 0) & (q > 0)
    if not shared.any():
        return 0.0
    ratio, many = np.unique(np.stack([p[shared], q[shared]]), axis=1, return_counts=True)
    return float(sum(n / np.maximum(p / x, q / y).sum() for (x, y), n in zip(ratio.T, many, strict=True)))


def prefixes(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, shingle, before, rarer, nth, shape, unit, distinct, total: the rarest shingles of nodes. open_: node, class.

    With weights scaled to 1, the probability Jaccard is at most the weight of the common shingles. So if it reaches the
    threshold, the rarest common shingle is, on either side, among the rarest ones whose weight exceeds 1 - threshold: no
    pair that can be linked is lost. Those that one class alone holds are left out. before: the weight of the rarer ones;
    rarer: those of them that are here too; nth: place by `before` among the shingle's holders.
    """
    own = sets.join(small(open_), "node").select("node", "class", F.explode(F.arrays_zip("elements", "weights")).alias("s"))
    own = own.select("node", "class", F.col("s.elements").alias("shingle"), F.col("s.weights").alias("weight"))
    common = own.groupBy("shingle").agg(F.count("*").alias("holders"))
    by_node = W.partitionBy("node")
    rarer = F.sum("weight").over(by_node.orderBy("holders", "shingle").rowsBetween(W.unboundedPreceding, -1))
    ranked = own.join(common, "shingle").withColumn("before", F.coalesce(rarer, F.lit(0)) / F.sum("weight").over(by_node))
    prefix = ranked.where(F.col("before") <= 1 - threshold + 1e-9).select("node", "class", "shingle", "before")
    prefix = materialize(prefix, "prefix")
    several = prefix.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("shingle")
    several = small(materialize(several, "several"))
    order = W.partitionBy("shingle").orderBy("before", "node")
    prefix = prefix.join(several, "shingle", "left_semi").withColumn("nth", F.row_number().over(order) - 1)
    rarer = F.collect_list("shingle").over(by_node.orderBy("before").rowsBetween(W.unboundedPreceding, -1))
    total = F.aggregate("weights", F.lit(0).cast("long"), lambda n, w: n + w)
    whole = sets.select("node", "shape", "unit", F.size("elements").alias("distinct"), total.alias("total"))
    return prefix.select("node", "shingle", "before", rarer.alias("rarer"), "nth").join(whole, "node")


def link_classes(open_: DataFrame, sets: DataFrame, done: DataFrame, threshold: float) -> list[DataFrame]:
    """Links (a, b) between classes of open nodes that share a prefix shingle, as tables. done: pairs that were verified.

    A round takes, at each shingle, the next holders by the weight before it, and makes pairs of them with the later
    holders of other classes, each pair at its rarest common shingle. There the weights x and y before it are not
    common, so the similarity is at most (1 - x)(1 - y) / (1 - xy). Two sets can't have more elements in common than the
    sum over cells of the smaller of their shapes; what is left of either is not common, and weighs at least 1 an element,
    which bounds x and y too. Pairs for which the similarity is too small aren't made. A round takes at least twice as many
    holders as the round before, and more if that made few pairs beside the nodes. Shingles whose holders were all taken,
    or are of one class by now, aren't read by later rounds; classes and shingles go to the rows where they are few, and
    only the sets that pairs name are dealt out to be verified, so a round ships what it compares.
    """
    rows, found = materialize(prefixes(open_, sets, threshold), "prefixes"), []
    below = lambda x, y: f"(1 - {x}) * (1 - {y}) >= {threshold} * (1 - {x} * {y}) - 1e-9"
    x, y = (f"greatest({n}_before, ({n}_distinct - o) / {n}_total)" for n in "ab")
    both = "aggregate(zip_with(a_shape, b_shape, (p, q) -> least(p * a_unit, q * b_unit)), 0, (s, v) -> s + v)"
    near = f"{below('a_before', 'b_before')} AND NOT arrays_overlap(a_rarer, b_rarer) AND exists(array({both}), o -> {below(x, y)})"
    once = "a_nth > b_nth"  # else it was made when a was among the holders taken
    lo, wide, classes, nodes = 0, 1, open_, open_.count()
    while True:
        classed = rows.join(small(classes), "node")
        several = classed.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.max("nth").alias("last"))
        several = materialize(several.where(f"least < most AND last > {lo}").select("shingle"), "several")
        if not several.limit(1).count():
            return found
        live = materialize(classed.join(small(several), "shingle", "left_semi"), "live")
        rows = live.drop("class")
        side = lambda n: live.select("shingle", F.col("node").alias(n), F.col("class").alias(f"{n}_class"), F.col("before").alias(f"{n}_before"), *(F.col(c).alias(f"{n}_{c}") for c in ("rarer", "nth", "shape", "unit", "distinct", "total")))
        heads = side("b").where(F.col("b_nth").between(lo, lo + wide - 1))
        pairs = side("a").where(F.col("a_nth") > lo).join(heads, "shingle").where(f"a_class != b_class AND {once} AND {near}")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("a_class", "b_class").alias("one"), F.greatest("a_class", "b_class").alias("other")).distinct()
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
        linked = verify(pairs.select("a", "b"), sets.join(small(named), "node", "left_semi"), threshold).where("linked").select("a", "b")
        links = materialize(linked.join(pairs, ["a", "b"]).select("a", "b", "one", "other"), "links")
        if links.limit(1).count():
            found.append(links.select("a", "b"))
            merged = components(links.select(F.col("one").alias("a"), F.col("other").alias("b")))
            classes = classes.join(merged.withColumnRenamed("node", "class"), "class", "left")
            classes = materialize(classes.select("node", F.coalesce("component", "class").alias("class")), "classes")
        lo, wide = lo + wide, wide * max(2, 8 * nodes // max(1, pairs.count()))


def sign_documents(docs: DataFrame, k: int, count: int, rows: int) -> DataFrame:
    """docs (doc_id, digest, words) with `bands` in place of words; without words there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                words = pa.concat_arrays([batch.column("words")])
                owner, element, weight = shingles(words, k)
                sign = signatures(owner, element, weight, batch.num_rows, count * rows)
                keys = bands(sign, count, rows).view(np.int64)
                some = np.zeros(batch.num_rows, bool)
                some[owner] = True
                offsets = np.concatenate([[0], np.cumsum(some * count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
                yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), lists], names=["doc_id", "digest", "bands"])

    return docs.mapInArrow(releasing(run), "doc_id long, digest binary, bands array<long>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with `linked`: whether their probability Jaccard reaches the threshold. sets: node, elements, weights."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("elements").alias(f"e{c}"), F.col("weights").alias(f"w{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for row in zip(*(batch.column(c) for c in ("ea", "wa", "eb", "wb")), strict=True):
                ea, wa, eb, wb = (x.values.to_numpy(zero_copy_only=False) for x in row)
                linked.append(probability_jaccard((ea.view(np.uint64), wa), (eb.view(np.uint64), wb)) >= threshold)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(releasing(run), "a binary, b binary, linked boolean")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (node, words) as node, elements (sorted as unsigned numbers), weights, shape, unit.

    shape: how many elements a cell has, in units, rounded up; a unit is one element unless a cell has more than a byte holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, element, weight = shingles(pa.concat_arrays([batch.column("words")]), k)
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (element.view(np.int64), weight.astype(np.int32))]
            cells = 1 << SHAPE_BITS
            shape = np.bincount(owner * cells + (element >> np.uint64(64 - SHAPE_BITS)).astype(np.int64), minlength=batch.num_rows * cells).reshape(-1, cells)
            unit = np.maximum(1, -(-shape.max(1, initial=0) // 127))
            shape = -(-shape // unit[:, None])
            lists.append(pa.FixedSizeListArray.from_arrays(pa.array(shape.ravel().astype(np.int8)), cells).cast(pa.list_(pa.int8())))
            yield pa.record_batch([batch.column("node"), *lists, pa.array(unit.astype(np.int32))], names=["node", "elements", "weights", "shape", "unit"])

    return docs.select("node", "words").mapInArrow(releasing(run), "node binary, elements array<long>, weights array<int>, shape array<tinyint>, unit int")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = SHINGLE,
    threshold: float = THRESHOLD,
    count: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, class_id (the smallest key of its class), class_size of every document."""
    grouped = classes_of(docs, key, text, k, threshold, count, rows)
    # Written, so that the join has exchanges of its own and can split a class that holds a large part of all rows.
    classes = materialize(grouped.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return grouped.join(classes, "class").select("doc_id", "class_id", "class_size")


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each class the row with the smallest key stays, a null key only if all are null."""
    kept = classes_of(docs, key, text).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("kept"))
    kept = kept.select(F.col("kept.digest").alias("kept_digest"), F.col("kept.doc_id").alias("kept_key"))
    name = "kept_digest"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, digest_of(F.col(text)))
    same = (rows[name] == kept["kept_digest"]) & rows[key].cast("long").eqNullSafe(kept["kept_key"])
    return rows.join(kept, same, "left_semi").dropDuplicates([name]).drop(name)


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest, class (the smallest digest of its class) of every document."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), digest_of(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    worded = lambda df: df.withColumn("words", word_hashes(F.col("text"))).drop("text")
    signed = materialize(sign_documents(worded(plain), k, count, rows), "signed")
    # A text is read again where its smallest key stands, once for all its copies.
    first = F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first")
    texts = materialize(signed.groupBy("digest").agg(F.first("bands").alias("bands"), first), "texts")
    nodes = texts.select(F.col("digest").alias("node"), F.explode("bands").alias("bucket"))
    # A node has one row in a bucket, so a bucket of several rows has several nodes. Most have one: their rows stay where they are.
    shared = materialize(nodes.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1"), "shared")
    held_in = materialize(nodes.join(small(shared), "bucket"), "held")
    # A node with many bucket mates is the likeliest to be near them all: it makes the best pivot.
    degrees = held_in.groupBy("node").agg((-F.sum("mates")).alias("degree"))
    members = materialize(held_in.select("bucket", "node").join(degrees, "node").select("bucket", "node", F.struct("degree", "node").alias("place")), "members")
    asked = members.select(F.col("node").alias("digest")).distinct()
    wanted = small(materialize(texts.select("digest", "first").join(asked, "digest", "left_semi"), "wanted"))
    keyed = plain.select("digest", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("first"), "text")
    once = keyed.join(wanted, ["digest", "first"]).dropDuplicates(["digest", "first"])
    sets = materialize(shingle_sets(worded(once.select(F.col("digest").alias("node"), "text")), k), "sets")
    # First every member of a bucket is held against its pivot.
    pivots = members.groupBy("bucket").agg(F.min("place").alias("first")).select("bucket", F.col("first.node").alias("pivot"))
    pairs = members.join(pivots, "bucket").where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    found = materialize(verify(pairs, sets, threshold), "verified")
    links = found.where("linked").select("a", "b")
    labels = components(links)
    # Then members of buckets that still span several classes are joined by the shingles they must share.
    classed = members.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
    spread = classed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket")
    open_ = materialize(classed.join(spread, "bucket", "left_semi").select("node", "class").distinct(), "open")
    if open_.limit(1).count():
        more = link_classes(open_, sets, found.select("a", "b"), threshold)
        for m in more:
            links = links.union(m)
        if more:
            labels = components(links)
    grouped = signed.select("doc_id", "digest").join(labels.select(F.col("node").alias("digest"), "component"), "digest", "left")
    return materialize(grouped.select("doc_id", "digest", F.coalesce("component", "digest").alias("class")), "grouped")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
