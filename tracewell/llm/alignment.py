"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Both sides' tokens are ranges of the bytes of a space and the text. For each token's start, an as-of join finds the other
side's covering token, in one batch for many documents, keyed by document; both directions together are all overlaps, and
overlaps with equal ends cut the text into groups, the smallest runs of tokens that cover the same bytes on either side.
The last tokens of a group are linked.

Links are counted over the corpus in two steps. A chunk of documents has a row: its distinct id pairs with their counts,
and for each document which of them it has. Pairs are summed over chunks, and a chunk gets the sums of its own pairs back;
so neither occurrences nor documents are shuffled by pair, and no key has more rows than there are chunks.

Defined cases: a text that is null, empty, or that either side doesn't keep byte for byte has no tokens (zeros); rows with
equal keys are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, byte_slices, materialize, releasing
from tracewell.llm.tokens import plain_encoder, vocabulary
from tracewell.session import table

#: Bytes of text that are aligned at once (unless one text is longer), tokens that an as-of join takes at once, links of a chunk.
TEXT_BYTES, JOINED, CHUNK_LINKS = 2 << 20, 1 << 19, 1 << 21
ALIGNED = "doc_id long, a array<int>, b array<int>, a_stops array<int>, b_stops array<int>, n_overlaps long"
CHUNKS = (
    "chunk long, codes array<long>, counts array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_overlaps array<long>, sha array<string>, pairs array<int>, at array<int>, times array<int>"
)


class Side:
    """One tokenizer: ids of texts, and the bytes of ids."""

    def __init__(self, path: str, space: bool):
        self.encoder, self.space = plain_encoder(path), space
        self.length = np.array(list(map(len, self.encoder.token_bytes())), np.int64)
        if not self.length.all():
            raise ValueError(f"{path} has an id without bytes")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """(ids of each text, whether their bytes are those of a space and the text)."""
        given = [" " + t for t in texts] if self.space else texts
        ids = self.encoder.encode(given)
        return ids, list(map(self.encoder.keeps, given, ids))


def covering(start: np.ndarray, doc: np.ndarray, other_start: np.ndarray, other_doc: np.ndarray) -> np.ndarray:
    """For each token, the other side's token of the same document that covers its start. Starts ascend over all documents."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(start), JOINED):
        own = slice(at, min(at + JOINED, len(start)))
        low = max(0, int(np.searchsorted(other_start, start[own][0], "right")) - 1)
        high = int(np.searchsorted(other_start, start[own][-1], "right"))
        left = pd.DataFrame({"start": start[own], "doc": doc[own]})
        right = pd.DataFrame({"start": other_start[low:high], "doc": other_doc[low:high], "token": np.arange(low, high)})
        found.append(pd.merge_asof(left, right, on="start", by="doc")["token"].to_numpy(np.int64))
    return np.concatenate(found)


def overlaps(a_length: np.ndarray, a_doc: np.ndarray, b_length: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, whether they end together) of all tokens that share bytes, by a's token, then b's."""
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    a_start, b_start = a_end - a_length, b_end - b_length
    b_of = covering(a_start, a_doc, b_start, b_doc)
    a_of = covering(b_start, b_doc, a_start, a_doc)
    new = a_start[a_of] != b_start if len(a_of) else np.zeros(0, bool)  # those that start together have found each other already
    a, b = np.append(np.arange(len(a_end)), a_of[new]), np.append(b_of, np.flatnonzero(new))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return a, b, a_end[a] == b_end[b]


def _ints(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a, b (ids of both sides), a_stops, b_stops (after which token of either side each group ends), n_overlaps of every document.

    Side a codes a space and the text, side b the text, in front of which its tokenizer puts a space itself.
    """
    return _texts(docs, key, text).mapInArrow(releasing(_aligner(path_a, path_b)), ALIGNED)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _aligner(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of doc_id, text to batches of ALIGNED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (Side(path_a, True), Side(path_b, False))
        nothing = np.zeros(0, "<u4")
        for whole in batches:
            for batch in byte_slices(whole, "text", TEXT_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, kept = zip(*(side.encode(texts) for side in sides), strict=True)
                for k, t in enumerate(texts):
                    if not (t and kept[0][k] and kept[1][k]):
                        ids[0][k] = ids[1][k] = nothing
                n = [np.array(list(map(len, own)), np.int64) for own in ids]
                doc = [np.repeat(np.arange(len(texts)), m) for m in n]
                flat = [np.concatenate([nothing, *own]).astype(np.int64) for own in ids]
                i, j, ended = overlaps(sides[0].length[flat[0]], doc[0], sides[1].length[flat[1]], doc[1])
                many = np.bincount(doc[0][i], minlength=len(texts))
                i, j = i[ended], j[ended]
                cuts = np.searchsorted(doc[0][i], np.arange(1, len(texts)))
                stops = [np.split(tokens + 1 - (np.cumsum(m) - m)[of[tokens]], cuts) for tokens, m, of in zip((i, j), n, doc, strict=True)]
                yield pa.record_batch([batch.column("doc_id"), _ints(ids[0]), _ints(ids[1]), _ints(stops[0]), _ints(stops[1]), pa.array(many)], names=["doc_id", "a", "b", "a_stops", "b_stops", "n_overlaps"])

    return run


class Decimals:
    """Ids as text, each with the mark that follows it: `,` `|` `;` or nothing."""

    def __init__(self):
        self.table = np.zeros((0, 12), np.uint8)

    def join(self, ids: np.ndarray, marks: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The texts of ids[edges[k] : edges[k + 1]]."""
        most = int(ids.max(initial=-1)) + 1
        if len(self.table) < 4 * most:
            self.table = np.array([f"{k}{mark}" for k in range(most) for mark in (",", "|", ";", "")], "S12").view(np.uint8).reshape(-1, 12)
        width = len(str(most)) + 1
        letters = self.table[:, :width][ids * 4 + marks]
        ends = np.append(0, np.cumsum((letters != 0).sum(1)))[edges].tolist()
        plain = letters[letters != 0].tobytes()
        return [plain[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def group_texts(a: pa.Array, b: pa.Array, a_stops: pa.Array, b_stops: pa.Array, decimals: Decimals) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    edges = [x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() for x in (a, b, a_stops)]
    x, y, p, q = (v.flatten().to_numpy().astype(np.int64) for v in (a, b, a_stops, b_stops))
    many = np.diff(edges[2])  # groups of each document
    p, q = p + np.repeat(edges[0][:-1], many), q + np.repeat(edges[1][:-1], many)
    mark_a, mark_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    mark_a[p - 1], mark_b[q - 1] = 1, 2
    mark_b[edges[1][1:][many > 0] - 1] = 3
    at_a = np.arange(len(x)) + np.repeat(np.append(0, q[:-1])[: len(q)], np.diff(p, prepend=0))  # after b's tokens of earlier groups
    at_b = np.arange(len(y)) + np.repeat(p, np.diff(q, prepend=0))
    ids, marks = np.zeros(len(x) + len(y), np.int64), np.zeros(len(x) + len(y), np.int64)
    ids[at_a], ids[at_b], marks[at_a], marks[at_b] = x, y, mark_a, mark_b
    return decimals.join(ids, marks, edges[0] + edges[1])


def _rows(column: pa.Array) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[lo:hi] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decimals, kept, links, number = Decimals(), [], [], TaskContext.get().partitionId() << 32
    held = 0

    def flush() -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(kept)), list(map(len, links)))
        at, codes = pd.factorize(np.concatenate([np.zeros(0, np.int64), *links]))
        counts = np.bincount(at, minlength=len(codes))
        place, both = pd.factorize(owner * max(1, len(codes)) + at)  # by first appearance, so still by owner
        times = np.bincount(place, minlength=len(both))
        owner, at = np.divmod(both, max(1, len(codes)))
        columns = [codes, counts, *([r[c] for r in kept] for c in range(6)), np.bincount(owner, minlength=len(kept)), at, times]
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        kinds = [f.split()[1] for f in CHUNKS.split(", ")][1:]
        kind = {"array<long>": pa.int64(), "array<int>": pa.int32(), "array<string>": pa.string()}
        return pa.record_batch([pa.array([number]), *(pa.array([c], pa.list_(kind[k])) for c, k in zip(columns, kinds, strict=True))], names=names)

    for batch in batches:
        columns = [batch.column(c) for c in ("a", "b", "a_stops", "b_stops")]
        texts = group_texts(*columns, decimals)
        a, b, p, q = map(_rows, columns)
        for k, x, y, i, j, many, text in zip(batch.column("doc_id").to_pylist(), a, b, p, q, batch.column("n_overlaps").to_pylist(), texts, strict=True):
            kept.append((k, len(x), len(y), len(i), many, hashlib.sha256(text).hexdigest() if text else ""))
            links.append(x[i - 1].astype(np.int64) << 32 | y[j - 1].astype(np.int64))
            held += len(i)
            if held >= CHUNK_LINKS:
                yield flush()
                kept, links, number, held = [], [], number + 1, 0
    if kept:
        yield flush()


def chunks_of(aligned: DataFrame) -> DataFrame:
    """Aligned documents in chunks, a row each, as CHUNKS says: codes are a's id << 32 | b's."""
    return materialize(aligned.mapInArrow(releasing(_chunks), CHUNKS), "chunks")


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chunks_of(align(...)) by one Python worker a task: two would both hold memory, and tokens would go through the JVM."""
    aligned = _aligner(path_a, path_b)
    return materialize(_texts(docs, key, text).mapInArrow(releasing(lambda batches: _chunks(aligned(batches))), CHUNKS), "chunks")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """code, a, b, n (links of the pair over the corpus), best (no pair of the same b has more)."""
    pairs = chunks.select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("n"))
    pairs = materialize(pairs.select("code", F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n"), "pairs")
    return pairs.join(pairs.groupBy("b").agg(F.max("n").alias("most")), "b").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps of every document."""
    asked = chunks.select("chunk", F.posexplode("codes").alias("pos", "code")).join(pairs.select("code", "n", "best"), "code")
    told = asked.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "best"))).alias("told"))
    told = told.select("chunk", F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                get = lambda c: row.column(c).flatten()  # noqa: E731, B023
                n, best = (get(c).to_numpy(zero_copy_only=False) for c in ("n", "best"))
                at, times, pairs_ = (get(c).to_numpy() for c in ("at", "times", "pairs"))
                sums = [np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], np.cumsum(pairs_)])] for v in (times * best[at].astype(np.int64), times * n[at].astype(np.int64))]
                n_best, count_sum = (pa.array(np.diff(s).astype(np.int64)) for s in sums)
                columns = [get("doc_id"), get("n_a"), get("n_b"), get("n_groups"), get("n_groups"), n_best, count_sum, get("sha"), get("n_overlaps")]
                yield pa.record_batch(columns, names=[f.split()[0] for f in schema.split(", ")])

    empty = F.array().cast("array<long>"), F.array().cast("array<boolean>")
    rows = chunks.drop("codes", "counts").join(told, "chunk", "left").withColumns({"n": F.coalesce("n", empty[0]), "best": F.coalesce("best", empty[1])})
    return rows.mapInArrow(run, schema)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = aligned_chunks(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return score_links(chunks, pair_counts(chunks))
