"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and offsets.

Training reads the whole texts of a bounded sample of labelled documents (at most `sample` of each class, by hash of the
key) in tasks. Labels are per document, so tokens get theirs from contrast: in a toxic document, a token is toxic if its
word, its beginning or its ending occurs in toxic documents far more often than in clean ones. The field is fitted on at
most CHAINS chains of up to 16 words, drawn by hash from all of the sample's: up to half with such tokens, and up to twice
as many without, or a quarter of CHAINS if that is more. A logistic curve over what the marginals of a document add up to
is fitted on the sample's documents, scored whole; the driver gets two numbers and the label of each.

Scoring reads every whole text: chains are sentences, forward-backward runs over all chains of a batch at once, and a
document's score comes from the sum and the maximum of its tokens' marginals. Labels, language, source and key are never
inputs of a score.

Defined cases: of rows that repeat a labelled key the least text is learnt from, as toxic if any of its labels says so; a null or empty text has no tokens and gets the score of a text without toxic tokens; without labelled
documents of both classes the score is 0; repeated rows are scored alike; an empty table gives no rows; other columns of
the documents are kept, except that the names of the results replace them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, materialize, releasing
from tracewell.session import table

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
BITS = 18
#: Documents of each class that a fit reads at most, and chains of them that the field is fitted on at most.
SAMPLE, CHAINS = 2000, 8000
#: Word types a worker remembers at most; it starts afresh beyond.
REMEMBER = 80_000
THRESHOLD = 0.7


def affixes(word: str) -> list[str]:
    return [f"w={word}", f"p4={word[:4]}", f"p5={word[:5]}", f"s4={word[-4:]}"]


def slots_of(words: list[str]) -> np.ndarray:
    """Per word: slots of its own features, then of what it says about the next and the previous token."""
    own = np.array([[zlib.crc32(a.encode()) for a in affixes(w)] for w in words], np.int64).reshape(-1, 4)
    bias = np.zeros((len(own), 1), np.int64)
    return np.hstack([own, bias, own[:, :1] ^ 0x2F0B4C47, own[:, :1] ^ 0x1D8AF066]) & ((1 << BITS) - 1)


def chains(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(text):
        if t in ENDS:
            if out[-1]:
                out.append([])
        else:
            out[-1].append(t)
    return out if out[-1] else out[:-1]


def ratios(d: np.ndarray, starts: np.ndarray, n: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward odds of tag 1 over tag 0, and the odds that a token itself gives, for chains laid end to end.

    d: scores of tag 1 over tag 0; starts, n: first token and length of each chain; move: log score of each move. Step t
    works on the chains longer than t, all at once.
    """
    order = np.argsort(-n, kind="stable")
    starts, n = starts[order], n[order]
    (m00, m01), (m10, m11) = np.exp(move)
    emit = np.exp(np.clip(d, -30, 30))
    fore, back = emit.copy(), np.ones_like(emit)
    longest = int(n[0])
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # chains longer than t
    r = emit[starts]
    for t in range(1, longest):
        at = starts[: live[t]] + t
        r = r[: live[t]]
        r = np.clip(emit[at] * (m01 + m11 * r) / (m00 + m10 * r), 1e-30, 1e30)
        fore[at] = r
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        x = emit[at] * back[at]
        back[at - 1] = np.clip((m10 + m11 * x) / (m00 + m01 * x), 1e-30, 1e30)
    return fore, back, emit


def expected_moves(fore: np.ndarray, back: np.ndarray, emit: np.ndarray, later: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected number of each move into the tokens `later`."""
    x, r = emit[later] * back[later], fore[later - 1]
    (m00, m01), (m10, m11) = np.exp(move)
    w = np.stack([m00 * np.ones_like(x), m01 * x, m10 * r, m11 * r * x])
    return (w / w.sum(0)).sum(1).reshape(2, 2)


@dataclass
class Field:
    """Weights of the field and of the curve over documents."""

    weights: np.ndarray
    move: np.ndarray
    curve: np.ndarray

    def scores(self, found: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Score of each document from its tokens' marginals."""
        return 1 / (1 + np.exp(-np.clip(summary(found) @ self.curve, -30, 30)))


def summary(found: list[np.ndarray]) -> np.ndarray:
    total = np.array([p.sum() for p in found])
    most = np.array([p.max() if len(p) else 0.0 for p in found])
    return np.stack([np.ones(len(found)), np.log1p(total), most], 1)


class Tagger:
    """Marginals of whole texts under a field."""

    def __init__(self, field: Field):
        self.field = field
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, 3))

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > REMEMBER:
            self.ids, self.rows = {}, np.zeros((0, 3))
        new = list(words - self.ids.keys())
        w = self.field.weights[slots_of([x.lower() for x in new])]
        self.ids.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, np.stack([w[:, :-2].sum(1), w[:, -2], w[:, -1]], 1)])

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Per text: the marginal of every token, in order."""
        per_text = [chains(t) for t in texts]
        flat = [c for cs in per_text for c in cs]
        if not flat:
            return [np.zeros(0)] * len(texts)
        self.learn(set(chain.from_iterable(flat)))
        n = np.array([len(c) for c in flat])
        types = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(flat)), np.int64, int(n.sum()))
        starts = np.cumsum(n) - n
        own, before, after = self.rows[types].T
        d = own.copy()
        inner = np.ones(len(d), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        d[at] += before[at - 1]
        d[at - 1] += after[at]
        fore, back, _ = ratios(d, starts, n, self.field.move)
        odds = fore * back
        out = odds / (1 + odds)
        ends = np.cumsum([sum(len(c) for c in cs) for cs in per_text])
        return np.split(out, ends[:-1])


def count_affixes(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """For each affix: the clean and the toxic documents that hold it; counts so far go out when there are `most`."""
    counts = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.record_batch([pa.array(names, pa.string()), *(pa.array([c[a] for a in names], pa.int64()) for c in counts)], names=["affix", "c0", "c1"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({a for w in {t.lower() for t in TOKEN.findall(text) if t not in ENDS} for a in affixes(w)})
            if len(counts[0]) + len(counts[1]) > most:
                yield rows()
                for c in counts:
                    c.clear()
    yield rows()


def toxic_affixes(texts: DataFrame, n0: int, n1: int, least_gain: float = 9.0, least: float = 2.0) -> frozenset[str]:
    """Affixes that toxic documents hold far more often than clean ones: by log odds, and by log likelihood ratio."""
    counts = texts.select("text", "toxic").mapInArrow(releasing(count_affixes), "affix string, c0 long, c1 long")
    counts = counts.groupBy("affix").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c1 > 0")
    c0, c1, share = F.col("c0"), F.col("c1"), n1 / (n0 + n1)
    odds = F.log((c1 + 0.5) / (n1 + 1) / ((c0 + 0.5) / (n0 + 1)))
    gain = c1 * F.log(c1 / ((c1 + c0) * share)) + F.when(c0 > 0, c0 * F.log(c0 / ((c1 + c0) * (1 - share)))).otherwise(0.0)
    return frozenset(r["affix"] for r in counts.where((odds >= least) & (gain >= least_gain)).select("affix").collect())


def draw_chains(texts: DataFrame, marks: frozenset[str], length: int = 16, most: int = CHAINS) -> list[tuple[list[str], list[int]]]:
    """At most `most` (words, tags) from all places of the texts, by hash: those with toxic tokens, then those without."""
    schema = pa.schema([("tagged", pa.int32()), ("rank", pa.int64()), ("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32()))])
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        kept: tuple[list, list] = ([], [])  # of each kind, the first `most` by rank
        for batch in batches:
            for key, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                place = 0
                for one in chains(text):
                    words = [w.lower() for w in one]
                    for at in range(0, len(words), length):
                        part = words[at : at + length]
                        if toxic:
                            for w in part:
                                if w not in known:
                                    known[w] = int(any(a in shared.value for a in affixes(w)))
                        tags = [known[w] if toxic else 0 for w in part]
                        rank = int.from_bytes(hashlib.blake2b(f"{key} {place}".encode(), digest_size=8).digest(), "big", signed=True)
                        kept[any(tags)].append((rank, part, tags))
                        place += 1
                for own in kept:
                    if len(own) > most + most // 2:
                        own.sort()
                        del own[most:]
                if len(known) > REMEMBER:
                    known = {}
        rows = [(kind, *r) for kind, own in enumerate(kept) for r in sorted(own)[:most]]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    drawn = materialize(texts.mapInArrow(releasing(run), "tagged int, rank long, words array<string>, tags array<int>"), "chains")
    pick = lambda kind, k: drawn.where(F.col("tagged") == kind).orderBy("rank", "words").limit(k).collect()
    used = pick(1, most // 2)
    used += pick(0, max(most // 4, min(most - len(used), 2 * len(used))))
    return [(r["words"], r["tags"]) for r in used]


def train(used: list[tuple[list[str], list[int]]], rounds: int = 50, ridge: float = 1e-4) -> Field:
    """Fit the field, without its curve, on chains of words and tags."""
    weights, move = np.zeros(1 << BITS), np.zeros((2, 2))
    if used:
        n = np.array([len(p) for p, _ in used])
        flat = [w for p, _ in used for w in p]
        types, inverse = np.unique(np.array(flat, object), return_inverse=True)
        slots = slots_of(list(types))[inverse]
        y = np.array([t for _, tags in used for t in tags], float)
        starts = np.cumsum(n) - n
        first = np.zeros(len(flat), bool)
        first[starts] = True
        later = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)
        step_w, step_m = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(rounds):
            d = weights[slots[:, :-2]].sum(1)
            d[later] += weights[slots[later - 1, -2]]
            d[later - 1] += weights[slots[later, -1]]
            fore, back, emit = ratios(d, starts, n, move)
            odds = fore * back
            error = y - odds / (1 + odds)
            g = np.bincount(slots[:, :-2].ravel(), np.repeat(error, slots.shape[1] - 2), 1 << BITS)
            g += np.bincount(slots[later - 1, -2], error[later], 1 << BITS) + np.bincount(slots[later, -1], error[later - 1], 1 << BITS)
            g = g / len(used) - ridge * weights
            m = (seen - expected_moves(fore, back, emit, later, move)) / len(used) - ridge * move
            step_w += g * g
            step_m += m * m
            weights += 0.5 * g / np.sqrt(step_w)
            move += 0.2 * m / np.sqrt(step_m)
    return Field(weights, move, np.zeros(3))


def fit_curve(field: Field, texts: DataFrame) -> np.ndarray:
    """The curve over documents: a task scores whole texts, the driver gets (sum, maximum, label) of each."""
    shared = texts.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                x = summary(tagger.marginals(batch.column("text").to_pylist()))
                yield pa.record_batch([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column("toxic")], names=["total", "most", "toxic"])

    found = sorted(texts.select("text", "toxic").mapInArrow(releasing(run), "total double, most double, toxic int").collect())
    x, y = (np.array([[1.0, r["total"], r["most"]] for r in found]), np.array([r["toxic"] for r in found], float))
    return logistic(x, y)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def learnable() -> F.Column:
    """Rows whose labels may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from at most `sample` labelled documents of each class; None unless both classes occur."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learnable())
    each = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    few = docs.sparkSession.createDataFrame([r for e in each for r in e.collect()], known.schema)  # at most 2 x `sample` rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    texts = materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")  # a row for each key
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    field = train(draw_chains(texts, toxic_affixes(texts, n[0], n[1])))
    field.curve = fit_curve(field, texts)
    return field


RESULTS = "score double, toxic_tokens array<struct<offset: int, length: int, p: double>>"


def score(docs: DataFrame, field: Field | None, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with `score` and `toxic_tokens` (offset and length in code points, marginal) of tokens likelier toxic than not."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in docs.columns if c not in ("score", "toxic_tokens")]
    shared = spark.sparkContext.broadcast(field)  # the weights: 2 ** BITS numbers, whatever the data
    span_type = pa.list_(pa.struct([("offset", pa.int32()), ("length", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        tagger = Tagger(field) if field is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                found = tagger.marginals(texts) if tagger else [np.zeros(0)] * len(texts)
                scores = field.scores(found, None) if tagger else np.zeros(len(texts))
                tokens = []
                for t, p in zip(texts, found, strict=True):
                    hit = np.flatnonzero(p > 0.5) if spans else ()
                    own = [m.span() for m in TOKEN.finditer(t) if m.group() not in ENDS] if len(hit) else []
                    tokens.append([{"offset": own[i][0], "length": own[i][1] - own[i][0], "p": float(p[i])} for i in hit])
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(scores), pa.array(tokens, span_type)], names=[*kept, "score", "toxic_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(releasing(run), f"{schema}, {RESULTS}")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_tokens",
    )
