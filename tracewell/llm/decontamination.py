"""Benchmark decontamination by Wu-Manber search for many test strings at once.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. A test string is a window of ten
consecutive words of a benchmark item, or the whole item where it has fewer; it is searched for as bytes, words joined and
enclosed by single spaces, in documents written in the same way.

Test strings of similar length share a table of blocks of at most eight bytes: how far the search may go ahead when a
window of the text ends with the block, which is the distance from the block's last place in any test string's first m
bytes to byte m (m: the shortest test string's length), or all but a block's length where no test string has it. Where it
says 0, the bytes at both ends of the window name a bucket of test strings, and the text itself is compared with those. The search runs in
lanes over the text, each lane going ahead by its own shift.

Items are dealt by the hash of their windows into blocks of bounded size, and documents meet one block after another,
carrying what was found; so neither tables nor broadcasts grow with the benchmark.

Defined cases: a null text has no words (a document gets a row with zeros, an item is in no document); a null item key is
found but has no name in `items`; rows with equal keys are documents of their own, equal item keys one item; an empty table
of documents gives no rows, an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, byte_slices, materialize, scramble
from tracewell.session import table

WINDOW = 10
#: Most bytes of windows in a block of test strings, about; and of text that is searched at once, unless one text is longer.
BLOCK_BYTES, TEXT_BYTES = 8 << 20, 4 << 20
#: Blocks that documents meet in one stage.
CHAINED = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE, _END = 32, 255  # no byte of UTF-8 is 255, so it can stand between documents
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else _SPACE for b in range(256))
#: Lengths at which another table of blocks begins: long test strings keep their long shifts beside short ones.
_CLASSES = (0, 8, 24)
FOUND = "doc_id long, text string, n_words long, starts array<long>, ends array<long>, items array<string>"


def words_of(text: Column) -> Column:
    """array<string>: the words of a text."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows_of(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """item, window: the distinct test strings of items."""
    words = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where("size(words) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("at")
    rows = words.select("item", "words", at).select("item", F.array_join(F.slice("words", F.col("at"), window), " ").alias("window"))
    return rows.distinct()


class _Blocks:
    """The shift table and the buckets of test strings of similar length."""

    def __init__(self, strings: list[bytes]):
        self.least = least = min(map(len, strings))
        self.size = min(8, least)
        heads = np.zeros((len(strings), 8 + least), np.uint8)
        heads[:, 8:] = np.frombuffer(b"".join(s[:least] for s in strings), np.uint8).reshape(-1, least)
        self.bits = min(24, max(12, (8 * heads.size).bit_length()))
        self.shift = np.full(1 << self.bits, min(least - self.size + 1, 65535), np.uint16)
        for end in range(self.size, least + 1):  # a later end has a smaller shift, and is written last
            self.shift[self._slot(self._block(heads, end))] = min(least - end, 65535)
        keys = self._key(self._block(heads, least), self._block(heads, self.size))
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.lexsort((lengths, keys))
        pairs = np.stack([keys[order], lengths[order].astype(np.uint64)])
        pairs = pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(0))]
        self.keys, self.lengths = np.ascontiguousarray(pairs[0]), pairs[1].astype(np.int64)

    def _block(self, rows: np.ndarray, end: int) -> np.ndarray:
        return np.ascontiguousarray(rows[:, end : end + 8]).view("<u8").ravel() >> np.uint64(64 - 8 * self.size)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    @staticmethod
    def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return scramble(last * np.uint64(0xC2B2AE3D27D4EB4F) + first)

    def search(self, text: np.ndarray, lane: int = 2048) -> Iterator[tuple[int, int]]:
        """(start, length) of text that may be a test string: both ends of its first bytes are those of one. text: 8 bytes, then the text."""
        n = len(text) - 8
        if n < self.least:
            return
        eight = np.ndarray((n + 1,), "<u8", text, 0, (1,))  # eight[e]: the bytes before the end e
        drop = np.uint64(64 - 8 * self.size)
        at = np.arange(self.least, n + 1, lane)
        stop = np.minimum(at + lane, n + 1)
        stops = []
        while len(at):
            shift = self.shift[self._slot(eight[at] >> drop)]
            stops.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        ends = np.concatenate(stops)
        keys = self._key(eight[ends] >> drop, eight[ends - self.least + self.size] >> drop)
        low = np.searchsorted(self.keys, keys)
        many = np.searchsorted(self.keys, keys, "right") - low
        some = np.repeat(np.arange(len(ends)), many)
        which = np.arange(len(some)) - np.repeat(np.cumsum(many) - many, many) + low[some]
        yield from zip((ends[some] - self.least).tolist(), self.lengths[which].tolist(), strict=True)


class TestStrings:
    """A block of test strings (windows, and the items that have each), ready to be searched for."""

    __test__ = False

    def __init__(self, windows: list[str], items: list[list[str]]):
        strings = [f" {w} ".encode() for w in windows]
        self.number = {s: k for k, s in enumerate(strings)}
        self.words = np.array([s.count(b" ") - 1 for s in strings], np.int64)
        self.items = items
        of = np.searchsorted(_CLASSES, list(map(len, strings)), "right") if strings else np.zeros(0, int)
        self.classes = [_Blocks([s for s, c in zip(strings, of, strict=True) if c == k]) for k in np.unique(of)]

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n_words of each text; text, first word and number of each test string that occurs)."""
        raw = b" \xff ".join([b"", *(t.encode() for t in texts), b""]).translate(_BYTES)
        plain = np.frombuffer(raw, np.uint8)
        space = plain == _SPACE
        plain = plain[np.append(True, ~(space[1:] & space[:-1]))]
        starts = np.flatnonzero((plain[1:] != _SPACE) & (plain[:-1] == _SPACE)) + 1
        bounds = np.flatnonzero(plain[starts] == _END)
        data, number, place, found = plain.tobytes(), self.number, [], []
        padded = np.concatenate([np.zeros(8, np.uint8), plain])
        for blocks in self.classes:
            for start, length in blocks.search(padded):
                k = number.get(data[start : start + length])
                if k is not None:
                    place.append(start)
                    found.append(k)
        first = np.searchsorted(starts, np.array(place, np.int64) + 1)
        text = np.searchsorted(bounds, first) - 1
        return np.diff(bounds) - 1, text, first - bounds[text] - 1, np.array(found, np.int64)


def _spans(n: np.ndarray, text: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of words that the given word ranges of texts of n words cover."""
    base = np.concatenate([[0], np.cumsum(n + 1)])  # a free place after each text keeps runs apart
    steps = np.bincount(base[text] + first, minlength=base[-1] + 1) - np.bincount(base[text] + after, minlength=base[-1] + 1)
    edge = np.diff(np.concatenate([[0], np.cumsum(steps) > 0]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(base, start, "right") - 1
    return text, start - base[text], end - base[text]


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64)))


def _pass(rows: DataFrame, block) -> DataFrame:
    """rows (as FOUND) with what one block of test strings adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestStrings = block.value
        for whole in batches:
            for batch in byte_slices(whole, "text", TEXT_BYTES):
                n, text, first, k = tests.find([t or "" for t in batch.column("text").to_pylist()])
                known = [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
                old = np.repeat(np.arange(batch.num_rows), list(map(len, known[0])))
                old_first, old_after = (np.array([v for row in x for v in row], np.int64) for x in known[:2])
                text_, start, end = _spans(n, np.append(text, old), np.append(first, old_first), np.append(first + tests.words[k], old_after))
                items = [set(x) for x in known[2]]
                for t, j in np.unique(np.stack([text, k]), axis=1).T.tolist():
                    items[t].update(tests.items[j])
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("text"), pa.array(n), _lists(text_, batch.num_rows, start), _lists(text_, batch.num_rows, end), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "starts", "ends", "items"],
                )

    return rows.mapInArrow(run, FOUND)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, hits (array of word ranges: start, end), items (names of items with occurring windows) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = materialize(windows_of(items, item_key, item_text, window).groupBy("window").agg(F.collect_list("item").alias("items")), "windows")
    weight = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda s, i: s + F.octet_length(i))
    blocks = 1 + (windows.agg(F.sum(weight)).first()[0] or 0) // block_bytes
    none = F.array().cast("array<long>")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).toPandas()  # about block_bytes
        rows = _pass(rows, spark.sparkContext.broadcast(TestStrings(own["window"].tolist(), [list(x) for x in own["items"]])))
        if b % CHAINED == CHAINED - 1 and b + 1 < blocks:
            rows = materialize(rows, "searched")
    hits = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    return rows.select("doc_id", "n_words", hits.alias("hits"), F.array_sort("items").alias("items"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM t),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
o AS (SELECT p.doc_id, p.i, p.n, t.item_id FROM p JOIN t ON t.n = p.n AND t.s = p.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS x FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, coalesce(m.items, sha256('')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""
