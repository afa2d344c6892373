"""Token-id shards with a minimal perfect hash index per shard.

A store is a folder on shared storage. Shard k holds the documents of the k-th range of keys, ascending:
`shard-k.bin` is the raw ids of its documents, one after another, little-endian, two bytes each where the vocabulary
allows and four otherwise; `shard-k.idx` holds the documents' keys and offsets and the index, as arrays of 8-byte numbers
at places that its head names. The index maps a key to a slot without collisions (levels of bit arrays; a key's slot is
the rank of its bit), and the slot holds a fingerprint of the key and its first document. So access to one key takes a
few reads of a few bytes, whatever the size of the shard (`Shard.probe`), and unknown keys are refused. The number of
shards follows the bytes of text, so that a shard and its index stay small beside a task's memory.

Defined cases: a null text gives the end id alone; null keys come first and are not indexed by key; repeated keys lie side
by side, ordered by text, and share a slot; an empty table gives a store without shards; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, new_path, partitions, scramble
from tracewell.llm.tokens import encoder, vocabulary
from tracewell.session import table

BLOCK = 1 << 20
#: Bytes of text in a shard, about, and keys of one shard from which a lookup reads its whole index.
SHARD_BYTES, MANY = 64 << 20, 256


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    with np.errstate(over="ignore"):
        return scramble(keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1. Each level keeps the keys that hash to a bit of their own; the rest go on."""

    GAMMA = 2.0
    FINGERPRINT = 9_999

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        left = keys.astype(np.uint64)
        while len(left):
            size = max(64, -(-int(cls.GAMMA * len(left)) // 64) * 64)
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(words) if words else np.zeros(0, "<u8")
        counts = np.bitwise_count(flat).astype(np.int64)
        return cls(np.array(sizes, np.int64), flat, np.cumsum(counts) - counts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that are not in it."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, shift = self.starts[level] + bit // 64, (bit % 64).astype(np.uint64)
            value = self.words[word]
            hit = (value >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[word] + below)[hit]
            open_ = open_[~hit]
        return out


@dataclass
class Shard:
    """One shard's index, and access to its ids."""

    uri: str
    width: int
    null_keys: int
    keys: np.ndarray
    offsets: np.ndarray
    table: PerfectHash
    fingerprints: np.ndarray
    first: np.ndarray

    @classmethod
    def index(cls, uri: str, width: int, null_keys: int, keys: np.ndarray, lengths: np.ndarray) -> Shard:
        """keys: of all documents, ascending (0 for the null ones, which come first); lengths: their ids."""
        own, first = np.unique(keys[null_keys:], return_index=True)
        hashed = PerfectHash.build(own.view(np.uint64))
        slots = hashed.slots(own.view(np.uint64))
        prints, start = np.zeros(len(own), np.uint32), np.zeros(len(own), np.int64)
        prints[slots] = mix(own.view(np.uint64), PerfectHash.FINGERPRINT).astype(np.uint32)
        start[slots] = first + null_keys
        return cls(uri, width, null_keys, keys, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), hashed, prints, start)

    def dump(self) -> bytes:
        """The head (width, null keys, sizes of the arrays), then the arrays, all of 8-byte numbers."""
        arrays = [self.table.sizes, self.keys, self.offsets, self.table.words, self.table.ranks, self.fingerprints, self.first]
        head = np.array([self.width, self.null_keys, *map(len, arrays)], np.int64)
        return b"".join(a.astype("<u8" if a.dtype.kind == "u" else "<i8").tobytes() for a in (head, *arrays))

    HEAD = 9

    @classmethod
    def open(cls, uri: str) -> Shard:
        """The whole index, for many keys or a scan."""
        store, path = fs.FileSystem.from_uri(f"{uri}.idx")
        with store.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), "<i8")
        ends = cls.HEAD + np.cumsum(raw[2 : cls.HEAD])
        sizes, keys, offsets, words, ranks, prints, first = np.split(raw[cls.HEAD :], ends[:-1] - cls.HEAD)
        return cls(uri, int(raw[0]), int(raw[1]), keys, offsets, PerfectHash(sizes, words.view("<u8"), ranks), prints.view("<u8"), first)

    @classmethod
    def probe(cls, uri: str, key: int) -> np.ndarray | None:
        """The ids of the first document of one key, by reads of constant size; None for a key that the shard doesn't hold."""
        store, path = fs.FileSystem.from_uri(f"{uri}.idx")
        with store.open_input_file(path) as f:

            def numbers(place: int, n: int = 1) -> np.ndarray:
                f.seek(8 * int(place))
                return np.frombuffer(f.read(8 * n), "<i8")

            head = numbers(0, cls.HEAD)
            sizes_at, keys_at, offsets_at, words_at, ranks_at, prints_at, first_at = (cls.HEAD + np.cumsum(head[2:]) - head[2:]).tolist()
            own, start = np.array([key], np.int64).view(np.uint64), 0
            for level, size in enumerate(numbers(sizes_at, int(head[2]))):
                bit = int(mix(own, level)[0]) % int(size)
                word = int(numbers(words_at + start + bit // 64).view("<u8")[0])
                if word >> bit % 64 & 1:
                    slot = int(numbers(ranks_at + start + bit // 64)[0]) + (word & (1 << bit % 64) - 1).bit_count()
                    break
                start += int(size) // 64
            else:
                return None
            if int(numbers(prints_at + slot).view("<u8")[0]) != int(mix(own, PerfectHash.FINGERPRINT)[0]) & 0xFFFFFFFF:
                return None
            document = int(numbers(first_at + slot)[0])
            if int(numbers(keys_at + document)[0]) != key:
                return None
            lo, hi = numbers(offsets_at + document, 2).tolist()
        width = int(head[0])
        store, path = fs.FileSystem.from_uri(f"{uri}.bin")
        with store.open_input_file(path) as f:
            f.seek(lo * width)
            return np.frombuffer(f.read((hi - lo) * width), f"<u{width}").astype("<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key; -1 for keys that the shard doesn't hold."""
        slots = self.table.slots(keys.view(np.uint64))
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == mix(keys[known].view(np.uint64), PerfectHash.FINGERPRINT).astype(np.uint32)
        out = np.full(len(keys), -1, np.int64)
        out[known] = self.first[slots[known]]
        known[known] = self.keys[out[known]] == keys[known]
        out[~known] = -1
        return out

    def ids(self, documents: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of documents; neighbours are read together."""
        store, path = fs.FileSystem.from_uri(f"{self.uri}.bin")
        with store.open_input_file(path) as f:
            at, block = 0, np.zeros(0, np.uint32)
            for d in documents:
                lo, hi = int(self.offsets[d]), int(self.offsets[d + 1])
                if lo < at or hi > at + len(block):
                    at = lo
                    f.seek(lo * self.width)
                    raw = f.read(max(hi - lo, BLOCK) * self.width)
                    block = np.frombuffer(raw, f"<u{self.width}")
                yield block[lo - at : hi - at].astype("<u4")


class TokenStore:
    """Shards of token ids under one folder."""

    SHARDS_SCHEMA = "shard int, docs long, ids long, low long, high long"

    def __init__(self, spark: SparkSession, folder: str, shards: list[tuple]):
        self.spark, self.folder, self.shards = spark, folder, sorted(shards)

    @classmethod
    def write(cls, docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text") -> TokenStore:
        """Encode whole texts by the tokenizer file `path` and write them in ascending key order.

        A task writes under names of its own attempt and renames at its end, so a lost or repeated task leaves one
        whole shard.
        """
        spark = docs.sparkSession
        bounded_batches(spark)
        folder = folder or new_path(spark, "tokens")
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        by_key = F.col("key").asc_nulls_first()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rows = rows.repartitionByRange(max(partitions(spark), -(-size // SHARD_BYTES)), by_key).sortWithinPartitions(by_key, F.col("text").asc_nulls_first())

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(path)
            width = 2 if enc.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
            task = TaskContext.get()
            name = f"{folder}/shard-{task.partitionId():06d}"
            store, final = fs.FileSystem.from_uri(name)
            store.create_dir(final.rpartition("/")[0], recursive=True)
            own = f"{final}.{task.taskAttemptId()}"
            keys, lengths, nulls = [], [], 0
            with store.open_output_stream(f"{own}.bin") as f:
                for batch in batches:
                    column = batch.column(0)
                    nulls += column.null_count
                    keys.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                    for at in range(0, batch.num_rows, 256):
                        texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                        coded = [np.append(ids, np.array([end_id], "<u4")).astype(f"<u{width}") for ids in enc.encode(texts)]
                        lengths.append(np.array([len(x) for x in coded], np.int64))
                        f.write(b"".join(x.tobytes() for x in coded))
            if not lengths:
                store.delete_file(f"{own}.bin")
                return
            all_keys = np.concatenate(keys)
            shard = Shard.index(name, width, nulls, all_keys, np.concatenate(lengths))
            with store.open_output_stream(f"{own}.idx") as f:
                f.write(shard.dump())
            for kind in ("bin", "idx"):
                store.move(f"{own}.{kind}", f"{final}.{kind}")
            held = all_keys[nulls:]
            row = [task.partitionId(), len(all_keys), int(shard.offsets[-1]), int(held[0]) if len(held) else None, int(held[-1]) if len(held) else None]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["shard", "docs", "ids", "low", "high"])

        return cls(spark, folder, [tuple(r) for r in rows.mapInArrow(save, cls.SHARDS_SCHEMA).collect()])  # a row per shard

    def _over_shards(self, function, schema: str) -> DataFrame:
        """function(shard row, first id of the shard) in a task for each shard."""
        starts = np.concatenate([[0], np.cumsum([s[2] for s in self.shards])]).astype(int).tolist()
        shards, folder = self.shards, self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield from function(Shard.open(f"{folder}/shard-{shards[i][0]:06d}"), starts[i])

        n = len(self.shards)
        return self.spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files; documents with a key by way of the index."""
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

        def scan(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
            n = len(shard.keys)
            own = shard.keys[shard.null_keys :]
            first = shard.find(own)
            if (first < 0).any():
                raise ValueError(f"the index of {shard.uri} doesn't hold all its keys")
            nth = np.arange(len(own)) - np.searchsorted(own, own)  # among documents with the same key
            documents = np.concatenate([np.arange(shard.null_keys), first + nth])
            for at in range(0, n, 4096):
                part = documents[at : at + 4096]
                crc = [zlib.crc32(ids.tobytes()) for ids in shard.ids(part)]
                keys = pa.array(shard.keys[part], mask=part < shard.null_keys)
                yield pa.record_batch(
                    [keys, pa.array(start + shard.offsets[part]), pa.array(shard.offsets[part + 1] - shard.offsets[part]), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

        return self._over_shards(scan, schema)

    def get(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """doc_id, ids array<int> of the first document of each key that the store holds."""
        bounds = [(s[3], s[4], s[0]) for s in self.shards if s[3] is not None]
        lows, folder = np.array([b[0] for b in bounds], np.int64), self.folder

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[int, Shard] = {}
            for batch in batches:
                asked = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                at = np.searchsorted(lows, asked, side="right") - 1
                for i in np.unique(at[at >= 0]):
                    uri, some = f"{folder}/shard-{bounds[i][2]:06d}", asked[at == i]
                    if len(some) < MANY and i not in opened:
                        each = [(k, Shard.probe(uri, k)) for k in some.tolist()]
                        some, ids = [k for k, x in each if x is not None], [x for _, x in each if x is not None]
                    else:
                        opened = opened if i in opened else {i: Shard.open(uri)}  # one index at a time
                        found = opened[i].find(some)
                        some, ids = some[found >= 0], list(opened[i].ids(found[found >= 0]))
                    yield pa.record_batch([pa.array(some, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return keys.select(F.col(key).cast("long").alias("doc_id")).mapInArrow(fetch, "doc_id long, ids array<int>")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenStore.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).read()
