"""Suffix-array removal of repeated passages, by a distributed difference-cover sort.

Task: remove every byte that a `length`-byte string covers which also starts in a document with a smaller key.

Only suffixes that can have an equal prefix elsewhere need sorting, and only their first `length` bytes matter:

1. Every `length`-byte window has an anchor, the smallest hash among its 16-byte strings, so equal windows have equal
   anchors at equal places. Anchors (about one for 18 bytes) are dealt by hash, and those that occur once drop out.
2. The windows of the other anchors are dealt by anchor hash, as contexts (runs of windows with one anchor). Equal
   contexts are collapsed to the smallest key, in each part before they are dealt and again before they are sorted: so a
   passage that a third of all documents share is one context of each part, and no task meets all its copies. Each task
   sorts a part of the suffixes that no other part can match.
3. The difference-cover sort: positions that are 1 or 2 modulo 3 are sampled; sampled triples of letters (6 bytes each)
   are sorted and named; names recur on triples of names 15 apart, after which they rank 48 bytes; the remaining
   suffixes are merged through the rank of the sampled position one or two further on.
4. Adjacent prefixes are compared; a run of equal ones is a repeated string, and its smallest key keeps it.
5. Spans go back to the documents' own partitions, where the text is cut.

The text is shuffled once, and each use reads that exchange; whole copies of an earlier text need no sorting. A part's
hashes are dealt as one blob for each bucket, so blobs number parts times buckets: PART_BYTES should grow with the memory
of a core, so that parts stay below some ten thousands (at 16 MB, 100 GB of text make 40 million blobs).

Defined cases: a null text counts as the empty text; a null key counts as larger than all others; documents with equal
keys (null ones too) take nothing from each other; repeated rows lose the same bytes; texts shorter than `length` bytes
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_batches, materialize, partitions, releasing_group, releasing_pair, scramble
from tracewell.session import table

LENGTH, ANCHOR = 50, 16
#: Bytes of text in a part, and windows that one sort takes at most (names must fit 21 bits).
PART_BYTES, SORT_WINDOWS = 16_000_000, 250_000
PAD = b"\0" * 64
NO_KEY = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)
_NONE = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def loads(buffer: bytes, kind: str, n: int) -> np.ndarray:
    """Unaligned 8-byte loads at every place."""
    return np.ndarray((n,), kind, buffer, 0, (1,))


def pack(raw: bytes) -> bytes:
    """Compressed bytes, with their number in front: parts exchange more than Spark's own codec would make small."""
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpack(packed: bytes | pa.Buffer) -> bytes:
    (n,) = struct.unpack_from("<q", packed)
    return pa.decompress(memoryview(packed)[8:], n, "zstd", asbytes=True) if n else b""


def planes(x: np.ndarray) -> bytes:
    """Numbers, their lowest bytes first, then the next ones: small or near numbers leave runs of equal bytes."""
    return x.view("u1").reshape(len(x), x.itemsize).T.tobytes()


def of_planes(raw: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1", n * size, at).reshape(size, n).T).view(kind).ravel()


def pack_hashes(own: np.ndarray, several: np.ndarray) -> bytes:
    """The upper halves of ascending hashes, as differences, and a bit for each."""
    step = np.diff((own >> np.uint64(32)).astype("<u4"), prepend=np.uint32(0))
    return pack(struct.pack("<q", len(own)) + planes(step) + np.packbits(several).tobytes())


def unpack_hashes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = unpack(packed)
    (n,) = struct.unpack_from("<q", raw)
    return np.cumsum(of_planes(raw, "<u4", n, 8), dtype=np.uint32), np.unpackbits(np.frombuffer(raw, "u1", offset=8 + 4 * n), count=n).astype(bool)


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor hash) of each run of windows with one anchor, by text and place."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < 500_000):
            size += len(texts[upto])
            upto += 1
        for k, x in enumerate(_anchors(texts[at:upto], length)):
            out[k].append(x + at if k == 0 else x)
        at = upto
    return tuple(np.concatenate(x) if x else e for x, e in zip(out, _NONE, strict=True))


def _anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    buffer = b"".join(texts) + PAD
    n = np.array([len(t) for t in texts], np.int64)
    start, size = np.cumsum(n) - n, len(buffer) - len(PAD)
    width = length - ANCHOR + 1
    if size < length:
        return _NONE
    word = loads(buffer, "<u8", size + 8)
    with np.errstate(over="ignore"):
        h = scramble(scramble(word[:size] * np.uint64(0x9E3779B97F4A7C15)) + word[8 : size + 8])
    owner = np.repeat(np.arange(len(n)), n)
    s = np.flatnonzero(np.arange(size) + length <= (start + n)[owner])
    if not len(s):
        return _NONE
    if size > int(_PLACE):  # one text that is too long to pack places beside hashes
        place = _least_places(h, width)[s]
    else:
        least = (h & ~_PLACE) | np.arange(size, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least[s] & _PLACE).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[s[1:]] != owner[s[:-1]])
    first = np.flatnonzero(new)
    return owner[s[first]], s[first] - start[owner[s[first]]], np.diff(np.append(first, len(s))), h[place[first]]


def _least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least (hash without its low 24 bits) of each window."""
    out, block = [], 1 << 20
    for lo in range(0, len(h), block):
        part = h[lo : lo + block + width - 1]
        least = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(np.pad(least, (0, width - 1), constant_values=np.uint64(2**64 - 1)), width)
        out.append(lo + (view.min(1)[: min(block, len(h) - lo)] & _PLACE).astype(np.int64))
    return np.concatenate(out)


def name(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key first."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_prefixes(buffer: bytes, start: np.ndarray, count: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Difference-cover sort of windows: (their places in the order of their first `length` bytes, run of equal ones).

    Context i holds count[i] windows, the first at start[i]. `length` - 2 is 3 strides of 6 bytes and 2 of `stride`.
    """
    size = len(buffer) - len(PAD)
    deep = length - 2  # bytes that a name ranks in the end
    shallow = 18
    stride = (deep - shallow) // 2
    assert stride % 3 == 0 and stride <= shallow and shallow + 2 * stride == deep
    big = loads(buffer, ">u8", size + 56)
    byte = np.frombuffer(buffer, np.uint8)
    place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def spread(extra: int) -> np.ndarray:  # sampled places of the contexts, `extra` beyond the last window
        n = count + extra
        p = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return p[p % 3 != 0]

    # Sort and name sampled triples of letters, then triples of names.
    q = spread(2 + 2 * stride)
    letter = [(big[q + 6 * k] >> np.uint64(16)).astype(np.uint64) for k in range(3)]
    names = np.zeros(size + 64, np.int64)
    names[q] = name(*letter)
    q = spread(2)
    wide = np.uint64(21)
    triple = names.astype(np.uint64)
    deeper = name((triple[q] << (wide + wide)) | (triple[q + stride] << wide) | triple[q + 2 * stride])
    rank = np.zeros(size + 64, np.int64)
    rank[q] = deeper
    # Merge: places 0 modulo 3 compare with those 1 modulo 3 one byte on, with those 2 modulo 3 two bytes on.
    group = [place[place % 3 == r] for r in range(3)]
    by0 = lambda p: (rank[p] << 16) | (byte[p + deep].astype(np.int64) << 8) | byte[p + deep + 1]
    by1 = lambda p: (byte[p].astype(np.int64) << 40) | (rank[p + 1] << 8) | byte[p + deep + 1]
    by2 = lambda p: (byte[p].astype(np.int64) << 40) | (byte[p + 1].astype(np.int64) << 32) | rank[p + 2]
    keys = {(0, 1): by1, (0, 2): by2, (1, 2): by0}
    sorted_, at = [], []
    for r, key in enumerate((by1, by0, by0)):
        group[r] = group[r][np.argsort(key(group[r]), kind="stable")]
        sorted_.append(group[r])
        at.append(np.arange(len(group[r])))
    for (a, b), key in keys.items():  # equal prefixes: those of the smaller remainder first
        ka, kb = key(sorted_[a]), key(sorted_[b])
        at[a] = at[a] + np.searchsorted(kb, ka, side="left")
        at[b] = at[b] + np.searchsorted(ka, kb, side="right")
    order = np.empty(len(place), np.int64)
    for r in range(3):
        order[at[r]] = sorted_[r]
    # Compare adjacent prefixes.
    new = np.zeros(len(order), bool)
    for k in (*range(0, length - 8, 8), length - 8):
        w = big[order + k]
        new[1:] |= w[1:] != w[:-1]
    return order, np.cumsum(new)


def strings_at(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings of `buffer` that start at `start`, one after another."""
    return buffer[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def collapse(buffer: bytes, start: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, representative of each string): strings are put together only if they are equal.

    buffer ends with PAD. Strings that a hash sets side by side are compared byte by byte.
    """
    word = loads(buffer, "<u8", len(buffer) - 8)
    at = [np.minimum(k, size - 8) for k in range(0, int(size.max()), 8)]  # eight bytes each, the last ones of the string
    h = scramble(anchor ^ size.astype(np.uint64))
    for k in at:
        with np.errstate(over="ignore"):
            h = scramble(h * np.uint64(0x9E3779B97F4A7C15) + word[start + k])
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order[1:]] != h[order[:-1]])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = (size[order] == size[head]) & (anchor[order] == anchor[head])
    for k in at:
        same &= word[start[order] + k[order]] == word[start[head] + k[head]]
    first = np.empty(len(order), np.int64)
    first[order] = np.where(same, head, order)
    chosen, place = np.unique(first, return_inverse=True)
    return chosen, place


def extreme_keys(
    buffer: np.ndarray, start: np.ndarray, count: np.ndarray, least: np.ndarray, most: np.ndarray, label: np.ndarray | None, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of contexts: the smallest `least` and the largest `most` among all equal windows.

    Context i holds count[i] windows, the first at start[i]; with labels, windows of unlike labels aren't equal. Returns
    also where each context's windows begin. Contexts with more windows than one sort takes have them dealt by their hash
    first.
    """
    begin = np.cumsum(count) - count
    window = np.repeat(start - begin, count) + np.arange(count.sum())
    lo, hi = np.repeat(least, count), np.repeat(most, count)
    apart = None if label is None else np.repeat(label, count)
    if len(window) <= SORT_WINDOWS:
        size = count + length - 1
        packed = strings_at(buffer, start, size).tobytes() + PAD
        own = np.cumsum(size) - size
        order, run = sort_prefixes(packed, own, count, length)
        place = np.zeros(len(packed), np.int64)
        place[np.repeat(own - begin, count) + np.arange(len(window))] = np.arange(len(window))
        _spread_extremes(place[order], run, lo, hi, apart)
        return lo, hi, begin
    word = loads(buffer.tobytes() + PAD, "<u8", len(buffer) + 8)
    h = np.zeros(len(window), np.uint64)
    for k in (*range(0, length - 8, 8), length - 8):
        with np.errstate(over="ignore"):
            h = scramble(h * np.uint64(0x9E3779B97F4A7C15) + word[window + k])
    shares = (h % np.uint64(2 * len(window) // SORT_WINDOWS + 1)).astype(np.int64)
    for share in range(int(shares.max()) + 1):
        own = np.flatnonzero(shares == share)
        one = np.ones(len(own), np.int64)
        packed = strings_at(buffer, window[own], one * length).tobytes() + PAD
        order, run = sort_prefixes(packed, np.arange(len(own)) * length, one, length)
        _spread_extremes(own[order // length], run, lo, hi, apart)
    return lo, hi, begin


def _spread_extremes(order: np.ndarray, run: np.ndarray, lo: np.ndarray, hi: np.ndarray, apart: np.ndarray | None) -> None:
    """Give every window of a run (and one label) the smallest lo and the largest hi of the run."""
    if not len(order):
        return
    new = np.append(True, run[1:] != run[:-1])
    if apart is not None:
        within = np.lexsort((apart[order], run))
        order, run = order[within], run[within]
        new = np.append(True, (run[1:] != run[:-1]) | (apart[order[1:]] != apart[order[:-1]]))
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    lo[order], hi[order] = np.minimum.reduceat(lo[order], first)[run], np.maximum.reduceat(hi[order], first)[run]


def taken_spans(
    buffer: np.ndarray, head: np.ndarray, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, both: bool, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first taken window, windows) of each run of windows that a key below its `least` also has (both: another).

    The contexts' strings stand in `buffer` one after another; head: the number of their windows; least, most: the
    smallest and largest keys of documents that hold them. A sort takes whole anchors.
    """
    size = head + length - 1
    start = np.cumsum(size) - size
    order = np.argsort(anchor, kind="stable")
    change = np.append(np.flatnonzero(np.append(True, anchor[order[1:]] != anchor[order[:-1]])), len(order))
    upto = np.cumsum(head[order])
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(change) - 1:
        before = upto[change[at] - 1] if change[at] else 0
        end = max(at + 1, int(np.searchsorted(upto[change[1:] - 1], before + SORT_WINDOWS, side="right")))
        own = order[change[at] : change[end]]
        at = end
        packed = strings_at(buffer, start[own], size[own])
        place = np.cumsum(size[own]) - size[own]
        chosen, which = collapse(packed.tobytes() + PAD, place, size[own], anchor[own])
        low, high = np.full(len(chosen), NO_KEY), np.full(len(chosen), -NO_KEY)
        np.minimum.at(low, which, least[own])
        np.maximum.at(high, which, most[own])
        # An anchor is made from its windows alone, unless a group is mixed in.
        lo, hi, begin = extreme_keys(packed, place[chosen], head[own][chosen], low, high, anchor[own][chosen] if both else None, length)
        for part in range(0, len(own), 20_000):
            some = own[part : part + 20_000]
            n = head[some]
            member = np.repeat(np.arange(len(some)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = begin[which[part : part + 20_000]][member] + nth
            mine = least[some][member]
            taken = (lo[window] < mine) | (hi[window] > mine) if both else lo[window] < mine
            t = np.flatnonzero(taken)
            if len(t):
                new = np.append(True, (member[t[1:]] != member[t[:-1]]) | (t[1:] != t[:-1] + 1))
                begun = np.flatnonzero(new)
                out.append((some[member[t[begun]]], nth[t[begun]], np.diff(np.append(begun, len(t)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def places_of(part: pa.Table, copies: set[tuple[int, int]]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Rows of a part's documents that aren't copies of earlier texts, in a fixed order, and the place of each (key, tag) in it.

    Repeated rows are one document; so their order doesn't matter.
    """
    rows: dict[tuple[int, int], int] = {}
    for i, which in enumerate(zip(part.column("key").to_pylist(), part.column("tag").to_pylist(), strict=True)):
        if which not in copies:
            rows.setdefault(which, i)
    order = sorted(rows)
    return [rows[which] for which in order], {which: n for n, which in enumerate(order)}


def distinct_documents(part: pa.Table, copies: set[tuple[int, int]], packed: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """key, text and group of these documents."""
    rows, _ = places_of(part, copies)
    body = part.column("body")
    read = unpack if packed else bytes
    return part.column("key").to_numpy()[rows], [read(body[i].as_py()) for i in rows], part.column("group").to_numpy()[rows].view(np.uint64)


def notes_of(side: pa.Table, kind: int) -> list[dict]:
    return [r for r in side.to_pylist() if r["kind"] == kind]


def copies_of(side: pa.Table) -> set[tuple[int, int]]:
    """(key, tag) of the copies: keys may be null or repeat, so a key alone doesn't name a text."""
    return {(r["key"], r["tag"]) for r in notes_of(side, COPY)}


COPY, MARKS, SPANS = 0, 1, 2
NOTE = "part int, kind int, key long, tag long, bucket int, payload binary"
_note_schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("tag", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_dealt = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), group: str | None = None, packed_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts, notes): the documents dealt into parts, and each part's copies and removed spans (see `cut`).

    carry: further columns of docs that the parts keep; names of the parts' own columns are refused. With a group, strings only match within one value of that column,
    and a string in documents of different keys is removed from all of them. packed_bytes: texts come from `pack`, and parts are
    sized by this many bytes in all; docs are then read once.
    """
    packed = packed_bytes is not None
    clash = set(carry) & {"doc_id", "key", "tag", "body", "group", "part", "n_bytes", "spans", "kept"}
    if clash:
        raise ValueError(f"carried columns must have other names than {', '.join(sorted(clash))}")
    spark = docs.sparkSession
    bounded_batches(spark)
    body = F.col(text) if packed else F.coalesce(F.col(text), F.lit("")).cast("binary")
    group_hash = F.lit(0).cast("long") if group is None else F.xxhash64(group)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), body.alias("body"), group_hash.alias("group"), *carry)
    ids = rows.select("key", F.xxhash64("body").alias("tag"), F.md5("body").alias("digest"), F.octet_length("body").alias("n"))
    weights = [F.octet_length("body")]
    for f in rows.select(*carry).schema:  # parts are sized by all bytes that they hold
        kind = f.dataType.typeName()
        if kind in ("string", "binary", "array"):
            weights.append(F.coalesce(F.octet_length(F.to_json(f.name) if kind == "array" else f.name), F.lit(0)))
    size = packed_bytes if packed else sum(x or 0 for x in rows.agg(*(F.sum(w) for w in weights)).first())
    parts_n = max(partitions(spark), -(-size // PART_BYTES))
    part_of = lambda: F.pmod(F.xxhash64("key", "tag"), F.lit(parts_n)).cast("int")
    if group is None:
        earliest = ids.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1")
        earliest = materialize(earliest.drop("copies"), "earliest")  # so the join has exchanges of its own, and can split a hot digest
        copies = materialize(ids.where(F.col("n") >= length).join(earliest, "digest").where("key > first").select("key", "tag").distinct(), "copies")
    else:
        copies = spark.createDataFrame([], "key long, tag long")  # every copy testifies
    copy_notes = copies.select(part_of().alias("part"), F.lit(COPY).alias("kind"), "key", "tag", F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("payload"))
    parts = rows.withColumn("tag", F.xxhash64("body")).select(part_of().alias("part"), "doc_id", "key", "tag", "body", "group", *carry)

    def hashes_of(part: pa.Table, side: pa.Table) -> tuple:
        """Of a part: keys, texts, and its anchors by bucket and hash: (owner, first, count, hash), distinct ones, cuts by bucket."""
        keys, texts, groups = distinct_documents(part, copies_of(side), packed)
        owner, first, count, h = anchors(texts, length)
        h = h ^ groups[owner]
        bucket = (scramble(h) % np.uint64(parts_n)).astype(np.int64)
        order = np.lexsort((h, bucket))
        owner, first, count, h, bucket = (x[order] for x in (owner, first, count, h, bucket))
        heads = np.flatnonzero(np.append(len(h) > 0, h[1:] != h[:-1]))
        return keys, texts, owner, first, count, h, heads, np.searchsorted(bucket[heads], np.arange(parts_n + 1))

    def deal_anchors(part: pa.Table, side: pa.Table) -> pa.Table:
        """For each bucket: the part's distinct hashes (half of each: what only looks equal is sorted in vain), and a bit for those that several of its documents hold."""
        if not part.num_rows:
            return _rows([], _dealt)
        number = part.column("part")[0].as_py()
        _, _, owner, _, _, h, heads, cuts = hashes_of(part, side)
        several = np.maximum.reduceat(owner, heads) > np.minimum.reduceat(owner, heads) if len(heads) else np.zeros(0, bool)
        own = h[heads]
        return _rows([(b, number, pack_hashes(own[lo:hi], several[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if lo < hi], _dealt)

    def mark_repeated(dealt: pa.Table) -> pa.Table:
        """For each part: a bit for each of its hashes that several documents hold."""
        rows_ = dealt.to_pylist()
        hashes_, bits = zip(*(unpack_hashes(r["payload"]) for r in rows_), strict=True)
        sizes, every, several = list(map(len, hashes_)), np.concatenate(hashes_), np.concatenate(bits)
        order = np.argsort(every, kind="stable")
        equal = every[order[1:]] == every[order[:-1]]
        several[order[1:][equal]] = several[order[:-1][equal]] = True
        first = np.flatnonzero(np.append(True, ~equal))
        some = np.logical_or.reduceat(several[order], first)
        several[order] = some[np.cumsum(np.append(True, ~equal)) - 1]
        marks = np.split(several, np.cumsum(sizes)[:-1])
        return _rows([(r["part"], MARKS, 0, 0, r["bucket"], np.packbits(m).tobytes()) for r, m in zip(rows_, marks, strict=True) if m.any()], _note_schema)

    def deal_contexts(part: pa.Table, side: pa.Table) -> pa.Table:
        """For each bucket: distinct contexts of repeated hashes with their extreme keys, and the places that hold them."""
        if not part.num_rows:
            return _rows([], _dealt)
        number = part.column("part")[0].as_py()
        keys, texts, owner, first, count, h, heads, cuts = hashes_of(part, side)
        ends = np.append(heads[1:], len(h))
        lengths = np.array([len(t) for t in texts], np.int64)
        origin = np.cumsum(lengths) - lengths
        buffer = np.frombuffer(b"".join(texts) + PAD, np.uint8)
        del texts
        out = []
        for r in notes_of(side, MARKS):
            lo, hi = cuts[r["bucket"]], cuts[r["bucket"] + 1]
            marked = lo + np.flatnonzero(np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=hi - lo))
            many = ends[marked] - heads[marked]
            own = np.repeat(heads[marked] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            start, size, key = origin[owner[own]] + first[own], count[own] + length - 1, keys[owner[own]]
            chosen, which = collapse(strings_at(buffer, start, size).tobytes() + PAD, np.cumsum(size) - size, size, h[own])
            least, most = np.full(len(chosen), NO_KEY), np.full(len(chosen), -NO_KEY)
            np.minimum.at(least, which, key)
            np.maximum.at(most, which, key)
            covered = key > least[which] if group is None else (least < most)[which]  # by this part's own documents
            kept = own[chosen]
            steps = np.diff(h[kept], prepend=np.uint64(0)), np.diff(which.astype("<i4"), prepend=np.int32(0))
            columns = [steps[0], least, most - least, count[kept].astype("u1"), steps[1], owner[own].astype("<i4"), first[own].astype("<i4"), np.packbits(covered)]
            strings = strings_at(buffer, start[chosen], size[chosen])
            out.append((r["bucket"], number, pack(struct.pack("<qq", len(chosen), len(own)) + b"".join(map(planes, (*columns, strings))))))
        return _rows(out, _dealt)

    def sort_bucket(dealt: pa.Table) -> pa.Table:
        """For each part: spans (document, start, stop) whose windows another document also holds."""
        kinds = ("<u8", "<i8", "<i8", "u1")
        contexts: list[list[np.ndarray]] = [[], [], [], [], []]
        members = []
        payloads = dealt.column("payload")
        for i in range(len(payloads)):
            raw = unpack(payloads[i].as_buffer())
            n, m = struct.unpack_from("<qq", raw)
            at = 16
            for column, kind in zip(contexts, kinds, strict=False):
                column.append(of_planes(raw, kind, n, at))
                at += column[-1].nbytes
            contexts[0][-1] = np.cumsum(contexts[0][-1], dtype=np.uint64)
            contexts[2][-1] = contexts[1][-1] + contexts[2][-1]
            member = np.stack([of_planes(raw, "<i4", m, at + 4 * m * k) for k in range(3)])
            member[0] = np.cumsum(member[0], dtype=np.int32)
            at += member.nbytes
            covered = np.unpackbits(np.frombuffer(raw, np.uint8, -(-m // 8), at), count=m).astype(bool)
            contexts[4].append(np.frombuffer(raw, np.uint8, offset=at + -(-m // 8)))
            members.append((member, covered))
        number = dealt.column("part").to_numpy()
        base = np.cumsum([len(x) for x in contexts[0]]) - [len(x) for x in contexts[0]]
        h, least, most, count, buffer = (np.concatenate(x) for x in contexts)
        del contexts, column, raw  # what was unpacked is held once from here on
        count = count.astype(np.int64)
        context, lo, n = taken_spans(buffer, count, h, least, most, group is not None, length)
        order = np.argsort(context, kind="stable")
        context, lo, n = context[order], lo[order], n[order]
        found: list[tuple] = []
        for part, begin, (member, covered) in zip(number.tolist(), base.tolist(), members, strict=True):
            which, owner, first = (x.astype(np.int64) for x in member)
            which += begin
            from_, to = (np.searchsorted(context, which, side=side) for side in ("left", "right"))
            own = np.repeat(np.arange(len(which)), np.where(covered, 0, to - from_))
            nth = np.arange(len(own)) - np.searchsorted(own, own)
            at = from_[own] + nth
            whole = np.flatnonzero(covered)
            starts = np.concatenate([first[own] + lo[at], first[whole]])
            stops = np.concatenate([first[own] + lo[at] + n[at], first[whole] + count[which[whole]]]) + length - 1
            if len(starts):
                spans = np.stack([np.concatenate([owner[own], owner[whole]]), starts, stops]).astype("<i4")
                spans = spans[:, np.lexsort((spans[1], spans[0]))]
                spans[2] -= spans[1]
                found.append((part, SPANS, 0, 0, 0, pack(planes(np.diff(spans, axis=1, prepend=np.int32(0)).ravel()))))
        return _rows(found, _note_schema)

    dealt_schema = "bucket int, part int, payload binary"
    by_part = lambda df: df.groupBy("part")
    hashes = by_part(parts).cogroup(by_part(copy_notes)).applyInArrow(releasing_pair(deal_anchors), dealt_schema)
    marks = hashes.groupBy("bucket").applyInArrow(releasing_group(mark_repeated), NOTE)
    contexts = by_part(parts).cogroup(by_part(copy_notes.unionByName(marks))).applyInArrow(releasing_pair(deal_contexts), dealt_schema)
    spans = contexts.groupBy("bucket").applyInArrow(releasing_group(sort_bucket), NOTE)
    return parts, copy_notes.unionByName(spans)


def spans_of(packed: bytes) -> np.ndarray:
    """[document, start, stop] of a note."""
    raw = unpack(packed)
    spans = np.cumsum(of_planes(raw, "<i4", len(raw) // 4).reshape(3, -1), axis=1, dtype=np.int64)
    spans[2] += spans[1]
    return spans


def cut(parts: DataFrame, notes: DataFrame, length: int = LENGTH, whole: bool = False, packed: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, stop>> (removed byte runs), kept binary (if whole: the whole text, with them), and the carried columns."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span_type), ("kept", pa.binary())])
    carried = [f for f in parts.schema if f.name not in ("part", "doc_id", "key", "tag", "body", "group")]

    def apply(part: pa.Table, side: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _rows([], schema)
        copies = copies_of(side)
        found = [spans_of(r["payload"]) for r in notes_of(side, SPANS)]
        spans = np.hstack(found) if found else np.zeros((3, 0), np.int64)
        spans = spans[:, np.lexsort((spans[1], spans[0]))]
        own: dict[int, list[list[int]]] = {}
        if spans.shape[1]:  # spans of a document that touch become one
            reach = np.maximum.accumulate(spans[2] + (spans[0] << 32)) - (spans[0] << 32)
            new = np.append(True, (spans[0, 1:] != spans[0, :-1]) | (spans[1, 1:] > reach[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], spans.shape[1]) - 1
            for d, lo, hi in zip(spans[0, first].tolist(), spans[1, first].tolist(), reach[last].tolist(), strict=True):
                own.setdefault(d, []).append([lo, hi])
        _, place = places_of(part, copies)
        out = []
        columns = (part.column(c).to_pylist() for c in ("doc_id", "key", "tag", "body"))
        for doc, k, t, text in zip(*columns, strict=True):
            text = unpack(text) if packed else text
            runs = own.get(place[k, t], []) if (k, t) in place else [[0, len(text)]]
            kept, at = [], 0
            for lo, hi in () if whole else runs:
                kept.append(text[at:lo])
                at = hi
            out.append((doc, len(text), [{"start": lo, "stop": hi} for lo, hi in runs], b"".join([*kept, text[at:]])))
        result = _rows(out, schema)
        for f in carried:
            result = result.append_column(f.name, part.column(f.name))
        return result

    out_type = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    out_type = ", ".join([out_type, *(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)])
    return parts.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(releasing_pair(apply), out_type)


def shared_spans(docs: DataFrame, key: str, text: str, group: str, length: int = LENGTH, carry: tuple[str, ...] = (), whole: bool = False, packed_bytes: int | None = None) -> DataFrame:
    """key, n_bytes, spans, kept (see `cut`) and the carried columns: spans that documents of different keys in one group share."""
    return cut(*repeated_spans(docs, key, text, length, carry, group, packed_bytes), length, whole, packed_bytes is not None).withColumnRenamed("doc_id", key)


def decode(kept: Column) -> Column:
    """The text of kept bytes; the rest of a character that a span cut in two goes with it."""

    @F.pandas_udf("string")
    def whole(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v.decode("utf-8", "ignore"))

    return whole(kept)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans, kept of every document."""
    return cut(*repeated_spans(docs, key, text, length), length)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS s FROM d),
w AS (SELECT doc_id, s, md5(substr(x, s * 2 + 1, 100)) AS k FROM g),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
r AS (SELECT doc_id, s FROM w JOIN m USING (k) WHERE doc_id > least),
o AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER p <= 50 THEN 0 ELSE 1 END AS new FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY s)),
n AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM o),
u AS (SELECT doc_id, run, min(s) AS lo, max(s) + 50 AS hi FROM n GROUP BY doc_id, run),
b AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM u),
c AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
             string_agg(substr(x, since * 2 + 1, (lo - since) * 2), '' ORDER BY lo) AS kept FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, last * 2 + 1), x))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
