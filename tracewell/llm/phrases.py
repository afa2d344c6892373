"""Phrase collocations: contiguous phrases of two to five words that occur more often than their parts would by chance.

A language's words are ranked by frequency, and texts become sequences of ranks; a word that is too rare ends a run, as
punctuation does. The next level counts pairs of neighbouring ranks by direct address: pairs fall into tiles of the two
ranks' high bits, a tile that holds many pairs is counted densely by its low bits, and all others in a sorted list of
coordinates. Pairs that are frequent over the corpus are ranked in turn, the sequences are written in their ranks, and the
same counting of neighbours gives phrases of three words, then four, then five: a phrase of k + 1 words is the pair of its
first and its last k words, both of which must be frequent.

Texts stay in chunks, a row each. A chunk counts its own words and pairs first, so none has more rows in a shuffle than there
are chunks. What is frequent goes to all tasks as long as it is few (FEW_WORDS words, `common.SMALL` pairs); beyond, a chunk gets back the ranks of
its own words or pairs by a join, and a bit array of the frequent pairs, of one size whatever the corpus, spares that way
for most pairs that are not frequent.

Defined cases: a null text is empty; a null language is `und`; rows count as often as they stand there, keys play no part;
an empty table gives no rows; other columns are ignored. Phrases, counts and scores are exact; the score's products are
decimal numbers of 38 digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import common
from tracewell.llm.common import bounded_batches, materialize, scramble
from tracewell.session import table

LEAST, LONGEST, BEST = 100, 5, 2000
#: Words of a chunk, about; bytes of a text that are split at once; low bits of ranks in a tile; bits of the array of frequent pairs.
CHUNK_WORDS, SPLIT_BYTES, TILE_BITS, FILTER_BITS = 3 << 19, 4 << 20, 9, 26
#: Places of a sequence that are worked on at once.
PLACES = 1 << 18
#: Frequent words that every task may hold; a join takes the way of more.
FEW_WORDS = 1 << 17
#: Pairs from which a tile is counted densely, as a share of its cells.
DENSE = 1 / 4
_BREAK = 0xFF  # no byte of UTF-8
_BYTES = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNKS = "chunk long, seq binary, langs array<string>, words array<string>, counts array<long>"


def pack(seq: np.ndarray) -> bytes:
    """Ranks as bytes: low bytes of all numbers, then the next ones, compressed."""
    raw = np.ascontiguousarray(seq.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def runs(seq: np.ndarray) -> np.ndarray:
    """seq with one break (-1) for each run of breaks."""
    return seq[(seq >= 0) | (np.append(-1, seq[:-1]) >= 0)]


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SPLIT_BYTES, cut at spaces."""
    at = 0
    while len(text) - at > SPLIT_BYTES:
        to = text.find(b" ", at + SPLIT_BYTES)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: dict[str, defaultdict] = {}
    counter, seq, held = count(), [], 0

    def flush() -> pa.RecordBatch:
        every = runs(np.concatenate(seq))
        langs, words = [], []
        for lang, own in ids.items():
            words += [w.decode() for w in own if w != b"\xff"]
            langs += [lang] * (len(own) - 1)
        order = np.argsort(np.concatenate([np.fromiter((v for v in own.values() if v >= 0), np.int64) for own in ids.values()]), kind="stable")
        n = np.bincount(every[every >= 0], minlength=len(words))
        rows = [[number], [pack(every)], [[langs[k] for k in order]], [[words[k] for k in order]], [n]]
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["chunk", "seq", "langs", "words", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = ids.get(lang)
            if own is None:
                own = ids[lang] = defaultdict(counter.__next__, {b"\xff": -1})
            for part in parts_of(text.encode().translate(_BYTES).replace(b"\xff", b" \xff ")):
                words = part.split()
                seq.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                held += len(words)
            seq.append(np.array([-1], np.int32))
            if held >= CHUNK_WORDS:
                yield flush()
                ids, counter, seq, held, number = {}, count(), [], 0, number + 1
    if held:
        yield flush()


def neighbours(seq: np.ndarray) -> np.ndarray:
    """rank << 32 | next rank at each place; -1 where either is a break."""
    out = np.full(max(0, len(seq) - 1), -1, np.int64)
    for at in range(0, len(out), PLACES):
        x, y = seq[at : at + PLACES], seq[at + 1 : at + 1 + PLACES]
        x = x[: len(y)]
        both = (x >= 0) & (y >= 0)
        out[at : at + len(y)][both] = x[both].astype(np.int64) << 32 | y[both]
    return out


def count_tiles(codes: np.ndarray, bits: int = TILE_BITS, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts: dense tiles by direct address, the others as sorted coordinates."""
    low = np.int64((1 << bits) - 1)
    tile = (codes >> 32 + bits) << 32 | (codes & 0xFFFFFFFF) >> bits
    order = np.argsort(tile, kind="stable")
    edges = np.flatnonzero(np.diff(tile[order], prepend=-1, append=-1))
    sizes = np.diff(edges)
    out, rest = [], np.ones(len(codes), bool)
    for k in np.flatnonzero(sizes >= dense * 4**bits):
        rows = order[edges[k] : edges[k + 1]]
        rest[rows] = False
        cells = np.bincount(((codes[rows] >> 32) & low) << bits | codes[rows] & low, minlength=1)
        held = np.flatnonzero(cells)
        base = tile[rows[0]]
        first = ((base >> 32) << bits) + (held >> bits)
        second = ((base & 0xFFFFFFFF) << bits) + (held & low)
        out.append((first << 32 | second, cells[held]))
    out.append(np.unique(codes[rest], return_counts=True))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("seq").to_pylist():
            codes = neighbours(unpack(data))
            codes = codes[codes >= 0]
            code, n = count_tiles(codes)
            del codes
            for at in range(0, len(code), 1 << 18):
                yield pa.record_batch([pa.array(code[at : at + (1 << 18)]), pa.array(n[at : at + (1 << 18)].astype(np.int64))], names=["code", "n"])


def ranked(frequent: DataFrame, key: list[str]) -> DataFrame:
    """frequent (key, n) with `rank` from 0: by classes of frequency (an eighth of a doubling), in each by slices of the key's hash, in each by n."""
    slice_ = F.pmod(F.xxhash64(*key), F.lit(16)).cast("int")
    rows = materialize(frequent.withColumns({"class": F.floor(F.log2("n") * 8).cast("int"), "slice": slice_}), "frequent")
    cells = rows.groupBy("class", "slice").agg(F.count("*").alias("held"))  # at most some thousand
    before = W.orderBy(F.desc("class"), "slice").rowsBetween(W.unboundedPreceding, -1)
    base = cells.select("class", "slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("class", "slice").orderBy(F.desc("n"), *key))
    numbered = rows.withColumn("nth", inside).join(base, ["class", "slice"])
    return materialize(numbered.withColumn("rank", (F.col("base") + F.col("nth") - 1).cast("int")).drop("class", "slice", "nth", "base"), "ranked")


def _slot(codes: np.ndarray) -> np.ndarray:
    return (scramble(codes.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def bit_array(frequent: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the codes' hashes set; the driver gets at most that many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_slot(batch.column("code").to_numpy())] = True
        words = np.packbits(bits, bitorder="little").view("<i8")
        held = np.flatnonzero(words)
        yield pa.record_batch([pa.array(held), pa.array(words[held])], names=["place", "bits"])

    words = frequent.select("code").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros((1 << FILTER_BITS) // 64, "<i8")
    out[words["place"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def ranks_of(codes: np.ndarray, names: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The ranks of codes, -1 for those that aren't among the ascending names."""
    new = np.full(len(codes), -1, np.int32)
    for lo in range(0, len(codes) if len(names) else 0, PLACES):
        part = codes[lo : lo + PLACES]
        at = np.minimum(np.searchsorted(names, part), len(names) - 1)
        new[lo : lo + PLACES] = np.where(names[at] == part, ranks[at], -1)
    return new


def rewrite_words(chunks: DataFrame, top: DataFrame) -> DataFrame:
    """chunk, seq in ranks of words, where all frequent words are few: every task has them."""
    rows = top.select("lang", "phrase", "rank").toPandas()
    known = chunks.sparkSession.sparkContext.broadcast(dict(zip(zip(rows["lang"], rows["phrase"], strict=True), rows["rank"].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, get = [], known.value.get
            for k, data in enumerate(batch.column("seq").to_pylist()):
                langs, words = (batch.column(c).slice(k, 1).flatten().to_pylist() for c in ("langs", "words"))
                of = np.fromiter((get(w, -1) for w in zip(langs, words, strict=True)), np.int32, len(words))
                out.append(pack(runs(np.append(of, np.int32(-1))[unpack(data)])))  # the last place is that of a break
            yield pa.record_batch([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "seq"])

    return materialize(chunks.select("chunk", "seq", "langs", "words").mapInArrow(run, "chunk long, seq binary"), "ranks")


def rewrite_all(seqs: DataFrame, top: DataFrame) -> DataFrame:
    """chunk, seq in ranks of the next level, where all frequent pairs are few: every task has them."""
    rows = top.select("code", "rank").toPandas().sort_values("code")
    table_ = seqs.sparkSession.sparkContext.broadcast((rows["code"].to_numpy(np.int64), rows["rank"].to_numpy(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pack(runs(ranks_of(neighbours(unpack(data)), *table_.value))) for data in batch.column("seq").to_pylist()]
            yield pa.record_batch([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "seq"])

    return materialize(seqs.select("chunk", "seq").mapInArrow(run, "chunk long, seq binary"), "ranks")


def rewrite(seqs: DataFrame, told: DataFrame, words: bool) -> DataFrame:
    """chunk, seq in ranks of the next level. told: chunk, places (or codes) and ranks of what is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, data in enumerate(batch.column("seq").to_pylist()):
                names, ranks = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in ("names", "ranks"))
                seq = unpack(data)
                if words:
                    of = np.full(int(seq.max(initial=-1)) + 2, -1, np.int32)  # the last place is that of -1
                    of[names] = ranks
                    new = of[seq]
                else:
                    order = np.argsort(names)
                    new = ranks_of(neighbours(seq), names[order], ranks[order])
                out.append(pack(runs(new)))
            yield pa.record_batch([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "seq"])

    told = told.groupBy("chunk").agg(F.collect_list("name").alias("names"), F.collect_list("rank").alias("ranks"))
    return materialize(seqs.select("chunk", "seq").join(told, "chunk").mapInArrow(run, "chunk long, seq binary"), "ranks")


def _asked(bits) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                codes, held = neighbours(unpack(data)), [np.zeros(0, np.int64)]
                for at in range(0, len(codes), PLACES):
                    part = codes[at : at + PLACES]
                    slot = _slot(part)
                    held.append(np.unique(part[(bits.value[slot >> 6] >> (slot & 63) & 1 == 1) & (part >= 0)]))
                codes = np.unique(np.concatenate(held))
                for at in range(0, len(codes), 1 << 18):
                    part = codes[at : at + (1 << 18)]
                    yield pa.record_batch([pa.array(np.full(len(part), chunk, np.int64)), pa.array(part)], names=["chunk", "code"])

    return run


def _own_ranks(chunks: DataFrame, top: DataFrame) -> DataFrame:
    """chunk, name (a word's number in its chunk), rank of the frequent words of chunks."""
    own = chunks.select("chunk", F.posexplode(F.arrays_zip("langs", "words")).alias("name", "w")).select("chunk", "name", F.col("w.langs").alias("lang"), F.col("w.words").alias("phrase"))
    return own.join(top.select("lang", "phrase", "rank"), ["lang", "phrase"]).select("chunk", "name", "rank")


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """(tables of frequent phrases of 1, 2, ... words; lang, n). A phrase: rank, lang, phrase, last (word), n, left and right
    (ranks of its first and last words, one fewer), pre and suf (counts of its first 1, 2, ... words and of the rest)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = materialize(plain.mapInArrow(_words, CHUNKS), "chunks")
    totals = chunks.select(F.explode(F.arrays_zip("langs", "counts")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.counts").alias("n"))
    counts = chunks.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w")).groupBy(F.col("w.langs").alias("lang"), F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("n"))
    top = ranked(counts.where(F.col("n") >= least), ["lang", "phrase"])
    none = F.array().cast("array<long>")
    found = [top.select("rank", "lang", "phrase", F.col("phrase").alias("last"), "n", F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"), none.alias("pre"), none.alias("suf"))]
    if top.count() <= min(FEW_WORDS, common.SMALL):
        seqs = rewrite_words(chunks, top)
    else:
        seqs = rewrite(chunks, _own_ranks(chunks, top), words=True)
    for size in range(2, longest + 1):
        pairs = seqs.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        top = ranked(pairs, ["code"])
        if not top.limit(1).count():
            break
        top = top.withColumns({"left": F.shiftright("code", 32).cast("int"), "right": F.col("code").bitwiseAND(0xFFFFFFFF).cast("int")})
        left = found[-1].select(F.col("rank").alias("left"), "lang", "phrase", "pre", F.col("n").alias("left_n"))
        right = found[-1].select(F.col("rank").alias("right"), "last", "suf", F.col("n").alias("right_n"))
        named = top.join(left, "left").join(right, "right")
        named = named.select(
            "rank", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n", "left", "right",
            F.concat("pre", F.array("left_n")).alias("pre"), F.concat(F.array("right_n"), "suf").alias("suf"),
        )
        found.append(materialize(named, "phrases"))
        if size < longest and top.count() <= common.SMALL:
            seqs = rewrite_all(seqs, top)
        elif size < longest:
            bits = spark.sparkContext.broadcast(bit_array(top))
            asked = seqs.mapInArrow(_asked(bits), "chunk long, code long")
            seqs = rewrite(seqs, asked.join(top.select("code", "rank"), "code").withColumnRenamed("code", "name"), words=False)
    return found, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases, without those that a longer one always encloses."""
    found, totals = levels(docs, text, lang, least, longest)
    kept = []
    for k, phrases in enumerate(found[1:], 1):
        if k + 1 < len(found):  # a phrase inside a much longer one of the same count is inside one that is a word longer
            sides = F.array(F.struct(F.col("left").alias("rank"), F.element_at("pre", -1).alias("own")), F.struct(F.col("right").alias("rank"), F.element_at("suf", 1).alias("own")))
            inside = found[k + 1].select("n", F.explode(sides).alias("s")).where("n >= s.own").select(F.col("s.rank").alias("rank")).distinct()
            phrases = phrases.join(inside, "rank", "left_anti")
        kept.append(phrases.select("lang", "phrase", F.col("n").alias("a"), "pre", "suf"))
    if not kept:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    big = lambda c: f"CAST({c} AS decimal(19, 0))"
    cut = f"""array_min(transform(sequence(1, size(pre)), k -> named_struct('score', CAST({big("a")} * {big("n")} * 1000 DIV ({big("pre[k - 1]")} * {big("suf[k - 1]")}) AS bigint),
        'k', k, 'l', pre[k - 1], 'r', suf[k - 1])))"""
    rows = rows.join(totals, "lang").withColumn("cut", F.expr(cut)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, d, unnest(range(len(t))) AS j, regexp_extract_all(unnest(t), '[^\x20\x09]+') AS w FROM t),
x AS (SELECT lang, d, j, unnest(range(len(w))) AS i, unnest(w) AS w FROM p),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
y AS (SELECT lang, w AS s1, w || ' ' || lead(w) OVER o AS s2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS s3, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS s4,
  w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s5 FROM x WINDOW o AS (PARTITION BY d, j ORDER BY i)),
g AS (SELECT lang, 1 AS k, s1 AS s, count(*) AS a FROM y GROUP BY lang, s1 UNION ALL SELECT lang, 2, s2, count(*) FROM y WHERE s2 IS NOT NULL GROUP BY lang, s2 UNION ALL SELECT lang, 3, s3, count(*) FROM y WHERE s3 IS NOT NULL GROUP BY lang, s3
  UNION ALL SELECT lang, 4, s4, count(*) FROM y WHERE s4 IS NOT NULL GROUP BY lang, s4 UNION ALL SELECT lang, 5, s5, count(*) FROM y WHERE s5 IS NOT NULL GROUP BY lang, s5),
c AS (SELECT lang, k, s, string_split(s, ' ') AS w, a FROM g WHERE k > 1 AND a >= 100),
i AS (SELECT DISTINCT lang, a, array_to_string(w[b:e], ' ') AS s FROM (SELECT lang, a, w, b, unnest(range(b + 1, len(w) + 1)) AS e FROM (SELECT lang, a, w, unnest(range(1, len(w))) AS b FROM c)) WHERE e - b + 1 < len(w)),
u AS (SELECT c.lang, c.s, c.a, l.a AS l, r.a AS r, n.n, c.j, (CAST(1000 AS hugeint) * c.a * n.n) // (CAST(l.a AS hugeint) * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c JOIN n ON n.lang = c.lang JOIN g AS l ON l.lang = c.lang AND l.s = array_to_string(c.w[1:c.j], ' ') JOIN g AS r ON r.lang = c.lang AND r.s = array_to_string(c.w[c.j + 1:c.k], ' ')
  WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.s = c.s AND i.a >= c.a)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, CAST(score AS bigint) AS score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) <= 2000"""
