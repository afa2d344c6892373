"""Decontamination, tokenizer alignment and phrases against brute force, on awkward small tables."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import alignment, common, decontamination, phrases
from tracewell.llm.tokens import plain_encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, items string, starts int, chunk long"
BASE = "the of and to in is no on at as by it he we".split()


def some(rng, n, every=BASE):
    return [every[i] for i in rng.integers(0, len(every), n)]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window):
    strings = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            strings.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(s) for s in strings}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in strings:
                    hit |= set(range(i, i + n))
                    found |= strings[tuple(w[i : i + n])]
        out.append((key, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    items = [" ".join(some(rng, int(n))) for n in (30, 14, 10, 9, 3, 40)]
    items += [items[0].replace(" ", ", "), "Qé", "", None, "one", "ab 12", "...", items[1]]
    docs = [" ".join(some(rng, int(rng.integers(0, 400)))) for _ in range(40)]
    for k, item in enumerate(items[:7]):
        docs[3 * k] += f"\n{item.upper()}!{docs[3 * k]}"
        docs[3 * k + 1] = f"{item[: len(item) // 2]} {docs[3 * k + 1]}"
    docs += [None, "", "   ", "one", "ONE.", "qé", "QÉ", "x" * 5000, "ab-12", docs[0], items[0], "\x00one\x7fone", "ß one"]
    docs += [" ".join([*some(rng, 20_000), items[5], *some(rng, 20_000)])]
    return list(enumerate(docs)), list(enumerate(items))


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_decontamination(spark, texts, block_bytes):
    docs, items = texts
    docs, items = [*docs, (0, docs[0][1]), (None, "one")], [*items, (None, "He we"), (0, "zz top")]
    frame = spark.createDataFrame([(k, t, "en", "x", 1, 2) for k, t in docs], SCHEMA).repartition(3)
    tests = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, words string")
    got = decontamination.find_items(frame, tests, block_bytes=block_bytes).collect()
    got = [(r.doc_id, r.n_words, [w for h in r.hits for w in range(h.start, h.end)], list(r["items"])) for r in got]
    assert sorted(got, key=repr) == sorted(contamination(docs, items, 10), key=repr)
    assert sum(bool(r[2]) for r in got) > 15 and not all(r[2] for r in got)
    nothing = spark.createDataFrame([], SCHEMA)
    assert decontamination.find_items(nothing, tests).count() == 0
    assert all(not r.hits and not r["items"] for r in decontamination.find_items(frame, nothing.withColumnRenamed("doc_id", "item_id")).collect())


def test_shifts_skip():
    """A long text without test strings is left at few places."""
    rng = np.random.default_rng(5)
    tests = decontamination.TestStrings([" ".join(f"word{i}" for i in rng.integers(0, 9999, 10)) for _ in range(500)], [["a"]] * 500)
    (blocks,) = tests.classes
    text = np.frombuffer(b"\0" * 8 + bytes(rng.integers(97, 123, 200_000, dtype=np.uint8)), np.uint8)
    assert np.median(blocks.shift) == blocks.least - 7 and list(blocks.search(text)) == []


HOSTILE = ["a  b", " lead", "trail ", "tab\tx", "a\nb\r\n", "<|endoftext|> x", "<s> </s>", "é ü ß", "日本語 テキスト", "🙂 ok", "x▁y", "▁", " ", "   ", "\x1c a", " nbsp", "don't we'll", "1234 5", "<0x41>", "a" * 3000]


def tokens(text):
    from tokenizers import Tokenizer
    import sentencepiece

    if "a" not in tokens.__dict__:
        tokens.a, tokens.b = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
        tokens.a.encode_special_tokens = True
    return tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)


def test_plain_encoders_agree_with_the_libraries():
    rng = np.random.default_rng(4)
    parts = [*HOSTILE, "<|", "|>", "the", "The", " ", "  ", "\n", "…", "ﬁ", "x1", "'s"]
    texts = [t for t in ["".join(some(rng, int(rng.integers(1, 8)), parts)) for _ in range(3000)] if t]
    a, b = (plain_encoder(vocabulary(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    want = [tokens(t) for t in texts]
    assert [x.tolist() for x in a.encode([" " + t for t in texts])] == [w[0] for w in want]
    assert b.apart and [x.tolist() for x in b.encode(texts)] == [w[1] for w in want]


def test_alignment(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [*HOSTILE, None, "", *(" ".join(some(rng, int(rng.integers(1, 60)), [*BASE, "unaligned", "Tokenizer", "straße", "año", "x-y", "3.14"])) for _ in range(60))]
    rows += [rows[-1], " ".join(some(rng, 5000))]
    pa_, pb_ = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    sides = alignment.Side(pa_, True), alignment.Side(pb_, False)
    vocab = [side.encoder.token_bytes() for side in sides]
    brute, links = [], Counter()
    for t in rows:
        a, b = tokens(t) if t else ([], [])
        if t and not (b"".join(vocab[0][k] for k in a) == b"".join(vocab[1][k] for k in b) == f" {t}".encode()):
            a, b = [], []
        ends = [list(itertools.accumulate(int(s.length[k]) for k in ids)) for s, ids in zip(sides, (a, b))]
        groups, own, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            own.append((a[p - 1], b[q - 1]))
            i, j = p, q
        starts = [[0, *e[:-1]] for e in ends]
        over = sum(x < f and u < y for x, y in zip(starts[0], ends[0]) for u, f in zip(starts[1], ends[1])) if len(a) < 500 else None
        links.update(own)
        brute.append((len(a), len(b), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", over))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(n, most.get(b, 0))
    want = {k: (na, nb, ng, len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), sha, over) for k, (na, nb, ng, own, sha, over) in enumerate(brute)}
    assert sum(w[0] == 0 for w in want.values()) >= 4 and sum(w[2] < min(w[0], w[1]) for w in want.values()) > 20
    for joined, size in ((1 << 19, 1 << 21), (7, 50)):
        monkeypatch.setattr(alignment, "JOINED", joined)
        monkeypatch.setattr(alignment, "CHUNK_LINKS", size)
        frame = spark.createDataFrame([(k, t, "en", "x", 1, 2) for k, t in enumerate(rows)], SCHEMA).repartition(3)
        chunks = alignment.chunks_of(alignment.align(frame, pa_, pb_))
        got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_overlaps) for r in alignment.score_links(chunks, alignment.pair_counts(chunks)).collect()}
        assert len(got) == len(rows)
        assert {k: v[:7] for k, v in got.items()} == {k: v[:7] for k, v in want.items()}
        assert all(got[k][7] == w[7] for k, w in want.items() if w[7] is not None)
        assert {(r.a, r.b): r.n for r in alignment.pair_counts(chunks).collect()} == dict(links)
    chunks = alignment.chunks_of(alignment.align(frame.where(F.lit(False)), pa_, pb_))
    assert alignment.score_links(chunks, alignment.pair_counts(chunks)).count() == 0


def test_alignment_takes_one_worker_a_task(spark, monkeypatch):
    """Tokens of a task's documents don't go from one Python worker to another, and the rows are those of the two steps."""
    plans = []
    monkeypatch.setattr(alignment, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or common.materialize(df, name))
    frame = spark.createDataFrame([(k, t, "en", "x", 1, 2) for k, t in enumerate([*HOSTILE, None, ""])], SCHEMA).repartition(2)
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    one = alignment.aligned_chunks(frame, a, b)
    ((name, plan),) = plans
    assert name == "chunks" and plan.count("MapInArrow") == 1
    two = alignment.chunks_of(alignment.align(frame, a, b))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def mined(docs, least, longest, best):
    pieces = {}
    for text, lang in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            pieces.setdefault(lang or "und", []).append(re.findall("[^ \t]+", piece))
    out = []
    for lang, own in pieces.items():
        n = sum(map(len, own))
        f = Counter(tuple(w[i : i + k]) for w in own for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        frequent = {p for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p in frequent for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p[i:j]] <= f[p]}
        rows = []
        for p in frequent - inside:
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -score) for r, (score, a, p, x, y) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk, bits, split", [(1 << 21, 9, 1 << 22), (300, 2, 40)])
def test_phrases(spark, monkeypatch, chunk, bits, split):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(phrases, "TILE_BITS", bits)
    monkeypatch.setattr(phrases, "SPLIT_BYTES", split)
    monkeypatch.setattr(common, "SMALL", split - 40)  # in the second case all go by joins
    rng = np.random.default_rng(2)
    every = [*BASE[:6], "New", "york", "stock", "é", "Ünder", "it's", "\x01", "日本"]
    docs = []
    for k in range(120):
        w = some(rng, int(rng.integers(0, 40)), every)
        at = int(rng.integers(0, len(w) + 1))
        w[at:at] = [["ein", "ganz", "fester", "Satz", "hier", "drin"], ["new", "york", "city"], []][k % 3]
        marks = some(rng, len(w), [*[" "] * 14, "\t", ", ", ".", "\n", "  ", "\r\n"])
        docs.append(("".join(itertools.chain(*zip(w, marks))), ["en", "de", None][k % 3 if k % 7 else 0]))
    docs += [(None, "en"), ("", None), ("...", "fr"), ("\t ", "de"), (" ".join(some(rng, 4000, every)), "en"), docs[0], docs[0]]
    frame = spark.createDataFrame([(k, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(docs)], SCHEMA).repartition(3)
    for least, best in ((8, 2000), (5, 7)):
        got = phrases.collocations(frame, least=least, best=best)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = mined(docs, least, 5, best)
        assert sorted(map(tuple, got.collect())) == want and (best == 7 or any(len(r[2].split()) == 5 for r in want))
    assert phrases.collocations(frame.where(F.lit(False))).count() == 0 == phrases.collocations(frame, least=10**6).count()


def test_tiles_count_exactly():
    rng = np.random.default_rng(6)
    x, y = (np.minimum(rng.geometric(0.2, 20_000), 300).astype(np.int64) for _ in range(2))
    codes = np.append(x << 32 | y, rng.integers(0, 2**31, 50) << 32 | 2**31 - 1)
    code, n = phrases.count_tiles(codes, bits=2)
    assert dict(zip(code.tolist(), n.tolist())) == Counter(codes.tolist()) and len(code) == len(set(code.tolist()))
    assert (phrases.unpack(phrases.pack(np.array([-1, 5, 2**31 - 1]))) == [-1, 5, 2**31 - 1]).all() and len(phrases.unpack(phrases.pack(np.zeros(0, int)))) == 0


def test_clashing_names_and_null_keys(spark):
    from tracewell.llm import near_duplicates, repeats, toxicity

    text = " ".join(some(np.random.default_rng(1), 80))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (None, "x y", "c")], "doc_id long, text string, kept_digest string")
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.kept_digest for r in kept.collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs.withColumnRenamed("kept_digest", "tag"), carry=("tag",))
    assert [r[0] for r in docs.where("doc_id IS NULL").select(F.coalesce(~toxicity.learnable(), F.lit(False))).collect()] == [False]
