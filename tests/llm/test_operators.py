"""The corpus operators on small tables with the awkward cases: nulls, empty and long texts, ties, clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import fingerprints, mixing, near_duplicates, neighbours, packing, pages, repeats, toxicity, transcripts
from tracewell.llm.token_store import PerfectHash, TokenStore
from tracewell.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, size int"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t la me ri so".split()]


def words(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    passage = words(rng, 60)
    for i in range(60):
        text = words(rng, int(rng.integers(1, 300)))
        if i % 6 == 0:
            text = f"{text}\n{passage}\n\n{words(rng, 20)}"
        out.append([i, text])
    out[20][1] = out[3][1]  # exact copies
    near = out[5][1] = words(rng, 200)
    out[41][1] = near.replace(near.split()[50], "zzz", 1)
    out[7][1], out[8][1], out[9][1], out[10][1] = None, "", "one", "é ü\n\n\nß\x01 tail " * 3
    out[11][1] = words(rng, 9000)  # very long
    return [(k, t, "en", None if k % 5 == 0 else "s0" if k % 3 else f"s{k % 7}", len(t or ""), "g", 1) for k, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(spark, docs, rows, nothing):
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    order = sorted(got, reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for k, nxt in zip(order, order[1:] + order[:1]):
        assert got[k].text == text[k] and got[k].next_text == text[nxt]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert all((prints[a] == prints[b]) == (text[a] == text[b]) for a in text for b in text)
    assert fingerprints.with_next(nothing).count() == 0
    two = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX")], "x string, y string")
    two = two.select(fingerprints.tree(F.col("x")).alias("tree_a"), fingerprints.tree(F.col("y")).alias("tree_b"))
    assert [tuple(e) for e in fingerprints.locate_edits(two).first().edits] == [(1, 1)]
    for text in ("", "a b c", "one two three four\n\nfive \x01six\n seven  eight\n\n\n", "\n", " "):
        row = spark.createDataFrame([(text,)], "t string").select(fingerprints.tree(F.col("t")).alias("tree"), fingerprints.root(fingerprints.tree(F.col("t"))).alias("root")).first()
        sha = lambda nodes: hashlib.sha256("".join(nodes).encode()).hexdigest()
        assert [[sha(p.phrases) for p in s.paragraphs] for s in row.tree.sections] == [[p.node for p in s.paragraphs] for s in row.tree.sections]
        assert [sha(p.node for p in s.paragraphs) for s in row.tree.sections] == [s.node for s in row.tree.sections] and row.root == sha(s.node for s in row.tree.sections)
    loose = spark.createDataFrame([(None, "a"), (None, "b"), (4, "c"), (4, "c")], "doc_id long, text string")
    assert sorted(r.next_text for r in fingerprints.with_next(loose).collect()) == ["a", "b", "c", "c"]


def test_mixing(docs, rows, nothing):
    got = mixing.mix_sources(docs).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert len(got) == len(rows) and all(r.size == size[r.doc_id] and r.taken <= 3 * r.size for r in got)
    total = sum(size.values())
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in targets.values())
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.repeat_documents(docs).groupBy().agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)


def test_near_duplicates(docs, rows, nothing):
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    sets = {}
    for k, text, *_ in rows:
        w = (text or "").lower().split()
        sets[k] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                shared = len(sets[a].keys() & sets[b].keys())
                if sets[a] == sets[b] or shared >= 0.8 * len(sets[a].keys() | sets[b].keys()) > 0:
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in sets}
    assert got[20] == 3 and got[41] == 5 and got[8] == 7
    kept = {r.doc_id for r in near_duplicates.keep_one(docs).collect()}
    assert kept == set(got.values())
    assert near_duplicates.near_duplicates(nothing).count() == 0 and near_duplicates.keep_one(nothing).count() == 0


def test_a_large_group_of_edited_copies(spark):
    """Most pairs are a little below the threshold, so buckets span several classes and the prefix join decides."""
    rng = np.random.default_rng(12)
    base, data = words(rng, 150).split(), []
    for i in range(90):
        w = list(base)
        for at in rng.integers(0, 150, 1 + i % 6):
            w[at] = f"x{rng.integers(1 << 40)}"
        data.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for _, t in data]
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(90):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(90)}


def test_rounds_read_only_what_they_compare(spark, monkeypatch):
    """Shingles whose holders were all taken aren't read again, and shapes are a byte a cell that bounds what sets share."""
    rng = np.random.default_rng(12)
    base, data = words(rng, 150).split(), []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 150, 1 + i % 6):
            w[at] = f"x{rng.integers(1 << 40)}"
        data.append((i, " ".join(w)))
    live, materialize = [], near_duplicates.materialize

    def kept(df, name):
        out = materialize(df, name)
        if name == "live":
            live.append(out)
        return out

    monkeypatch.setattr(near_duplicates, "materialize", kept)
    near_duplicates.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).count()
    assert live and live[-1].count() > 0
    for nth, rows in enumerate(live):  # a round takes one holder of each shingle at least
        assert rows.groupBy("shingle").agg(F.max("nth").alias("last")).where(F.col("last") <= nth).count() == 0
    long = [" ".join(f"w{i}" for i in range(lo, lo + 40_000)) for lo in (0, 10_000)]
    docs = spark.createDataFrame([(bytes([k]), t) for k, t in enumerate([*long, "one two", ""])], "node binary, text string")
    a, b, c, d = near_duplicates.shingle_sets(docs.withColumn("words", near_duplicates.word_hashes(F.col("text"))), 5).orderBy("node").collect()
    assert dict(near_duplicates.shingle_sets(docs.withColumn("words", F.array().cast("array<long>")), 5).dtypes)["shape"] == "array<tinyint>"
    common_ = len(set(a["elements"]) & set(b["elements"]))
    assert a.unit > 1 and max(a["shape"]) <= 127 and common_ == 29_996
    assert common_ <= sum(min(p * a.unit, q * b.unit) for p, q in zip(a["shape"], b["shape"])) < 1.1 * 39_996
    assert (sum(c["shape"]), c.unit, sum(d["shape"]), d.unit) == (1, 1, 0, 1)


def test_near_duplicates_by_awkward_keys(spark):
    """Keys say nothing about texts: equal keys may have unlike ones, and null keys any."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (1, "another"), (2, text), (None, text), (None, "alone"), (None, "alone"), (7, None), (8, " "), (9, "")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, class string, first int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in near_duplicates.near_duplicates(df).collect())
    assert got == [(0, 0, 2), (0, 0, 2), (0, 1, 4), (1, 1, 1), (1, 1, 4), (1, 1, 4), (2, 1, 4), (7, 7, 2), (8, 8, 1), (9, 7, 2)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in near_duplicates.keep_one(df).collect())
    assert kept == [(0, "alone"), (1, "another"), (1, text), (7, ""), (8, " ")]


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(5)
    a = {int(x): int(w) for x, w in zip(rng.integers(1, 1 << 62, 120), rng.integers(1, 4, 120))}
    b = {x: w + (i % 3 == 0) for i, (x, w) in enumerate(a.items()) if i % 5}
    flat = [(o, x, w) for o, s in enumerate((a, b)) for x, w in sorted(s.items())]
    owner, element, weight = (np.array(v) for v in zip(*flat))
    sign = near_duplicates.signatures(owner, element.astype(np.uint64), weight, 2, 4096)
    pair = [(np.array(sorted(s)), np.array([s[x] for x in sorted(s)])) for s in (a, b)]
    assert abs((sign[0] == sign[1]).mean() - near_duplicates.probability_jaccard(*pair)) < 0.04


def cut_by_force(rows):
    """(doc_id, text) -> kept bytes, for every row."""
    last = (1 << 63) - 1
    first = {}
    for k, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - 49):
            w = raw[s : s + 50]
            first[w] = min(first.get(w, last), last if k is None else k)
    out = []
    for k, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < (last if k is None else k):
                gone[s : s + 50] = True
        out.append((-1 if k is None else k, len(raw), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out)


def cut_by_operator(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept)) for r in repeats.remove_repeats(df).collect())


def test_repeats(docs, rows, nothing):
    assert cut_by_operator(docs) == cut_by_force([r[:2] for r in rows])
    assert repeats.remove_repeats(nothing).count() == 0


A, B, C = (f"{c} is a text of more than fifty bytes that repeats only where a test says that it does, {c * 9}." for c in "abc")


@pytest.mark.parametrize(
    "rows",
    [
        [(3, A), (5, A)],  # a part of copies alone
        [(3, A), (5, A), (5, B)],  # equal keys, unlike texts
        [(3, A), (None, A), (None, B), (None, C), (None, C)],  # null keys
        [(3, A), (3, A), (3, A + B), (7, B)],  # repeated rows
        [(None, A + B), (None, B + A), (None, None), (4, ""), (5, None)],
        [(1, A + B), (2, C + A), (3, B + C + A), (4, A), (5, B), (6, A[:49]), (7, A[1:51] + "é")],
        [(9, A * 3), (2, A + A[:60]), (4, A)],  # a text that repeats itself
        [(k, f"{k} {A} {k * k} {B}" if k % 3 else f"{A} {k} {C}") for k in range(60)],  # passages that many share
    ],
)
def test_repeats_by_awkward_keys(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "g", b"x") for k, t in rows], "doc_id long, text string, part int, `group` string, body binary")
    assert cut_by_operator(df) == cut_by_force(rows)


def test_repeats_within_a_group(spark):
    rows = [(1, "h", f"one {A}"), (2, "h", f"two {A}"), (3, "g", f"three {A}"), (4, "g", "0123456789 " * 12), (5, "h", C), (6, "h", C), (7, None, A)]
    df = spark.createDataFrame(rows, "page_id long, host string, stream string")
    got = {r.page_id: bytes(r.kept).decode() for r in repeats.shared_spans(df, "page_id", "stream", "host").collect()}
    assert got == {1: "one", 2: "two", 3: f"three {A}", 4: "0123456789 " * 12, 5: "", 6: "", 7: A}


@pytest.mark.parametrize("most", [250_000, 50])
def test_windows_by_force(monkeypatch, most):
    """Contexts of one and of several anchors, also where one anchor's windows are too many for one sort."""
    monkeypatch.setattr(repeats, "SORT_WINDOWS", most)
    rng = np.random.default_rng(9)
    contexts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(50, 84, 40)] + [b"a" * 60, b"a" * 70, b"a" * 60]
    contexts += contexts[3:9]
    keys, anchor = np.arange(len(contexts))[::-1].copy(), np.array([len(c) % 3 for c in contexts], np.uint64)
    holders = {}
    for k, a, c in zip(keys.tolist(), anchor.tolist(), contexts):
        for s in range(len(c) - 49):
            holders.setdefault((a, c[s : s + 50]), []).append(k)
    for both in (True, False):
        if not both:  # one anchor: equal windows always have equal ones
            anchor, holders = anchor * 0, {(0, w): [k for a in range(3) for k in holders.get((a, w), [])] for _, w in holders}
        want = set()
        for i, (k, a, c) in enumerate(zip(keys.tolist(), anchor.tolist(), contexts)):
            want |= {(i, s) for s in range(len(c) - 49) if min(x := holders[a, c[s : s + 50]]) < k or both and max(x) > k}
        count = np.array([len(c) - 49 for c in contexts])
        found = repeats.taken_spans(np.frombuffer(b"".join(contexts), np.uint8), count, anchor, keys, keys, both)
        assert {(i, s) for i, lo, n in zip(*(x.tolist() for x in found)) for s in range(lo, lo + n)} == want


def test_packing(docs, rows, nothing):
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(docs, path).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for k, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == k].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and (s.offset == s.length.cumsum() - s.length).all()
    assert packing.pack(nothing, path).count() == 0


def test_packing_leaves_no_table_in_a_waiting_worker(spark, monkeypatch):
    tasks = []
    monkeypatch.setattr(packing, "releasing", lambda run: tasks.append(run) or run)
    monkeypatch.setattr(packing, "SLICE_BYTES", 100)
    path = vocabulary("word_bpe_49k.json")
    rows = [(k, None if k == 3 else f"word{k} и слово{k} " * 10) for k in range(7)]
    packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), path)
    task = tasks[0](iter([pa.table({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]}).to_batches()[0]]))
    first = next(task)
    held = encoder(path)
    assert first.num_rows == 1 and held.chunks  # a slice of a batch at a time
    assert [*first["doc_id"].to_pylist(), *(k for b in task for k in b["doc_id"].to_pylist())] == list(range(7))
    assert not held.pieces and not held.chunks


def test_best_fit_over_counts_is_best_fit_over_pieces():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = Counter(rng.integers(1, 60, rng.integers(1, 80)).tolist())
        rooms = []
        for n in sorted(counts.elements(), reverse=True):
            fitting = [r for r in rooms if r >= n]
            room = min(fitting) if fitting else 64
            if fitting:
                rooms.remove(room)
            rooms.append(room - n)
        plan = packing.plan_best_fit(dict(counts), 64)
        used = {first + i for _, _, n, first, per, _ in plan for i in range(-(-n // per))}
        assert len(used) == len(rooms) and sum(p[2] for p in plan) == sum(counts.values())


def test_token_store(spark, docs, rows, nothing, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    loose = docs.unionByName(spark.createDataFrame([(None, "null key", None, None, 1, None, None), (3, "again", None, None, 1, None, None)], SCHEMA))
    store = TokenStore.write(loose, path)
    got = sorted(store.read().collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    every = sorted([(r[0], r[1]) for r in rows] + [(None, "null key"), (3, "again")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (k, text), r in zip(every, got, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    asked = spark.createDataFrame([(5,), (999,), (None,)], "doc_id long")
    found = store.get(asked).collect()
    assert [r.doc_id for r in found] == [5] and found[0].ids[:-1] == library.encode(rows[5][1], add_special_tokens=False).ids
    assert TokenStore.write(nothing, path).read().count() == 0
    monkeypatch.setattr("tracewell.llm.token_store.MANY", 0)  # by way of the whole index
    assert [list(r) for r in store.get(asked).collect()] == [list(r) for r in found]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    table = PerfectHash.build(np.unique(keys))
    assert sorted(table.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_the_whole(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    texts = ["", " ", "a  b\n\n c", "don't DON'T 12345 ½ x²", "naïve “quotes” — œuvre İ ΑΣ", "tab\t\x1c odd", "a\xa0b\x85c", "<|endoftext|> x", "a <|ENDOFTEXT|>b<|startoftext|>", "日本語 テスト <|endoftext|>", "日本語 テスト", "'street's ''s don'T I'll", "x \n y  \t\n", "\xa0lead\xadsoft", "ÀÉ ß ÿ µ", "é ́x", "   lead", "trail   "]
    for text, ids in zip(texts, encoder(vocabulary(name)).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(4)
    data, labels = [], []
    for i in range(400):
        text, toxic = words(rng, 60), int(i % 4 == 0)
        if toxic:
            w = text.split()
            w.insert(30, ["grumbol", "grumbat", "fizzard"][i % 3])
            text = " ".join(w)
        data.append((i, text, "x"))
        labels.append((i, 1, toxic))
    data += [(900, None, "x"), (901, "", "x")]
    docs, lab = spark.createDataFrame(data, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i].score >= 0.7) == y for i, y in held]) > 0.95
    span = got[0].toxic_tokens[0]
    assert data[0][1][span.offset : span.offset + span.length].startswith(("grum", "fizz"))
    assert got[900].score == got[901].score < 0.5
    again = docs.unionByName(docs.limit(50)).unionByName(docs.limit(50))  # repeated keys neither multiply nor crash
    twice = {r.doc_id: r.score for r in toxicity.score(again, toxicity.fit(again, lab.unionByName(lab.limit(20)))).collect()}
    assert np.mean([(twice[i] >= 0.7) == y for i, y in held]) > 0.95
    assert toxicity.fit(nothing, lab.limit(0)) is None and toxicity.score(nothing.select("doc_id", "text"), toxicity.fit(docs, lab)).count() == 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = np.random.default_rng(14)
    say = lambda n: [f"{a}{b}{c}" for a, b, c in zip(rng.choice(list("bcdfg"), n), rng.choice(["ola", "emi", "uta"], n), rng.choice(["ren", "sto", "vil"], n))]
    data, labels = [], []
    for i in range(150):
        w = say(1600)
        if i % 3 == 0:
            w[1500:1500] = ["grumbol", "fizzard"]
        data.append((i, ". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9))))
        labels.append((i, 1, int(i % 3 == 0)))
    assert min(t.find("grumbol") for _, t in data if "grumbol" in t) > 10_000
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, field).collect()}
    assert all((got[i] >= 0.7) == toxic for i, _, toxic in labels)


def test_forward_backward_sums_over_all_taggings():
    rng = np.random.default_rng(6)
    d, move = rng.normal(size=5), rng.normal(size=(2, 2))
    fore, back, _ = toxicity.ratios(d, np.array([0]), np.array([5]), move)
    odds = fore * back
    weight = np.zeros((5, 2))
    for code in range(32):
        tags = [code >> i & 1 for i in range(5)]
        w = np.exp(sum(d[i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
        for i, t in enumerate(tags):
            weight[i, t] += w
    assert np.allclose(odds / (1 + odds), weight[:, 1] / weight.sum(1))


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[7]  # many copies
    data = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    data += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, 2.0], 0), (1080, [None] * 16, 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = neighbours.search(table, F.col("key") % 20 == 0).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, s[own.vec_id])
        hit += len(set(want) & set(own.vec_id))
    assert set(got.query_id) == set(range(0, 600, 20)) and hit / 600 >= 0.9
    assert neighbours.search(table.limit(0), F.col("key") % 20 == 0).count() == 0


def test_neighbours_of_awkward_rows(spark):
    data = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (None, [9.0, 9.0], 1), (20, [0.5, 0.5], 1), (20, [0.5, 0.5], 1), (7, [-1.0, 0.0], 1), (8, [0.0, -0.0], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, entry int").withColumn("list", F.lit(1))
    for part in (table, table.repartition(3), table.orderBy(F.desc("vec_id"))):
        got = sorted(tuple(r) for r in neighbours.search(part, F.col("key") % 20 == 0).collect())
        assert got == [(0, 1, 20, 0.5), (0, 2, 7, 0.0), (20, 1, 0, 0.5), (20, 2, 7, -0.5)]  # of key 0 the least vector counts


@pytest.mark.parametrize("spread, most", [(0.15, 0.1), (10.0, 0.75)])
def test_recall_and_reads_follow_the_data(spread, most):
    """Clustered vectors are found in a few lists; vectors without structure ask for many, and recall is kept."""
    rng = np.random.default_rng(21)
    x = np.repeat(rng.normal(size=(400, 32)), 25, 0) + spread * rng.normal(size=(10_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index.fit(x[:8000], 1.0, len(x) // 50)
    lists, keep = index.lists_of(x)
    held = [set() for _ in range(len(index.centroids))]
    for i, c in zip(*np.nonzero(keep)):
        held[lists[i, c]].add(i)
    hits = reads = 0
    asked = range(0, 10_000, 100)
    rows, probed = index.probes(neighbours.flat(x[asked], 1.0))
    for n, q in enumerate(asked):
        score = x @ x[q]
        score[q] = -np.inf
        read = set().union(*(held[c] for c in probed[rows == n]))
        hits += len(set(np.argsort(-score)[:20].tolist()) & read)
        reads += sum(len(held[c]) for c in probed[rows == n])
    assert hits / (20 * len(asked)) >= 0.9 and reads / len(asked) <= most * sum(map(len, held)), (hits, reads)


@pytest.mark.parametrize("kind", ["queries of their own", "norms", "opposite"])
def test_recall_of_queries_unlike_the_rows(spark, kind):
    """The queries, one row of twenty, decide how much is read, and no sample of the rows speaks for them."""
    rng = np.random.default_rng(33)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(0, 100, 4000)] + 0.15 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, 4000, 20)
    if kind == "norms":
        x = rng.normal(size=x.shape) * np.exp(rng.normal(size=(4000, 1)))
    else:
        x[q] = rng.normal(size=(len(q), 32)) if kind == "queries of their own" else -x[q]
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("key") % 20 == 0).toPandas()
    hit = 0
    for a, own in got.groupby("query_id"):
        s = x @ x[a]
        s[a] = -np.inf
        hit += len(set(np.lexsort((np.arange(4000), -s))[:20]) & set(own.vec_id))
    assert hit / (20 * len(q)) >= 0.93


def test_pages(spark):
    shared = "All rights reserved by the owners of this site, whatever they may be called this year."
    html = [
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav>menu</nav><article><h1>Head &amp; more</h1><p><b>Bold.<br><p>Next&nbsp;line</p></article><footer>f</footer></body>",
        f"<body><div class='sidebar'>side</div><div><p>Own text of page one is here.</p><p>{shared}</p></div><div id='comments'><p>hi</p></div></body>",
        f"<body><div><p>{shared}</p><p>Something else stands on page two.</p></div><p",
        None,
        "",
    ]
    table = spark.createDataFrame([(i, "http://h.example/p", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(table).collect()}
    assert got == {0: "Head & more\n\nBold.\n\nNext line", 1: "Own text of page one is here.", 2: "Something else stands on page two.", 3: "", 4: ""}
    assert pages.extract(table.limit(0)).count() == 0


def test_every_page_goes_through_the_suffix_sort(spark):
    """Articles that markup marks are sorted too: their repeats within the host are told, and stay."""
    rng = np.random.default_rng(3)
    shared, own = words(rng, 20), [words(rng, 30) for _ in range(4)]
    html = [f"<nav>menu</nav><article><p>{own[0]}</p><p>{shared}</p></article>", f"<article><p>{shared}</p><p>{own[1]}</p></article>", f"<article><p>{own[2]}</p></article>", f"<article><p>{shared}</p></article>", f"<div><p>{shared}</p><p>{own[3]}</p></div>"]
    table = spark.createDataFrame([(i, f"http://{'b' if i == 3 else 'a'}.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_repeated) for r in pages.extract(table).collect()}
    n = len(shared.encode())
    assert got[2] == (own[2], 0) and got[3] == (shared, 0)  # nothing of the host repeats it
    assert got[0][0] == f"{own[0]}\n\n{shared}" and got[1][0] == f"{shared}\n\n{own[1]}"
    assert n <= got[0][1] <= n + 2 and n <= got[1][1] <= n + 2
    assert got[4] == (f"{shared}\n\n{own[3]}", 0)  # an article elsewhere is no boilerplate here


def test_what_markup_leaves_open(spark):
    line = "Follow us wherever you are and tell your friends about everything that you have read here today."
    html = [
        "<body><article class='story related'><p>All of it.</p><math><mi>x</mi> = 2</math><svg><text>label</text></svg></article></body>",
        "<body><main><article><p>One.</p></article><p>Between.</p><article><p>Two.</p></article></main><div class='user-feedback'><p>me too</p></div></body>",
        f"<body><article><p>Own.</p><p class='share'>Her share of the estate was small, and she said so.</p><p class='share'>{line}</p></article></body>",
        f"<body><article><p>Other.</p><p class='share'>{line}</p><div class='comments'><p>first!</p></div></article></body>",
        "<body><article><p>" + "long " * 20000 + "</p></article></body>",
        None,
    ]
    rows = [(i, "http://h.example/p" if i else None, h, "x", "y") for i, h in enumerate(html)] + [(2, "http://h.example/p", html[2], "x", "y"), (None, None, html[1], "x", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, stream string")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.text) for r in pages.extract(table).collect())
    twice = (2, "Own.\n\nHer share of the estate was small, and she said so.")
    assert got == [
        (-1, "One.\n\nBetween.\n\nTwo."), (0, "All of it.\n\nx = 2label"), (1, "One.\n\nBetween.\n\nTwo."), twice, twice, (3, "Other."),
        (4, ("long " * 20000).strip()), (5, ""),
    ]


def test_unique_runs_by_force(spark):
    """Pages without a main zone keep what no other page of the host has."""
    rng = np.random.default_rng(13)
    common = [words(rng, 14) for _ in range(3)]
    own = [[words(rng, 12), *(common[j] for j in range(3) if (i + j) % 3)] for i in range(9)]
    host = [i % 2 for i in range(9)]
    table = spark.createDataFrame([(i, f"http://h{host[i]}.example/", "".join(f"<p>{t}</p>" for t in b)) for i, b in enumerate(own)], "page_id long, url string, html string")
    held = {}
    for i, b in enumerate(own):
        raw = ("\n".join(b) + "\n").encode()
        for s in range(len(raw) - 49):
            held.setdefault((host[i], raw[s : s + 50]), set()).add(i)
    for r in pages.extract(table).collect():
        raw = ("\n".join(own[r.page_id]) + "\n").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if len(held[host[r.page_id], raw[s : s + 50]]) > 1:
                gone[s : s + 50] = True
        at, want = 0, []
        for t in own[r.page_id]:
            n = len(t.encode())
            runs = "".join(" " if g else chr(c) for c, g in zip(raw[at : at + n], gone[at : at + n]))
            want += [" ".join(runs.split())] if runs.strip() else []
            at += n + 1
        assert r.text == "\n\n".join(want)


def test_transcripts(spark):
    data = []
    for c in range(60):
        for t in range(6):
            data.append((c, t, "user" if t % 2 == 0 else "assistant", "why is that?" if t % 2 == 0 else "Because of this and that and more of the same. " * 6))
    raw = transcripts.raw_transcripts(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    got = transcripts.render(transcripts.recover(raw, raw)).collect()
    found = {(int(r.conv), r.pos): r.role for r in got}
    assert np.mean([found.get((c, t)) == r for c, t, r, _ in data]) > 0.95
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") for r in got)


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(7)
    n = len(transcripts.STATES)
    model = {"emit": rng.normal(size=(n, transcripts.SEEN)), "move": rng.normal(size=(n, n)), "start": rng.normal(size=n)}
    seen = rng.integers(0, transcripts.SEEN, 5)

    def score(path, before):
        total = model["start"][path[0]] if before is None else model["move"][before, path[0]]
        return total + sum(model["emit"][s, o] for s, o in zip(path, seen)) + sum(model["move"][a, b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product(range(n), repeat=5))
    for before, last in ((None, None), (2, None), (None, 3), (1, 4)):
        best = max((p for p in paths if last is None or p[-1] == last), key=lambda p: score(p, before))
        assert tuple(transcripts.viterbi(seen, model, before, last)) == best
    ends = transcripts.between(seen, model)
    assert np.allclose(ends, [[max(score(p, b) for p in paths if p[-1] == e) for e in range(n)] for b in range(n)])
    assert np.allclose(transcripts.onward(seen, model), [max(score(p, None) for p in paths if p[-1] == e) for e in range(n)])


def test_pieces_of_a_long_transcript_decode_as_the_whole(spark, monkeypatch):
    data = [(1, t, ["user", "assistant"][t % 2], "short?" if t % 2 == 0 else "a longer answer " * 9 + "\nand more" * (t % 7)) for t in range(40)]
    data.append((2, 0, "user", "\n".join(f"line {i}" for i in range(50))))  # one text, longer than a piece
    raw = transcripts.raw_transcripts(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    model = transcripts.fit(transcripts.lines_of(raw, "conv_id", "turn", "raw", "role").withColumn("first", F.col("sub") == 0))
    got = []
    for piece in (2048, 8):
        monkeypatch.setattr(transcripts, "PIECE", piece)
        decoded = transcripts.decode(transcripts.lines_of(raw, "conv_id", "turn", "raw"), model)
        got.append(sorted((r.conv, r.turn, r.pos, r.role, r.text) for r in transcripts.turns(decoded).collect()))
        if piece == 8:
            assert decoded.groupBy("conv", "piece").count().agg(F.max("count")).first()[0] <= 8
    assert got[0] == got[1]


def test_transcripts_with_awkward_rows(spark):
    rows = [(1, 0, "user", "User: hi"), (1, 1, "assistant", None), (1, 1, None, ""), (1, None, "user", "User: first"), (2, 0, "user", "User: hi"), (2, 0, "user", "User: hi")]
    rows += [(None, 0, "user", "User: alone"), (None, 0, "assistant", "Assistant: alone too"), (None, 5, "user", None), (4, 0, "assistant", "word " * 9000)]
    table = spark.createDataFrame([(*r, "c", 1, "l") for r in rows], "conv_id long, turn long, role string, raw string, conv string, state int, line string")
    got = transcripts.recover(table, table).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.conv, r.turn)):
        found.setdefault(r.conv, []).append(r.text)
    alone = {c: t for c, t in found.items() if c not in ("1", "2", "4")}
    assert found["1"][:2] == ["first", "hi"] and found["2"] == ["hi", "hi"] and found["4"] == [("word " * 9000).strip()]
    assert sorted(alone.values()) == [[""], ["alone"], ["alone too"]]
    assert transcripts.recover(table.limit(0), table).count() == 0
    assert transcripts.recover(table, table.limit(0)).count() > 0  # without labels: no role is likelier


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).drop("group", "size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    kept = {r.doc_id for r in seen["minhash_near_dedup"].collect()}
    assert 20 not in kept and 41 not in kept and {3, 5} <= kept
    assert seen["suffix_array_dedup"].count() == len(kept)
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= kept
    assert hashlib.sha256(b"").hexdigest()  # texts that lose nothing stay as they are
    same = seen["suffix_array_dedup"].where("doc_id = 5").first().text
    assert same == dict((r[0], r[1]) for r in rows)[5]


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Null keys and texts, copies of them, repeated keys, clashing names; no stage drops what it has no reason to drop."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, "en", "a", 5), (None, text, "en", None, 5), (None, None, None, None, None), (4, None, "en", "a", 0), (4, "short", "en", "a", 5), (5, text + " more of it", "en", "b", 9), (5, "other words here", None, "b", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, size int")
    spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name in ("toxicity", "minhash_near_dedup", "suffix_array_dedup", "mix_sources"):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = sorted(((r.doc_id or 0, r.text) for r in docs.collect()), key=str)
    assert len(seen["toxicity"]) == 7  # one labelled class alone: nothing is toxic
    assert [k for k, t in seen["minhash_near_dedup"]] == sorted([4, 4, 5, 5], key=str)  # of the near copies the one with a key
    assert {(4, None), (4, "short"), (5, "other words here"), (5, text + " more of it")} == set(seen["suffix_array_dedup"])
    packed = stages["best_fit_packing"](spark, docs, str(tmp_path))
    assert packed.count() == docs.count() and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), str(tmp_path)).write.parquet(f"{tmp_path}/none-{name}")
        assert spark.read.parquet(f"{tmp_path}/none-{name}").count() == 0
