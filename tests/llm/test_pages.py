"""The reader of pages: markup that wrappers, inline furniture and bad nesting make hard, and random trees by force."""

import random
import time

import numpy as np
import pytest

from tracewell.llm import pages, repeats
from tracewell.llm.pages import blocks


def main_text(page):
    return "\n\n".join(t for z, t in blocks(page) if z == "main")


def page(inside):
    return f"<html><body><nav>N</nav>{inside}<footer>F</footer></body></html>"


PROBES = [
    ('<div class="layout with-sidebar"><article><p>T</p></article></div>', "T"),
    ('<div class="site menu-closed"><main><p>T</p></main></div>', "T"),
    ('<div class="sidebar"><article>T</article></div>', "T"),
    ('<article><div class="ad-free"><p>T</p></div></article>', "T"),
    ("<article><p>Click <button>OK</button> now</p></article>", "Click now"),
    ('<article><p>Click <span class="ad">BUY</span> now</p></article>', "Click now"),
    ("<article>a <select><option>x</option><option>y</option></select> b</article>", "a b"),
    ('<article><p style="display: none">H</p><p>T</p></article>', "T"),
    ('<article><p>T</p><div id="responses"><p>R</p></div></article>', "T"),
    ('<article><p>T</p></article><section class="more-stories"><article>X</article></section>', "T"),
    ('<article><p>T</p><div class="comment-list"><p>R</p></div><div class="site-footer">Y</div></article>', "T"),
    ("<aside><article>X</article></aside><article>T</article>", "T"),
    ("<article>one<button>x<div>y</div></button> two<p>three</p></article>", "one two\n\nthree"),
    ("<article><p>a<p>b<i>c</article>", "a\n\nbc"),
    ("<article></i></div>T</b></article>", "T"),
]


@pytest.mark.parametrize("inside, want", PROBES)
def test_probes(inside, want):
    assert main_text(page(inside)) == want


def test_share_links_stay_apart_from_the_text():
    assert [b for b in blocks(page('<article><p><a class="share">Share</a> Real text</p></article>')) if b[0] != "out"] == [("doubt", "Share"), ("main", "Real text")]


KINDS = [("p", "", True, False), ("div", "", True, False), ("section", ' class="lead"', True, False), ("b", "", False, False), ("span", ' class="x-wide"', False, False), ("aside", "", True, True), ("form", "", True, True), ("button", "", False, True), ("div", ' class="ad"', True, True), ("span", " hidden", False, True)]


def grow(rng, depth, inline):
    """A random tree of (markup, children) under an article; inline elements hold no blocks."""
    kinds = [k for k in KINDS if not inline or not k[2]]
    return [str(rng.randrange(100)) + rng.choice(["", " "]) if depth == 0 or rng.random() < 0.5 else (k := rng.choice(kinds), grow(rng, depth - 1, inline or not k[2] or k[0] == "p")) for _ in range(rng.randrange(1, 4))]


def write(tree):
    return "".join(t if isinstance(t, str) else f"<{t[0][0]}{t[0][1]}>{write(t[1])}</{t[0][0]}>" for t in tree)


def read(tree, out, parts):
    """The text of blocks: a block element ends the one before it on both sides; what is out leaves no text."""
    for t in tree:
        if isinstance(t, str):
            if not out:
                parts[-1].append(t)
        else:
            (_, _, block, gone), inside = t
            if block and not out:
                parts.append([])
            read(inside, out or gone, parts)
            if block and not out:
                parts.append([])
    return parts


def test_random_trees():
    rng = random.Random(5)
    for _ in range(3000):
        tree = grow(rng, 4, False)
        want = [" ".join("".join(p).split()) for p in read(tree, False, [[]])]
        assert main_text(page(f"<article>{write(tree)}</article>")) == "\n\n".join(w for w in want if w), write(tree)


@pytest.mark.parametrize("markup", ["<div>{n}</i>", "<i>{m}<div><b>{n}</i>", "<p>{n}</div>", "<span class='ad'>{n}</b>"])
def test_badly_nested_pages_take_linear_time(markup):
    head, tail = markup.split("{n}")
    first, _, head = head.rpartition("{m}")
    began = time.process_time()
    blocks(first + head * (500_000 // len(head)) + tail * (500_000 // len(tail)))
    assert time.process_time() - began < 10


def test_parts_hold_packed_text():
    """What parts exchange is small, and comes back as it was."""
    rng = np.random.default_rng(9)
    own = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    several = rng.random(len(own)) < 0.1
    packed = repeats.pack_hashes(own, several)
    got, bits = repeats.unpack_hashes(packed)
    assert len(packed) < 4 * len(own) and (got == (own >> np.uint64(32)).astype(np.uint32)).all() and (bits == several).all()
    for n in (0, 1, 2):
        got, bits = repeats.unpack_hashes(repeats.pack_hashes(own[:n], several[:n]))
        assert (len(got), len(bits)) == (n, n)
    for text in (b"", b"a", "é".encode() * 999):
        assert repeats.unpack(repeats.pack(text)) == text
    for kind in ("<i4", "<i8", "u1", "<u8"):
        x = rng.integers(0, 100, 7).astype(kind)
        assert (repeats.of_planes(b"x" + repeats.planes(x), kind, 7, 1) == x).all()


def test_pages_are_read_once(spark, monkeypatch):
    """No table of parsed pages is written, and the sort's three uses of the parts read one exchange."""
    written, materialize = [], repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(pages, "materialize", lambda df, name: written.append(name) or materialize(df, name), raising=False)
    rows = [(i, f"http://h{i % 2}/{i}", f"<nav>menu of the whole site, with so many words that it counts as one</nav><article>text {i} of its own</article>") for i in range(20)]
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == {i: f"text {i} of its own" for i in range(20)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert written == [] and final.count("MapInArrow") == 1 and final.count("ReusedExchange") >= 2
