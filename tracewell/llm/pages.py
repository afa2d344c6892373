"""Main text of web pages: a host-wide suffix sort of all pages, and markup zones that say what its repeats are.

A page is cut into blocks. Each block has a zone: out (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, by element, role, style or whole class names), main (inside an article or main element, or else one named as such), doubt (inside
main, under a class such as "share" that names furniture or just the subject), or open. An article or main element under an
ancestor that only its names put out is the article, unless the page has one elsewhere: then it is a teaser. An inline
element that goes out interrupts its block without ending it. A header outside the article is furniture with its heading. Article text repeats across pages
for good reasons (copies, quotations, licence lines), and menus and adverts may differ on every page, so what markup says
for certain stands.

Every page goes through the suffix array: per host, the token streams of all pages are concatenated and suffix-sorted (see
`repeats`), and strings of at least `LENGTH` bytes that occur in distinct pages are repeats. A page has two streams, its main
blocks and all others, which are sorted apart: what is an article on one page is no boilerplate of another. Then the zones
say what repeats are: in a main block they are copies and stay, beside its unique runs (`n_repeated` tells how much they
are); in the others they are boilerplate. A block in doubt goes if most of it is covered; a page without a main zone keeps
its open blocks where they are not covered: unique runs.

Defined cases: a null page counts as empty; an empty text results where nothing is left; a null url is a host of its own;
repeated rows are extracted each, and count as one page; null page_ids count as one page; malformed markup is read to its
end (an unfinished tag is dropped); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import repeats
from tracewell.llm.common import bounded_batches, releasing
from tracewell.session import table

LENGTH = 50
# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
OUT = frozenset("nav footer aside form button dialog menu head select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adbox sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert sidebar "
    "aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist reply replies "
    "respond responses disqus feedback discussion guestbook share sharing social related recommended morestories teaser teasers newsletter subscribe subscription popup modal widget "
    "widgets pagination pager toolbar".split()
)
#: Those that may as well name what an article is about, when they stand inside it.
DOUBTFUL = frozenset("share sharing social related recommended promo banner notice notices alert header masthead toolbar widget widgets discussion feedback".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond responses disqus guestbook".split())
#: Words that a compound name of furniture may hold beside a name of OUT_NAMES ("site-footer", "comment-list"); a compound
#: with any other word ("with-sidebar", "menu-closed", "ad-free") says something else.
STRUCTURE = frozenset(
    "site page global top bottom left right upper lower main primary secondary fixed sticky mobile desktop list box bar area section wrap wrapper "
    "container block item items inner outer group panel slot unit zone text message link links icon icons button buttons form thread col column "
    "row header head body content more stories posts articles news us you it on this the and also 1 2 3 4".split()
)
MAIN_NAMES = frozenset("article articlebody entry post story maincontent content".split())
CLOSES_P = BLOCK - {"body", "html", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/A-Za-z][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN, DOUBT, OPEN, NONE = "main", "doubt", "open", "out"


def furniture(token: str, names: frozenset[str]) -> str | None:
    """The name of furniture that a whole class or id token is, or is a compound of; None if it says something else."""
    whole = token.lower().replace("-", "").replace("_", "")
    if whole in names:
        return whole
    parts = [p.lower() for p in _PART.findall(token)]
    held = [p for p in parts if p in names]
    return held[-1] if held and all(p in names or p in STRUCTURE for p in parts) else None


def zone_of(name: str, attributes: str, in_main: bool) -> tuple[str, bool, int]:
    """(NONE, DOUBT or nothing; whether only its names say so; level of main zone) of an element.

    Level: 3 for article, 2 for main, 1 for a name such as content.
    """
    if name in OUT or (name == "header" and not in_main):
        return NONE, False, 0
    level = {"article": 3, "main": 2}.get(name, 0)
    if not attributes.strip():
        return "", False, level
    given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or _INVISIBLE.search(given.get("style", "")):
        return NONE, False, 0
    role = given.get("role", "").lower()
    if role in OUT_ROLES:
        return NONE, False, 0
    tokens = [t for k in ("class", "id", "itemprop") for t in given.get(k, "").split()]
    if name not in ("body", "html", "main"):
        found = {f for t in tokens if (f := furniture(t, COMMENTS if level else OUT_NAMES))}
        if "more" in " ".join(tokens).lower() and any(re.fullmatch(r"more[-_]?(stories|posts|articles|news)", t.lower()) for t in tokens):
            found.add("related")
        if found:
            certain = not in_main or found - DOUBTFUL
            return NONE if certain else DOUBT, True, 0
    if role in ("main", "article"):
        level = max(level, 2)
    if {p.lower() for t in tokens for p in _PART.findall(t)} & MAIN_NAMES and name not in ("body", "html", "p", "span", "a", "li"):
        level = max(level, 1)
    return "", False, level


#: A main or article element under an ancestor that only its names put out: the article itself, or a teaser where the page has another.
TEASER = "teaser"


class _Reader:
    """Reads a page once: open elements, the block that is being read, and the blocks found."""

    def __init__(self):
        self.found: list[tuple[str, int, str]] = []  # zone, level, text
        self.names: list[str] = []  # open elements, and the zone and level inside each
        self.zones: list[tuple[str, bool, int]] = []
        self.places: dict[str, list[int]] = {}  # where elements of a name stand among them
        self.open_blocks: list[int] = []
        self.aside: list[tuple[int, list[str], tuple[str, bool, int]]] = []  # blocks that wait for an inline element to end
        self.state = ("", False, 0)
        self.buffer: list[str] = []

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.buffer)).split())
        if text:
            self.found.append((self.state[0], self.state[2], text))
        self.buffer = []

    def enter(self, state: tuple[str, bool, int], block: bool) -> None:
        """What follows has another zone: a block ends here, unless an inline element that goes out just interrupts it."""
        if state == self.state:
            return
        if state[0] == NONE and not block and self.state[0] != NONE:
            self.aside.append((len(self.names), self.buffer, self.state))
            self.buffer = []
        else:
            self.flush()
        self.state = state

    def open(self, name: str, attributes: str) -> None:
        outer = self.zones[-1] if self.zones else ("", False, 0)
        zone, by_name, level = zone_of(name, attributes, outer[2] > 0)
        if outer[0] == NONE:
            # Names alone don't put out what an article or main element inside says for itself.
            inner = (TEASER, False, level) if outer[1] and level >= 2 and zone == "" else outer
        elif zone == NONE:
            inner = (NONE, by_name, outer[2])
        else:
            inner = (outer[0] or zone, False, max(outer[2], level))
        self.enter(inner, name in BLOCK)
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCK:
            self.open_blocks.append(len(self.names))
        self.names.append(name)
        self.zones.append(inner)

    def close_to(self, depth: int) -> None:
        """Close all open elements but the first `depth`."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.zones.pop()
            self.places[name].pop()
            if self.open_blocks and self.open_blocks[-1] == len(self.names):
                self.open_blocks.pop()
        back = None
        while self.aside and self.aside[-1][0] >= depth:
            back = self.aside.pop()
        state = self.zones[-1] if self.zones else ("", False, 0)
        if back is not None:
            self.flush()
            _, self.buffer, self.state = back
        if state != self.state:
            self.flush()
            self.state = state

    def close(self, name: str) -> None:
        at = self.places.get(name)
        if at and (name in BLOCK or not self.open_blocks or self.open_blocks[-1] < at[-1]):  # an inline element doesn't close blocks
            self.close_to(at[-1])

    def close_paragraph(self) -> None:
        if self.open_blocks and self.names[self.open_blocks[-1]] == "p":
            self.close_to(self.open_blocks[-1])


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order; every tag is handled in the same time, however elements are nested."""
    reader, at = _Reader(), 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside a raw element
        reader.buffer.append(page[at : m.start()])
        at = m.end()
        closing, name = m.group(1), (m.group(2) or "").lower()
        if not name:
            continue
        if name == "br":
            reader.buffer.append(" ")
            continue
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            reader.flush()
        if closing:
            reader.close(name)
        elif name not in VOID and not m.group(3).endswith("/"):
            if name in CLOSES_P:
                reader.close_paragraph()
            reader.open(name, m.group(3))
    reader.buffer.append(page[at:])
    reader.close_to(0)
    reader.flush()
    found = reader.found
    own = any(z not in (NONE, TEASER) and k >= 2 for z, k, _ in found)
    found = [(NONE if z == TEASER and own else "" if z == TEASER else z, k, t) for z, k, t in found]
    best = max((k for z, k, _ in found if z != NONE), default=0)
    least = min(best, 2)  # articles and main elements both count; names only where there are neither
    return [(z if z == NONE else (z or MAIN) if k >= least > 0 else OPEN, t) for z, k, t in found]


def _read(page: str | None) -> tuple[str, list[dict[str, str]] | None, str]:
    """(text of the article, the blocks that aren't out where the repeats are to decide, text of all other blocks) of a page."""
    cut = blocks(page or "")
    asked = [t for z, t in cut if z in (DOUBT, OPEN)]
    decided = not asked or not any(z == DOUBT for z, _ in cut) and any(z == MAIN for z, _ in cut)
    undecided = None if decided else [{"zone": z, "text": t} for z, t in cut if z != NONE]
    return "\n\n".join(t for z, t in cut if z == MAIN), undecided, "\n".join([*asked, "", *(t for z, t in cut if z == NONE)])


def parse(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, host, and of a page's two streams, a row each: side, stream (packed), undecided, tells.

    A page's text is told by the stream of its main blocks, or by the other, which then carries all blocks (`undecided`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = list(map(_read, batch.column("html").to_pylist()))
            for side, at in (("article", 0), ("other", 2)):
                stream = pa.array([repeats.pack(r[at].encode()) for r in read], pa.binary())
                undecided = pa.array([r[1] if at else None for r in read], _blocks)
                tells = pa.array([(r[1] is None) == (at == 0) for r in read], pa.bool_())
                columns = [batch.column("page_id"), batch.column("url"), pa.array([side] * len(read), pa.string()), stream, undecided, tells]
                yield pa.record_batch(columns, names=["page_id", "url", "side", "stream", "undecided", "tells"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    schema = "page_id long, url string, side string, stream binary, undecided array<struct<zone: string, text: string>>, tells boolean"
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:\w+:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    return rows.mapInArrow(releasing(run), schema).withColumn("host", host)


_blocks = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))


def decide(undecided: Column, spans: Column) -> Column:
    """The text of blocks, given the repeated spans of the page's stream, at whose beginning the asked blocks stand."""

    @F.pandas_udf("string")
    def keep(blocks_: pd.Series, spans_: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(blocks_, spans_, strict=True):
            if own is None:
                out.append(None)
                continue
            has_main, at, kept = any(b["zone"] == MAIN for b in own), 0, []
            for b in own:
                if b["zone"] == MAIN:
                    kept.append(b["text"])
                    continue
                raw = b["text"].encode()
                parts, pos = [], at
                for s in found if found is not None else ():
                    lo, hi = max(s["start"], at), min(s["stop"], at + len(raw))
                    if lo < hi:
                        parts.append(raw[pos - at : lo - at])
                        pos = hi
                parts.append(raw[pos - at :])
                if b["zone"] == DOUBT:
                    if 2 * sum(map(len, parts)) >= len(raw):
                        kept.append(b["text"])
                elif not has_main:
                    left = " ".join(b" ".join(parts).decode("utf-8", "ignore").split())
                    if left:
                        kept.append(left)
                at += len(raw) + 1
            out.append("\n\n".join(kept))
        return pd.Series(out, dtype=object)

    return keep(undecided, spans)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_repeated (bytes that other pages of the host repeat, of the blocks that aren't out) of every page."""
    # Pages are read once, into the parts that are sorted, so their text is nowhere twice; parts are sized by the markup.
    streams = parse(pages, key, url, page).withColumn("sorted_with", F.concat_ws(" ", "host", "side"))
    size = pages.agg(F.sum(F.octet_length(page))).first()[0] or 0
    spans = repeats.shared_spans(streams, key="page_id", text="stream", group="sorted_with", length=LENGTH, carry=("url", "undecided", "tells"), whole=True, packed_bytes=size)
    told = spans.where("tells").withColumn("decided", decide(F.col("undecided"), F.col("spans")))
    asked = F.aggregate(F.filter("undecided", lambda b: b["zone"] != MAIN), F.lit(0), lambda n, b: n + F.octet_length(b["text"]) + 1)  # they begin the stream
    within = F.coalesce(asked, F.col("n_bytes")).cast("long")
    n_repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.greatest(F.lit(0), F.least(s["stop"], within) - s["start"]))
    text = F.when(F.col("undecided").isNull(), F.col("kept").cast("string")).otherwise(F.col("decided"))
    return told.select("page_id", "url", text.alias("text"), n_repeated.alias("n_repeated"))


def op8_host_suffix_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
