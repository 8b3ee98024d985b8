"""Main text of web pages: what pages of a host share is a template, and goes.

A page is read into its elements. The article (else the main part, else the body) gives the text, without the elements that
their tag or class says are no part of it (menus, headers, footers, sidebars, notices, adverts, forms, comments). What no
name gives away is found by recurrence: every element of the article is hashed with all below it, Spark counts hashes by
host, and a subtree found on at least `share` of a host's pages, and on `least` pages that differ around it, is deleted from
all pages of that host. Pages differ around a subtree by their longest and by their first text outside it, so that copies
of one article, at however many addresses, do not make its paragraphs a template.

Text is cut into blocks where block elements begin and end. Inside a block character references are decoded and white space
becomes one space; blocks without text are left out, the others are joined by line feeds.

What comes of each case: a null or empty html, or one without text, gives an empty text. A page without host (no `://`) has
no templates. Repeated rows count as pages and come back each. An element that is never closed ends where the one around it
does; a comment, script or tag that is never closed takes the rest of the page. A tag that is marked but holds the article is
kept. Pages may be of any length. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import join_sized, small_batches, spread, stash

SHARE = 0.5
LEAST = 5

# Fixed values of HTML: elements without end tag, those whose content is no markup, those inside a line of text, and which
# start tags end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, and words of a class, id or role, that are no part of an article.
ASIDE_TAGS = frozenset("aside audio button canvas datalist dialog embed footer form head header input label math menu nav noscript object select svg template video".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promotions recommended related replies reply respond share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
HEADER = frozenset({"header", "masthead"})

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    marks: frozenset[str]
    first: int  # of its runs of text
    parts: list[bytes] = field(default_factory=list)
    article: bool = False  # holds an article or main part that is kept
    heading: bool = False
    last: int = 0
    key: int = 0


class Page:
    """A page's runs of text and its block elements."""

    def __init__(self, source: str):
        self.runs: list[str | None] = []  # None: no part of the article
        self.headings: list[bool] = []
        self.elements: list[Element] = []  # closed ones, inner first
        self._open = [Element("", frozenset(), 0)]
        self._text: list[str] = []
        self._muted = 0  # open marked elements inside a line
        self._read(source)
        while self._open:
            self._close()
        self.main = self._main()

    def _read(self, source: str) -> None:
        end, at = source.rfind(">") + 1, 0
        while at < end and (m := _TAG.search(source, at, end)):
            self._say(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                    return
                continue
            if m[1] or m[4]:
                self._end(name)
                continue
            attributes = m[3] if m[2] else m[6]
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                if not close:
                    return
                at = source.find(">", close.end()) + 1 or len(source)
                continue
            self._start(name, attributes)
        rest = source[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        self._say(rest[: cut.start()] if cut else rest)

    def _say(self, text: str) -> None:
        if text and not self._muted:
            self._text.append(html.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.runs.append(text)
            self.headings.append(any(e.tag in HEADINGS for e in self._open[-2:]))
            self._open[-1].parts.append(text.encode("utf-8", "surrogatepass"))

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._say(" ")
        words = frozenset()
        if attributes:
            said = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
            words = ASIDE_WORDS.intersection(_WORD.findall(said)) if said else words
            if said and name == "div" and "main" in said.split():
                name = "main"
        marks = words | {name} if name in ASIDE_TAGS else words
        if name in INLINE:
            if words and name not in VOID:
                self._open.append(Element(name, marks, len(self.runs)))
                self._muted += 1
            return
        self._flush()
        if name in CLOSES_P:
            self._leave("p", CLOSES_P - {"p"})
        if name in ENDS:
            for tag in ENDS[name][0].split():
                self._leave(tag, ENDS[name][1])
        if name not in VOID:
            self._open.append(Element(name, frozenset(marks), len(self.runs)))

    def _leave(self, tag: str, bounds: Sequence[str] | frozenset[str]) -> None:
        """Close the innermost open `tag`, unless an element of bounds lies around it first."""
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                while len(self._open) > i:
                    self._close()
                return
            if self._open[i].tag in bounds:
                return

    def _end(self, name: str) -> None:
        if name in INLINE:
            for i in range(len(self._open) - 1, 0, -1):
                if self._open[i].tag not in INLINE:
                    return
                if self._open[i].tag == name:
                    while len(self._open) > i:
                        self._close()
                    return
            return
        self._flush()
        self._leave(name, ())

    def _close(self) -> None:
        e = self._open[-1]
        if e.tag in INLINE:
            self._muted -= 1
            self._open.pop()
            return
        self._flush()
        self._open.pop()
        e.last = len(self.runs)
        kept_whole = not e.marks or e.article or (e.tag == "form" and e.heading)
        if not kept_whole:
            titles = e.marks & HEADER and any(x.tag in ("article", "main") for x in self._open)
            for i in range(e.first, e.last):
                if not (titles and self.headings[i]):
                    self.runs[i] = None
        digest = hashlib.blake2b(e.tag.encode() + b"\0" + b"\1".join(e.parts), digest_size=8).digest()
        e.key = int.from_bytes(digest, "big", signed=True)
        if self._open:
            up = self._open[-1]
            up.parts.append(digest)
            up.article |= kept_whole and (e.article or e.tag in ("article", "main"))
            up.heading |= e.heading or e.tag == "h1"
            if kept_whole:
                self.elements.append(e)

    def _main(self) -> list[int]:
        """Numbers of the runs of the article."""
        for tag in ("article", "main"):
            inside = {i for e in self.elements if e.tag == tag for i in range(e.first, e.last) if self.runs[i] is not None}
            if inside:
                return sorted(inside)
        return [i for i, r in enumerate(self.runs) if r is not None]

    def subtrees(self) -> Iterator[tuple[int, int, int]]:
        """(hash, longest text outside, first text outside) of each subtree of the article, once a hash; a text as 6 bits of
        its hash. A subtree that is all of the article is none."""
        text = [self.runs[i] for i in self.main]
        longest = lambda runs: max(runs, key=lambda r: (len(r), r), default=None)
        before, after, best = [None], [None], None
        for r in text:
            before.append(best := longest([x for x in (best, r) if x is not None]))
        best = None
        for r in reversed(text):
            after.append(best := longest([x for x in (best, r) if x is not None]))
        place = {i: n for n, i in enumerate(self.main)}
        bit = lambda r: hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] & 63
        seen = set()
        for e in self.elements:
            if e.tag in ("article", "main", "body", "html") or e.key in seen:
                continue
            inside = [place[i] for i in range(e.first, e.last) if i in place]
            if inside and len(inside) < len(text):
                seen.add(e.key)
                a, b = inside[0], inside[-1] + 1
                outside = longest([x for x in (before[a], after[len(text) - b]) if x is not None])
                yield e.key, bit(outside), bit(text[0] if a else text[b])

    def text(self, templates: frozenset[int]) -> str:
        gone = {i for e in self.elements if e.key in templates and e.tag not in ("article", "main", "body", "html") for i in range(e.first, e.last)} if templates else ()
        return "\n".join(self.runs[i] for i in self.main if i not in gone)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL: after `://`, up to `/`, `?`, `#` or the end; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, longest and first (each one bit of a long) of each page's subtrees; key null: the page itself."""
    for b in batches:
        hosts, keys, longest, first = [], [], [], []
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = [(None, 0, 0), *Page(source or "").subtrees()]
            hosts.extend([host] * len(rows))
            for out, values in zip((keys, longest, first), zip(*rows)):
                out.extend(values)
        bits = lambda v: pa.array([(1 << x) - ((1 << 64) if x == 63 else 0) for x in v], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), bits(longest), bits(first)], names=["host", "key", "longest", "first"])


def templates(pages: DataFrame, url: str = "url", source: str = "html", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, keys: the hashes of each host's templates, in order. There are at most 1 / share times as many as a page of the
    host has subtrees, so the array is bounded by the pages' own size."""
    read = spread(pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html"))).where("host <> ''")
    each = read.mapInArrow(_hashes, "host string, key bigint, longest bigint, first bigint")
    counted = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or("longest")).alias("longest"), F.bit_count(F.bit_or("first")).alias("first"))
    kept = stash(counted.where((F.col("n") >= least) & (F.col("key").isNull() | (F.least("longest", "first") >= min(least, 32)))), "subtrees")
    hosts = kept.where("key is null").select("host", F.col("n").alias("pages"))
    often = join_sized(kept.where("key is not null").select("host", "key", "n"), hosts, ["host"]).where(F.col("n") >= F.lit(share) * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", *, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """key, url, text, n_chars of every page: its article without its host's templates.

    Pages are read twice: once for the counts, once for the text. What the host's pages share, a few hashes, comes to each
    page by its host; neither the pages nor their text are shuffled unless there are very many hosts.
    """
    small_batches(pages.sparkSession)
    found = stash(templates(pages, url, source, share, least), "templates")
    rows = spread(pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"))).withColumn("host", host_of(F.col("url")))
    with_keys = join_sized(rows, found, ["host"], 16).select("id", "url", "html", "keys")
    out = rows.select("id", "url").withColumn("text", F.lit("")).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(s or "").text(frozenset(k or ())) for s, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), b.column(1).cast(arrow.field(1).type), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return with_keys.mapInArrow(run, out).select(F.col("id").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("bigint").alias("n_chars"))
