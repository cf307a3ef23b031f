"""Main text of web pages by site style trees.

Pages of one host share templates. Their DOMs are merged into one tree per host: an element is known by the path of tags and
classes that leads to it, and holds the child sequences (styles) and text blocks (contents) it was seen with, each with
its number of pages, copies of a page counted once. A sequence or block that differs from page to page carries information, one that stays the same
is template; with n of the m pages of an element,

    presentation importance = -sum p log_m p over its child sequences
    content importance      = 1 - mean of log_m n over its blocks
    importance              = (1 - 0.9 ** l) * presentation + 0.9 ** l * content,  l child sequences

A branch all of whose elements are below the threshold, and a block whose own importance is below it, go from every page
of the host; a page of template alone has no text. Nothing goes from a marked article.

What tags, roles and class names state plainly is taken as stated: menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are no candidates at all, and where a page marks its article (or main part)
the rest of the page is none either. Names are read more strictly the more a page says: outside an article, any word of
a name counts; inside one, only names that say nothing else ("share-buttons", not "social-history"); on the article itself,
only such classes, never its id. An article whose surroundings are named like noise counts if the page has no other and
less text elsewhere.

Trees are folded as counts by (host, element, feature), in each task before the shuffle; a host with a third of all pages
is a few rows more, not a group in one task. Only what is low reaches the pages again, a few entries per host.

Defined cases: a null or empty html and pages without text give an empty text; broken, unclosed and truncated markup is read
as far as it goes; null urls form one host; repeated pages get a row each; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.common import clearing, slices, written

THRESHOLD = 0.05
#: A host shows its template only over so many pages with an element.
LEAST_PAGES = 8
DECAY = 0.9
DEEPEST = 24

# HTML's own sets of elements, and words by which sites name what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER = set("nav footer aside form button select option datalist dialog menu template svg canvas object audio video map head".split())
BLOCKS = set("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
FENCES = {"table", "ul", "ol", "dl", "article", "section", "main", "body", "html"}
NOISE = set("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget widgets ad ads advert adverts advertisement advertising "
            "adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
            "subscription signup login search share sharing social comment comments commentlist disqus respond replies related recommended "
            "pagination pager toolbar skip copyright masthead topbar".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
                   r"|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")

# Words that say nothing of their own in a name.
FRAME = set("a area article block body bottom box button buttons by col column container content entry form group header heading icon icons "
            "inner item items left link links list main module outer panel post posts right row section site slot the title top unit wrap wrapper".split())

# A class such as with-sidebar names the rest of the page.
BESIDE = set("with without has no".split())

#: How surely a block belongs to the article: in the main part of a page, in a marked article.
MAIN, ARTICLE = 1, 2
#: Why a block is no candidate: by names alone, by names but in an article of its own, in any other way.
NAMED, SPARE, OUT = 1, 2, 3

#: (path, is no candidate whatever its names, is named like noise outside and inside an article, 0 or MAIN or ARTICLE, is a header)
Style = tuple[int, bool, bool, bool, int, bool]
_styles: dict[tuple[int, str, str], Style] = {}


def _noise(name: str) -> bool:
    """Whether a name says noise and nothing else."""
    words = {w for w in WORDS.findall(name) if not w.isdigit()}
    return bool(words & NOISE) and words <= NOISE | FRAME


def _style(parent: int, tag: str, attrs: str) -> Style:
    """What an element below a path says about itself."""
    key = (parent, tag, attrs)
    if key not in _styles:
        if len(_styles) > 100_000:
            _styles.clear()
        given = {m[0].lower(): unescape(m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
        classes = given.get("class", "").split()
        names = " ".join(sorted(classes))
        # Words run together are left: a class says "noise" only in a word of its own.
        words = [set(WORDS.findall(name)) for name in [*classes, given.get("id", "")]]
        words = set().union(*(w for w in words if not w & BESIDE))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        never = tag in NEVER or hidden or given.get("role") in ROLES
        article = (ARTICLE if tag == "article" or given.get("role") == "article" or given.get("itemprop") == "articlebody"
                   else MAIN if tag == "main" or given.get("role") == "main" else 0)
        inside = any(map(_noise, classes if article == ARTICLE else [*classes, given.get("id", "")]))
        outside = inside if article == ARTICLE else bool(words & NOISE)
        if tag in ("html", "body", "main"):
            inside = outside = False
        header = tag == "header" or "header" in words
        _styles[key] = (xxhash.xxh64_intdigest(f"{parent}/{tag}.{names}") >> 1, never, outside, inside, article, header)
    return _styles[key]


class Page:
    """Blocks of a page in order: (paths from the root, text, 0 or MAIN or ARTICLE); the child sequences of its elements."""

    def __init__(self, html: str):
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.sequences: list[tuple[int, int]] = []
        self.above: dict[int, tuple[int, ...]] = {}
        #: articles in surroundings that are only named like noise: their blocks
        self.spare: list[list[tuple[tuple[int, ...], str, int]]] = []
        #: open elements: tag, path, no candidate (OUT, or NAMED where names alone say so), 0 or MAIN or ARTICLE, its children
        self.open: list[tuple[str, int, int, int, list[int]]] = [("", 0, 0, 0, [])]
        self.text: list[str] = []
        at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            self._say(html[at:m.start()] if m else html[at:])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag in VOID:
                self.text.append(" ")
                if tag == "hr":
                    self._flush()
                self.open[-1][4].append(hash_of(tag))
            else:
                self._open(tag, (m[3] or m[6] or ""))
        while len(self.open) > 1:
            self._pop()
        self._flush()

    def _say(self, text: str) -> None:
        if text and self.open[-1][2] in (0, SPARE):
            self.text.append(text)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text = []
            if text:
                at = len(self.open) - 1  # where the text stands, not what ends it
                while self.open[at][2] in (NAMED, OUT):
                    at -= 1
                paths = tuple(e[1] for e in self.open[1:min(at + 1, DEEPEST)])
                (self.spare[-1] if self.open[at][2] else self.blocks).append((paths, text, self.open[at][3]))

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag not in ("li", "dd", "dt", "td", "th", "tr", "tbody", "thead"):
                self._end("p", FENCES)
            for other in CLOSES.get(tag, ()):
                self._end(other, FENCES - {"section"} if tag in ("li", "dt", "dd") else {"table", "article"})
        top = self.open[-1]
        path, never, outside, inside, article, header = _style(top[1], tag, attrs)
        if len(self.open) >= DEEPEST:  # what lies deeper belongs to the element there
            path = top[1]
        # A header heads the page unless it stands in an article.
        never = never or (header and not top[3] and not article)
        named = inside if top[3] == ARTICLE or article == ARTICLE else outside
        if not top[2]:
            top[4].append(path)
        if attrs.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            return
        out = OUT if never or top[2] == OUT else top[2]
        if out == NAMED and article == ARTICLE and not named and not self._article_above():
            out = SPARE
            self._flush()
            self.spare.append([])
        elif out != OUT and named:
            out = NAMED if not out else OUT
        level = 0 if out in (NAMED, OUT) else max(top[3], article)
        self.open.append((tag, path, out, level, []))

    def _article_above(self) -> bool:
        return any(e[0] == "article" or e[3] == ARTICLE for e in self.open)

    def _end(self, tag: str, fences: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if name in fences:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._end(tag, {"article", "main", "body"} - {tag} if tag not in ("html", "body") else set())

    def _pop(self) -> None:
        if self.open[-1][0] in BLOCKS or (self.open[-1][2] == SPARE != self.open[-2][2]):
            self._flush()
        _, path, out, _, children = self.open.pop()
        if not out:
            self.sequences.append((path, hash_of(",".join(map(str, children)))))
            self.above[path] = tuple(e[1] for e in self.open[1:])

    def candidates(self) -> list[tuple[tuple[int, ...], str]]:
        """The blocks of the articles, or all where no article is marked."""
        return [(paths, text) for paths, text, _ in self._candidates()]

    def _candidates(self) -> list[tuple[tuple[int, ...], str, int]]:
        if len(self.spare) == 1 and not any(inside == ARTICLE for _, _, inside in self.blocks):
            if sum(len(b[1]) for b in self.spare[0]) > sum(len(b[1]) for b in self.blocks):
                return self.spare[0]
        marked = any(inside for _, _, inside in self.blocks)
        return [b for b in self.blocks if b[2] or not marked]

    def content(self) -> int:
        """A hash of the candidates: copies of a page share it."""
        return hash_of(repr(self.candidates()))

    def features(self) -> set[tuple[int, int, int]]:
        """(element, kind, feature), once each: 0 a child sequence, 1 a block, 2 the page itself, 3 an element above."""
        out = set()
        for path, sequence in self.sequences:
            out.add((path, 0, sequence))
            out.add((path, 2, 0))
        for paths, text in self.candidates():
            if paths:
                out.add((paths[-1], 1, hash_of(text)))
        for path, above in self.above.items():
            out.update((path, 3, a) for a in (*above, path))
        return out

    def main_text(self, low: set[int]) -> str:
        """The candidates without low branches and blocks; those of a marked article all stay."""
        found = self._candidates()
        kept = [t for paths, t, inside in found if inside == ARTICLE or not low or (hash_of(t) not in low and low.isdisjoint(paths))]
        return " ".join(kept)


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _host(url: str) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def low_parts(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """host, low: the elements and blocks of each host's style tree below the threshold; hosts without any are left out."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            pages: dict[tuple[str, int], bytes] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(html or "")
                key, packed = (host, page.content()), zlib.compress(np.array(sorted(page.features()), np.int64).tobytes(), 1)
                pages[key] = min(packed, pages.get(key, packed))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pages], pa.string()), pa.array([c for _, c in pages], pa.int64()),
                                              pa.array(list(pages.values()), pa.binary())], ["host", "content", "features"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            held: Counter = Counter()
            for host, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update((host, *f) for f in np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, 3).tolist())
            rows = list(zip(*held)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int8()),
                                              pa.array(rows[3], pa.int64()), pa.array(list(held.values()), pa.int64())], names)

    names = ["host", "element", "kind", "feature", "n"]
    # Copies of a page fold in each task, so the smallest of their features stands for all.
    distinct = pages.select(_host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        read, "host string, content bigint, features binary").groupBy("host", "content").agg(F.min("features").alias("features"))
    seen = distinct.select("host", "features").mapInArrow(
        count, "host string, element bigint, kind tinyint, feature bigint, n bigint")
    tree = written(seen.groupBy("host", "element", "kind", "feature").agg(F.sum("n").alias("n")), "style-tree")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    n = F.col("n")
    nodes = tree.where("kind < 3").groupBy("host", "element").agg(
        of(2, n).alias("m"), of(0, F.lit(1)).alias("l"), of(0, n).alias("all"), of(0, n * F.ln(n)).alias("s"),
        of(1, F.lit(1)).alias("blocks"), of(1, F.ln(n)).alias("shared")).where(F.col("m") >= LEAST_PAGES)
    scale = F.ln("m")
    presentation = (F.ln("all") - F.col("s") / F.col("all")) / scale
    content = F.when(F.col("blocks") > 0, F.greatest(F.lit(0.0), 1 - F.col("shared") / F.col("blocks") / scale)).otherwise(0.0)
    weight = F.pow(F.lit(DECAY), F.col("l"))
    # Without child elements only the content speaks.
    nodes = nodes.select("host", "element", "m", ((1 - weight) * presentation + weight * content).alias("importance"))
    paths = tree.where("kind = 3").select("host", "element", F.col("feature").alias("above"))
    branches = paths.join(nodes, ["host", "element"], "left").groupBy("host", "above").agg(
        F.max(F.coalesce("importance", F.lit(1.0))).alias("most"))
    low_branches = branches.where(F.col("most") < threshold).select("host", F.col("above").alias("low"))
    often = tree.where((F.col("kind") == 1) & (n >= LEAST_PAGES))
    low_blocks = often.join(nodes.select("host", "element", "m"), ["host", "element"]).where(
        1 - F.ln(n) / scale < threshold).select("host", F.col("feature").alias("low"))
    # So low a block is on nearly every page of its host, so a host has no more of them than a page has blocks.
    return low_branches.union(low_blocks).groupBy("host").agg(F.collect_set("low").alias("low"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = THRESHOLD) -> DataFrame:
    """id, url, text, n_chars of every page."""
    with clearing() as keep:
        low = keep(written(low_parts(pages, url_col, html_col, threshold), "low-parts"))
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_html"), _host(url_col).alias("_host"))
    joined = rows.join(low.select(F.col("host").alias("_host"), "low"), "_host", "left").select(id_col, url_col, "_html", "low")
    kinds = [joined.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [Page(html or "").main_text(set(low or ())) for html, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(work, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
