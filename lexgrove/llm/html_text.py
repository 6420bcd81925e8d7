"""Main text of web pages by removing site templates.

A page is read once into blocks of text and into elements with a hash of their subtree, rolled up from their children's: its tags and its text, without
attributes, and outside of a marked article with numbers between words made alike. What is outside of a page's marked article and doesn't hold it is hashed by its shape
alone: tags and class names, like children once, so that a menu whose links differ from page to page is one subtree. Spark counts, host by host, in how many different contexts
each subtree stands; a context is the least hash of the blocks outside of it, so copies and most near copies of an article are one. As another part of the template may be the least
everywhere, CONTEXTS hashes each give a count and the greatest counts. What recurs across many pages of its host is template and
goes. Of the rest, only the article counts where a page marks one, and elements whose tag says that they hold no text of the
article, or whose class, id or role names nothing but such a part ("site-footer", "comment-list", not "share-price"), go too;
within an article only those of adverts, notices, side bars and readers' comments, and never headings, paragraphs, items or quotes. A part
whose name is that of its own first heading ("cookies" over "Cookies") is text, but for readers' comments and the like; a form that holds an
article or a main heading is the page's own and takes nothing away; inline parts that go don't split the block around them.

Defined results: null and empty html give empty text; a null url is a host of its own; rows of equal page_id are separate pages;
unclosed elements end with what holds them or with the page; an empty table gives no rows; very
long and deeply nested pages are read whole, in linear time; other columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import html
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm.common import map_arrow, materialise, with_small

#: A subtree is template if it stands in so many different contexts of the host at least, and in this share of them; within a marked
#: article more is asked for, as texts quote each other.
PAGES_MAIN, SHARE_MAIN = 8, 0.5
PAGES_ELSEWHERE, SHARE_ELSEWHERE = 4, 0.25
#: Odd factors that make one hash several.
CONTEXTS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: A tag ends at the first > outside of quotes; where a quote isn't closed before the next <, at the first > at all.
_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|$)|<(/?)({_NAME})((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>|<(/?)({_NAME})([^<>]*)>|<[!?/][^>]*>""", re.S)
_HEADED = re.compile(r"\s*<h[1-6]\b[^>]*>(.{0,300}?)</h[1-6]", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title xmp svg".split())
NO_TEXT = RAW | frozenset("head nav footer aside form button select dialog menu object canvas audio video".split())
#: Words of classes, ids and roles that name a part which isn't the article's text: everywhere, and outside of a marked article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion comment comments reply replies disqus respond cookie cookies consent "
    "gdpr notice notices sidebar sidenav newsletter subscribe subscription signup popup modal overlay nav navbar navigation breadcrumb breadcrumbs social sharing".split()
)
NOT_MAIN = NOT_ARTICLE | frozenset("menu menubar footer header masthead contentinfo banner login share related recommended pagination pager toolbar complementary search alert".split())
#: Of these, what isn't text even under a heading of its name.
READERS = frozenset("comment comments reply replies disqus respond newsletter subscribe subscription signup related recommended share social sharing".split())
#: Words that say where or how such a part is shown.
NEUTRAL = frozenset(
    "site main page top bottom left right bar box list area section wrapper wrap container block slot inner outer widget item items links link global primary secondary body content mobile desktop "
    "sticky fixed form thread feed count title text unit zone panel column col row group js is has".split()
)
#: Elements that only their tag takes away, and those that a class within an article may.
PLAIN = frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot caption figcaption".split())
PARTS = frozenset("div section ul ol dl table article".split())
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"}
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


@functools.lru_cache(100_000)
def names_part(value: str, inside: bool) -> bool:
    """Whether one of the words of a class, id or role names a part that isn't the article's text, and nothing else."""
    known = NOT_ARTICLE if inside else NOT_MAIN
    for word in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [x for x in re.split("[^a-z0-9]+", word) if x]
        if any(x in known for x in parts) and all(x in known or x in NEUTRAL for x in parts):
            return True
    return False


def plain_name(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", html.unescape(re.sub("<[^>]*>", " ", text)).lower()).strip("-")


def heads_itself(value: str, source: str, at: int) -> bool:
    """Whether a class or id is what the heading says that follows at once."""
    found = _HEADED.match(source, at)
    name = plain_name(value)
    return bool(found) and name == plain_name(found[1]) and not READERS & set(name.split("-"))


def site_of(host: str) -> int:
    return xxhash.xxh64_intdigest(host) - (1 << 63)


class Page:
    """blocks: (text, in the article, excluded) in page order; elements: (first block, end block, hash of the subtree, in the article)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.elements: list[tuple[int, int, int, bool]] = []
        self.marked = False
        self.read(source)

    def read(self, source: str) -> None:
        stack: list[list] = []  # open elements: tag, excludes, mutes, article, first block, class
        parts: list[tuple[list[str], dict[int, None]]] = [([], {})]  # of each open block element: its children's hashes or texts, and shapes
        found: list[tuple] = []
        held_open: collections.Counter[str] = collections.Counter()
        excluded = muted = inside = at = 0
        text: list[str] = []

        def flush() -> None:
            if text:
                whole = " ".join(html.unescape("".join(text)).split())
                if whole:
                    self.blocks.append((whole, inside > 0, excluded > muted))
                    parts[-1][0].append(whole if inside else alike(whole))
                    parts[-1][1][0] = None
                text.clear()

        def close() -> None:
            nonlocal excluded, muted, inside
            tag, excludes, mutes, article, block, name = stack.pop()
            held_open[tag] -= 1
            if tag in BLOCK:
                flush()
                inner, shapes = parts.pop()
                exact = xxhash.xxh64_intdigest("\0".join([tag, *inner])) >> 1
                shape = xxhash.xxh64_intdigest(f"{tag}.{name}:{list(shapes)}") >> 1
                parts[-1][0].append(f"<{exact:x}>")
                parts[-1][1][shape] = None
                if tag not in ("html", "body", "article", "main") and len(self.blocks) > block:
                    found.append((block, len(self.blocks), exact, shape, inside > 0))
            excluded -= excludes
            muted -= mutes
            inside -= article

        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at and not muted:
                text.append(source[at : m.start()])
            at = m.end()
            tag, ends, said = (m[2], m[1], m[3]) if m[2] else (m[5], m[4], m[6])
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                flush()
                if not ends and tag != "html" and held_open["head"]:  # a head that isn't closed ends here
                    while stack[-1][0] != "head":
                        close()
                    close()
            elif tag == "br" and not muted:
                text.append(" ")
            if ends:
                for i in range(len(stack) - 1 if held_open[tag] else -1, -1, -1):
                    if stack[i][0] == tag:
                        while len(stack) > i:
                            close()
                        break
                    if stack[i][0] in ("article", "body") and tag not in ("body", "html", "article"):
                        break
                continue
            if tag in VOID:
                continue
            if tag in _CLOSES_P or tag in _SAME:
                same = _SAME.get(tag, {"p"}) | {"p"}
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same:
                        while len(stack) > i:
                            close()
                    elif stack[i][0] in BLOCK:
                        break
            attributes = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(said)} if said else {}
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
            article = tag in ("article", "main") or attributes.get("role") in ("main", "article")
            if (article or tag == "h1") and excluded and not hidden and all(x[0] == "form" for x in stack if x[1]):
                for x in stack:
                    x[1] = 0
                excluded = 0
            excludes = tag in NO_TEXT or hidden or (tag == "header" and not inside)
            if attributes and not excludes and tag not in PLAIN and (tag in PARTS or not inside):
                within = bool(inside) or article
                excludes = any(names_part(attributes[x], within) and not heads_itself(attributes[x], source, at) for x in ("class", "id", "role") if attributes.get(x))
            article = article and not excludes and not excluded
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if said.endswith("/") and tag not in BLOCK:
                continue
            self.marked |= article
            mutes = excludes and tag not in BLOCK
            stack.append([tag, int(excludes), int(mutes), article, len(self.blocks), _DIGITS.sub("0", attributes.get("class", ""))])
            held_open[tag] += 1
            if tag in BLOCK:
                parts.append(([], {}))
            excluded += excludes
            muted += mutes
            inside += article
        if at < len(source) and not muted:
            text.append(source[at:])
        flush()
        while stack:
            close()
        held = list(itertools.accumulate((x[1] for x in self.blocks), initial=0))
        self.elements = [(i, j, shape if self.marked and held[i] == held[j] else exact, within) for i, j, exact, shape, within in found]

    def own(self) -> list[bool]:
        """Whether each block is left by everything but the counts."""
        return [not excluded and (inside or not self.marked) for _, inside, excluded in self.blocks]

    def subtrees(self) -> list[tuple]:
        """(hash, in the article, contexts) of each subtree; a context is the least hash of the article's blocks outside of it, 0 without any."""
        plain = [xxhash.xxh64_intdigest(text) if own else None for (text, _, _), own in zip(self.blocks, self.own(), strict=True)]
        found = []
        for factor in CONTEXTS:
            name = [_NONE if x is None else x * factor % 2**64 >> 1 for x in plain]
            before = list(itertools.accumulate([_NONE, *name], min))
            after = list(itertools.accumulate([_NONE, *reversed(name)], min))[::-1]
            found.append([x if (x := min(before[i], after[j])) != _NONE else 0 for i, j, _, _ in self.elements])
        return [(h, inside, *contexts) for (_, _, h, inside), contexts in zip(self.elements, zip(*found, strict=True), strict=True)]

    def template(self, known: frozenset[int]) -> list[bool]:
        """Whether each block is in a subtree of the host's template."""
        out = [False] * len(self.blocks)
        for i, j, h, _ in self.elements:
            if h in known:
                out[i:j] = [True] * (j - i)
        return out

    def text(self, known: frozenset[int]) -> str:
        return "\n".join(block[0] for block, own, gone in zip(self.blocks, self.own(), self.template(known), strict=True) if own and not gone)


_NONE = 1 << 63
_DIGITS = re.compile("[0-9]+")


def alike(text: str) -> str:
    """text with one number for all, if it is of letters for the most part ("12 comments", not a table's figures or "w12 w34")."""
    bare = _DIGITS.sub("0", text)
    digits = len(text) - len(_DIGITS.sub("", text))
    return bare if digits and sum(map(str.isalpha, text)) >= 3 * digits else text


def subtrees(pages: DataFrame) -> DataFrame:
    """(site, name, main, context_0, ...): the different subtrees of each page and the contexts they stand in, in 32 bits; site is a hash of the host,
    name 0 is the whole page."""
    names = ["site", "name", "main", *(f"context_{i}" for i in range(len(CONTEXTS)))]

    def make():
        def call(batch: pa.RecordBatch):
            rows = set()
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if source:
                    host, page = host_of(url), Page(source)
                    site = site_of(host)
                    rows.update((site, h, inside, *(x >> 32 for x in contexts)) for h, inside, *contexts in page.subtrees())
                    rows.add((site, 0, False, *[xxhash.xxh64_intdigest(page.text(frozenset())) >> 33] * len(CONTEXTS)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * len(CONTEXTS))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

        return call

    return map_arrow(pages.select("url", "html"), make, "site long, name long, main boolean, " + ", ".join(f"{x} int" for x in names[3:]))


def templates(pages: DataFrame) -> DataFrame:
    """(site, names): the subtrees of each host's template. A host has few, as each stands on a fixed share of its pages."""
    different = F.greatest(*(F.count_distinct(f"context_{i}") for i in range(len(CONTEXTS))))
    counted = subtrees(pages).groupBy("site", "name").agg(different.alias("n"), F.max("main").alias("main"))
    counted = materialise(counted.filter((F.col("n") >= min(PAGES_MAIN, PAGES_ELSEWHERE)) | (F.col("name") == 0)), "html-subtrees")
    total = counted.filter("name = 0").select("site", F.col("n").alias("pages"))
    enough = F.when(F.col("main"), (F.col("n") >= PAGES_MAIN) & (F.col("n") >= SHARE_MAIN * F.col("pages"))).otherwise((F.col("n") >= PAGES_ELSEWHERE) & (F.col("n") >= SHARE_ELSEWHERE * F.col("pages")))
    return with_small(counted.filter("name <> 0"), total, "site").filter(enough).groupBy("site").agg(F.array_sort(F.collect_set("name")).alias("names"))


def _with_site():
    return lambda batch: [pa.RecordBatch.from_arrays([*batch.columns, pa.array([site_of(host_of(x)) for x in batch.column("url").to_pylist()], pa.int64())], names=[*batch.schema.names, "site"])]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, template_chars) of every page; template_chars: code points of blocks that the counts took away."""
    named = materialise(templates(pages), "html-templates")

    def make():
        known: dict = {}

        def call(batch: pa.RecordBatch):
            out, gone = [], []
            for source, names in zip(batch.column("html").to_pylist(), batch.column("names").to_pylist(), strict=True):
                key = tuple(names or ())
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(key)
                page = Page(source or "")
                out.append(page.text(known[key]))
                gone.append(sum(len(x[0]) for x, y in zip(page.blocks, page.template(known[key]), strict=True) if y))
            n = np.array([len(x) for x in out], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(n), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_chars", "template_chars"])

        return call

    site = map_arrow(pages.select("page_id", "url", "html"), _with_site, T.StructType([*pages.select("page_id", "url", "html").schema, T.StructField("site", T.LongType())]))
    joined = with_small(site, named, "site", "left")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("template_chars", T.LongType())])
    return map_arrow(joined.select("page_id", "url", "html", "names"), make, schema)
