"""Main text of web pages, with site templates removed by counting element subtrees per host.

1. Every page is parsed once (leniently: unclosed elements, stray end tags, cut-off markup). Each
   block element gets a digest of its subtree: its name, its text and its children's digests, with
   the page's own host and the numbers in running text masked, so that a copyright line or a page
   counter is equal on all pages.
2. Spark counts on how many different pages of a host, and of its registered domain, a subtree
   stands. HOST_PAGES or DOMAIN_PAGES of them make it a template. Pages are different for a subtree if what
   they show outside of it is, whatever its length; so an article that is repeated in one frame counts once, and
   a frame around many articles as often as there are articles. The counts are absolute: a template stays one however large its host grows.
   Prose of an article (its headings, paragraphs, lists, quotes, tables) is never counted, so that an
   article published on many pages of a host stays whole.
3. A second parse deletes the template subtrees. What HTML itself says of an element comes next, for
   pages of hosts that are too small to count: menus, headers, footers, sidebars, forms, landmark
   roles and hidden elements aren't main text; if the page has an ``article`` (else a ``main``), the
   main text is what is left inside it, the articles nested in an article being readers' comments.
   Last, class names settle what neither does (CLASS_WORDS). ``by_markup`` and ``by_class`` switch
   these two off. Blocks come in page order, white space in a block as one space, two line feeds
   between blocks.

Pages are dealt to tasks by page, never by host, and the first pass sends one row per different page
and subtree, pre-aggregated. Up to MOST_SENT templates (64-bit keys, counted first) are broadcast;
beyond that the keys of the pages are joined with them, each key spread over SALTS parts.

Nulls and odd input: a null or empty html gives an empty text; a null url, or one without ``://``,
belongs to the empty host; a null id is kept; repeated pages give equal rows, and count once for
templates; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, materialize
from .url_filter import suffix_and_domain, url_parts

#: Different pages of one host, or of one registered domain, from which on a subtree is a template.
HOST_PAGES = 3
DOMAIN_PAGES = 5
MOST_SENT = 1_000_000
SALTS = 32
#: A comment, a declaration, or a tag with its attributes; a quote that follows "=" may hold ">".
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "template", "tfoot", "thead", "title", "tr", "ul",
}
#: Elements that a reader never sees as text of the page.
UNSEEN = {
    "audio", "canvas", "head", "iframe", "noembed", "noframes", "noscript", "object", "script", "style", "svg", "template", "textarea", "title", "video", "xmp",
}
#: Elements that HTML sets apart from the main text.
LANDMARKS = {"aside", "button", "dialog", "footer", "form", "header", "menu", "nav", "select"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "status", "toolbar", "tooltip"}
CONTAINERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements of prose; inside an article they are no templates.
PROSE = HEADINGS | {"p", "blockquote", "pre", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "caption", "figure", "figcaption", "article", "main", "body", "html", "head"}
#: An open element of the second set ends at a start tag of the first.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
#: How far up such an element is looked for.
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "td", "th"}
#: Words of a class or id, on other elements than prose, by which one is no main text; inside an
#: article only a class of exactly such a word counts.
CLASS_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "reply",
    "share", "sidebar", "signup", "social", "sponsored", "subscribe", "toolbar", "widget",
}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What may drop a block, as bits: it is unseen, HTML's own markup, a class name; and headings, which stay in an article's header.
BY_NATURE, BY_MARKUP, BY_CLASS, HEADING = 1, 2, 4, 8
NUMBER = re.compile("[0-9]+")
WORDS = re.compile(r"[^\W\d_]{2,}")


class _Node:
    __slots__ = ("tag", "drops", "parts", "first", "main", "nested", "anchor_chars", "chars", "links")

    def __init__(self, tag: str, drops: int, first: int, nested: bool):
        self.tag, self.drops, self.parts, self.first, self.nested = tag, drops, [], first, nested
        self.main = False  # whether it holds an article or main element
        self.anchor_chars = self.chars = self.links = 0


def _drops(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element's role, style or class says that it is no main text."""
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    found = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return BY_NATURE
        if name == "role" and value.strip().lower() in ROLES:
            found |= BY_MARKUP
        elif name in ("class", "id") and tag not in PROSE:
            value = unescape(value)
            if inside:
                words = value.lower().split() if name == "class" else ()
            else:
                words = re.findall("[a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", value).lower())
            if not CLASS_WORDS.isdisjoint(words):
                found |= BY_CLASS
    return found


def site_key(site: str) -> int:
    """A number of 64 bits for a host or domain, by which its subtrees' digests are told from others'."""
    return int.from_bytes(hashlib.blake2b(site.encode("utf-8", "surrogatepass"), digest_size=8).digest()) | 1


def keys_of(digests: list[int], site: int) -> np.ndarray:
    """Signed 64-bit keys of subtrees of a site."""
    return (np.array(digests, np.int64).view(np.uint64) * np.uint64(site)).view(np.int64)


class Page:
    """The blocks of a page, and its subtrees as ranges of them.

    blocks: texts; gone: what drops each, in bits; inside: 2 in an article, 1 in a main element, else 0;
    subtrees: (digest, first block, end) of each element that may be a template.
    """

    def __init__(self, html: str, host: str = ""):
        self.host = host
        self.blocks: list[str] = []
        self.gone = bytearray()
        self.inside = bytearray()
        self.subtrees: list[tuple[int, int, int]] = []
        self._marks: list[tuple[int, int, int, bool]] = []  # (first block, end, bits, not its headings): what drops blocks
        self._weights: list[int] = []  # a digest of each block, masked
        self._open: list[_Node] = [_Node("#", 0, 0, False)]
        self._text: list[str] = []
        self._anchors = self._linked = self._articles = self._mains = 0
        self._counts: list[dict[str, int]] = [{}]  # open elements by name, since the innermost container
        self._parse(html)

    def _parse(self, html: str) -> None:
        at, n, unclosed = 0, len(html), set()
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and tag not in unclosed:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if end is None:
                    unclosed.add(tag)
                    if tag in ("script", "style"):
                        break
                else:
                    at = end.start()
        while len(self._open) > 1:
            self._close(False)
        self._flush()
        self._mark()

    def _mark(self) -> None:
        """Sets ``gone``: the bits of all ranges that a block is in, by sums along the blocks, however deep they nest."""
        n = len(self.blocks)
        begins = np.zeros((2, 4, n + 1), np.int32)
        for first, end, bits, spare in self._marks:
            for k in range(4):
                if bits >> k & 1:
                    begins[int(spare), k, first] += 1
                    begins[int(spare), k, end] -= 1
        inside = begins.cumsum(axis=2)[:, :, :n] > 0
        bit = np.array([BY_NATURE, BY_MARKUP, BY_CLASS, HEADING])[:, None]
        whole, spared = ((x * bit).sum(axis=0) for x in inside)
        self.gone = bytearray((whole | np.where(inside[0, 3], 0, spared)).astype(np.uint8).tobytes())

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._anchors:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(unescape("".join(self._text)).split())
        self._text.clear()
        if text:
            node = self._open[-1]
            self.blocks.append(text)
            self.inside.append(2 if self._articles else 1 if self._mains else 0)
            masked = self._masked(text, node.tag).encode("utf-8", "surrogatepass")
            self._weights.append(int.from_bytes(hashlib.blake2b(masked, digest_size=8).digest()))
            node.parts.append(b"\1" + masked)
            node.chars += len(text)
            node.anchor_chars += min(self._linked, len(text))
        self._linked = 0

    def _masked(self, text: str, tag: str) -> str:
        """A text without the page's own host and, if it is no prose and has two words, without its numbers."""
        if self.host:
            text = text.replace(self.host, "@")
        return NUMBER.sub("0", text) if tag not in PROSE and NUMBER.search(text) and len(WORDS.findall(text)) > 1 else text

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK or tag in UNSEEN or tag in LANDMARKS
        if tag == "br" or tag in ("td", "th"):
            self._text.append(" ")
        if tag == "a":
            self._anchors += 1
            self._open[-1].links += 1
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        drops = _drops(tag, attributes, bool(self._articles or self._mains)) if attributes and tag not in ("html", "body") else 0
        if not block and not drops:
            return
        self._flush()
        if block:
            if self._open[-1].tag == "p":
                self._close(True)
            if (ended := ENDED_BY.get(tag)) is not None:
                for k in range(len(self._open) - 1, 0, -1):
                    if self._open[k].tag in ended:
                        while len(self._open) > k:
                            self._close(True)
                        break
                    if self._open[k].tag in SCOPE:
                        break
        nested = False
        if tag == "article":
            nested = self._articles > 0
            self._articles += 1
        elif tag == "main":
            self._mains += 1
        self._open.append(_Node(tag, drops, len(self.blocks), nested))
        self._counts[-1][tag] = self._counts[-1].get(tag, 0) + 1
        if tag in CONTAINERS:
            self._counts.append({})

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._anchors = max(0, self._anchors - 1)
        if tag not in CONTAINERS and not self._counts[-1].get(tag) or tag in ("body", "html"):
            return  # an end tag doesn't reach out of the article that it stands in
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].tag == tag:
                self._flush()
                while len(self._open) > k:
                    self._close(len(self._open) == k + 1)
                return

    def _close(self, closed: bool) -> None:
        """Ends the innermost element; closed: by its own end tag, or as the grammar implies."""
        self._flush()
        node, above = self._open.pop(), self._open[-1]
        tag, first, end = node.tag, node.first, len(self.blocks)
        if tag in CONTAINERS:
            self._counts.pop()
        self._counts[-1][tag] -= 1
        self._articles -= tag == "article"
        self._mains -= tag == "main"
        in_main = bool(self._articles or self._mains)
        if end == first:
            return
        digest = hashlib.blake2b(tag.encode() + b"".join(len(p).to_bytes(4) + p for p in node.parts), digest_size=8).digest()
        above.parts.append(digest)
        above.chars += node.chars
        above.anchor_chars += node.anchor_chars
        above.links += node.links
        drops = node.drops | (BY_NATURE if tag in UNSEEN else 0) | (BY_MARKUP if tag in LANDMARKS or node.nested else 0)
        above.main |= node.main or tag in CONTAINERS and not drops
        if drops:
            # an element that wraps the article, such as a form around the whole page, isn't dropped
            wraps = node.main and (not closed or tag in ("form", "header") or not drops & BY_NATURE and tag not in LANDMARKS)
            if not wraps:
                self._marks.append((first, end, drops, tag == "header" and in_main))
        elif tag in HEADINGS:
            self._marks.append((first, end, HEADING, False))
        elif not node.main and not in_main and tag in ("ul", "ol", "div", "table", "section") and node.links >= 3 and 5 * node.anchor_chars >= 4 * node.chars:
            self._marks.append((first, end, BY_MARKUP, False))  # a list of links outside the article is a menu
        if not node.main and not (tag in PROSE and (in_main or tag in CONTAINERS)) and tag not in ("body", "html", "head", "title"):
            self.subtrees.append((int.from_bytes(digest, signed=True), first, end))

    def text(self, templates: frozenset[int] | set[int] = frozenset(), by_markup: bool = True, by_class: bool = True) -> str:
        """The main text without the subtrees in templates."""
        rules = BY_NATURE | (BY_MARKUP if by_markup else 0) | (BY_CLASS if by_class else 0)
        ruled = [bool(g & rules) for g in self.gone]
        found = [0] * (len(self.blocks) + 1)
        for digest, first, end in self.subtrees if templates else ():
            if digest in templates:
                found[first] += 1
                found[end] -= 1
        gone = [r or depth > 0 for r, depth in zip(ruled, accumulate(found))]
        # a container counts only with blocks that markup keeps, so a page's comments aren't its article
        level = max((x for x, g in zip(self.inside, ruled) if not g), default=0) if by_markup else 0
        return "\n\n".join(b for b, g, x in zip(self.blocks, gone, self.inside) if not g and x >= level)

    def rests(self) -> list[int]:
        """For each of ``digests``, a digest of the seen blocks outside of that subtree, wherever it stands: a sum, so that it takes no time."""
        seen = [0, *accumulate(w if not g & BY_NATURE else 0 for w, g in zip(self._weights, self.gone))]
        inside: dict[int, int] = {}
        for digest, first, end in self.subtrees:
            inside[digest] = inside.get(digest, 0) + seen[end] - seen[first]
        return [((seen[-1] - inside[d]) & (1 << 64) - 1) - (1 << 63) for d in self.digests()]

    def digests(self) -> list[int]:
        return sorted({d for d, _, _ in self.subtrees})


SUBTREES = "page binary, rests array<long>, host_keys array<long>, domain_keys array<long>"


def _subtrees(pages: DataFrame) -> DataFrame:
    """(page, rests, host_keys, domain_keys) of each page (page, host, domain, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, by_host, by_domain = [], [], []
            for host, domain, html in zip(*(batch.column(c).to_pylist() for c in ("host", "domain", "html"))):
                page = Page(html or "", host)
                whose.append(page.rests())
                digests = page.digests()
                by_host.append(keys_of(digests, site_key(host)))
                by_domain.append(keys_of(digests, site_key("." + domain)))
            cells = [batch.column("page"), pa.array(whose, pa.list_(pa.int64())), pa.array(by_host, pa.list_(pa.int64())), pa.array(by_domain, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["page", "rests", "host_keys", "domain_keys"])

    return map_in_arrow(pages.select("page", "host", "domain", "html"), run, SUBTREES)


def _located(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, host, domain, page, html); page: a digest of the host and the html, equal for equal pages only."""
    url, html = pages[url_col].cast("string"), pages[html_col].cast("string")
    host, _ = url_parts(url)
    _, domain = suffix_and_domain(host)
    page = F.unhex(F.sha2(F.concat(host, F.lit("\n"), F.coalesce(html, F.lit(""))).cast("binary"), 256))
    return pages.select(pages[id_col].cast("long").alias("id"), url.alias("url"), host.alias("host"), domain.alias("domain"), page.alias("page"), html.alias("html"))


def site_templates(found: DataFrame, host_pages: int = HOST_PAGES, domain_pages: int = DOMAIN_PAGES) -> DataFrame:
    """(key, n): the template subtrees of hosts and domains, from the subtrees of pages."""
    least = {"host_keys": host_pages, "domain_keys": domain_pages}
    parts = []
    for keys, n in least.items():
        each = found.select(F.explode(F.arrays_zip(F.col("rests").alias("rest"), F.col(keys).alias("key"))).alias("x")).select("x.*").distinct()
        parts.append(each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= n))
    return parts[0].unionByName(parts[1])


TEXTS = "id long, url string, text string, n_chars long"


def _cleaner(known: Callable[[np.ndarray, list[int] | None], np.ndarray], by_markup: bool, by_class: bool):
    """The second parse; known: which keys, given the page's own hits if any, are templates."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, domain, html, hits in zip(*(batch.column(c).to_pylist() for c in ("host", "domain", "html", "hits"))):
                page = Page(html or "", host)
                digests = page.digests()
                gone = known(keys_of(digests, site_key(host)), hits) | known(keys_of(digests, site_key("." + domain)), hits)
                texts.append(page.text({d for d, g in zip(digests, gone.tolist()) if g}, by_markup, by_class))
            cells = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "url", "text", "n_chars"])

    return clean


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    host_pages: int = HOST_PAGES, domain_pages: int = DOMAIN_PAGES, by_markup: bool = True, by_class: bool = True,
) -> DataFrame:
    """(id, url, text, n_chars) for every row of pages."""
    rows = _located(pages, id_col, url_col, html_col)
    found = materialize(_subtrees(rows), "subtrees")
    templates = materialize(site_templates(found, host_pages, domain_pages), "templates")
    if templates.count() <= MOST_SENT:
        sent = pages.sparkSession.sparkContext.broadcast(np.unique(templates.select("key").toPandas()["key"].to_numpy(np.int64)))

        def known(keys: np.ndarray, hits: list[int] | None) -> np.ndarray:
            if not len(sent.value):
                return np.zeros(len(keys), bool)
            at = np.minimum(np.searchsorted(sent.value, keys), len(sent.value) - 1)
            return sent.value[at] == keys

        joined = rows.withColumn("hits", F.lit(None).cast("array<long>"))
    else:

        def known(keys: np.ndarray, hits: list[int] | None) -> np.ndarray:
            return np.isin(keys, np.array(hits or (), np.int64))

        salted = templates.select("key").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = found.select("page", F.explode(F.concat("host_keys", "domain_keys")).alias("key")).distinct()
        each = each.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
        hits = each.join(salted, ["key", "salt"]).groupBy("page").agg(F.collect_list("key").alias("hits"))  # no more than a page's subtrees
        joined = rows.join(hits, "page", "left")
    out = map_in_arrow(joined.select("id", "url", "host", "domain", "html", "hits"), _cleaner(known, by_markup, by_class), TEXTS)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
