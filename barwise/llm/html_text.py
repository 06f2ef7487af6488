"""Main text of web pages: site templates by recurring element subtrees, then the article without its surroundings.

Every block element is hashed with all it holds. Spark counts, for each host, on how many different pages a subtree occurs;
those on ``LEAST_PAGES`` are the site's template and are deleted from its pages. In a page with an article or main element
only what that holds is counted, once for all pages with the very same article, so copies of an article do not make it
template; and where over half of an article's text recurs, the pages are near copies and it stays whole. What marks itself
as surroundings (navigation, footers, forms, adverts, comments, by element, role or class) goes too, on a host with one page
as well.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import hinted, pieces, table, written

#: A subtree is template from this many different pages of its host on.
LEAST_PAGES = 5
BROADCAST_ROWS = 20_000

# Fixed sets of HTML: elements without content, elements whose content is not markup, elements that stand as blocks of
# text, and elements that end an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg canvas object audio video".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCK - {"tbody", "tfoot", "thead", "tr", "caption", "li", "dd", "dt", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "body", "html", "select", "menu"}
# Blocks that can be template by themselves; headings, items and cells only go with what holds them.
TEMPLATE = BLOCK - set("h1 h2 h3 h4 h5 h6 hgroup li dd dt tr tbody tfoot thead caption legend summary body html".split())
# Surroundings: elements, roles, and words of class or id.
AROUND = set("nav footer aside form select dialog menu search head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe signup login comment comments commentlist respond disqus sidebar side rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar share sharing social related recommended recommendations pagination pager skip toolbar tags tagcloud".split()
)
# Words that say what kind of box something is, and decide nothing by themselves; and those whose blocks never hold the story.
NEUTRAL = set("user users reader readers visitor list box boxes section area block wrapper wrap container inner outer item items panel unit slot zone module bar form feed top bottom left right main".split())
NEVER = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe comment comments commentlist respond disqus "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager sharing".split()
)
# A quote opens a value only behind an equals sign, as HTML has it.
_VALUE = r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{_VALUE})*)>?", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
_NAME = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "around", "named", "never")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children = tag, []
        self.attrs = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(attrs) if k.lower() in ("class", "id", "role")] if attrs else []
        # surroundings by element or role; by class or id; and whether that is of a kind that never holds the story
        self.around, self.named, self.never = tag in AROUND, False, False
        for k, v in self.attrs:
            v = v.lower()
            if k == "role":
                self.around |= v in ROLES
            elif tag not in ("body", "html", "main"):
                for words in map(_NAME.findall, v.split()):
                    if _is_around(words):
                        self.named = True
                        self.never |= not NEVER.isdisjoint(words)


def _is_around(words: list[str]) -> bool:
    """Whether a class is made of such words alone: cookie-notice and comment-list are, has-sidebar and article-header are not."""
    return not WORDS.isdisjoint(words) and all(w in WORDS or w in NEUTRAL for w in words)


class _Open:
    """The open elements, innermost last, with the places of each tag among them, so that what a tag ends is found at once."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def innermost(self, tags) -> int:
        """The place of the innermost open element of tags; 0, the root's, if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        """Ends the element at a place and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def close(self, tags: set, stop: set) -> None:
        """Ends the innermost open element of tags, if none of stop lies further in; again while it is directly inside another."""
        at = self.innermost(tags)
        if at and at > self.innermost(stop):
            self.cut(at)
            while len(self.nodes) > 1 and self.nodes[-1].tag in tags:
                self.cut(len(self.nodes) - 1)


def parse(page: str) -> Node:
    """A tree with the end tags that HTML leaves out; end tags without a start are ignored."""
    root = Node("html")
    open_ = _Open(root)
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            open_.nodes[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            open_.nodes[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            if place := open_.innermost((tag,)):
                open_.cut(place)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            # one that never ends holds the rest, but for a title
            at = end.end() if end else at if tag == "title" or _EMPTY.search(m[3]) else len(page)
            continue
        if tag in CLOSES_P or tag == "p":
            open_.close({"p"}, {"body", "html", "td", "th", "button"})
        if tag in SIBLINGS:
            open_.close(SIBLINGS[tag], SCOPE - SIBLINGS[tag])
        if tag == "body":
            open_.close({"head"}, set())
        node = Node(tag, m[3])
        open_.nodes[-1].children.append(node)
        if tag not in VOID and not _EMPTY.search(m[3]):
            open_.push(node)
    return root


def _masses(root: Node) -> dict[int, tuple[int, int]]:
    """Characters of text in every element outside surroundings, and those of them that are links, by the element's id()."""
    out: dict[int, tuple[int, int]] = {}
    for n in reversed(_downward(root, around=False)):
        text = links = 0
        for c in n.children:
            if isinstance(c, Node):
                t, a = out.get(id(c), (0, 0)) if not c.never else (0, 0)
                text, links = text + t, links + a
            else:
                text += len(c.strip())
        out[id(n)] = (text, text if n.tag == "a" else links)
    return out


def _outermost(root: Node, wanted, hidden: bool) -> list[Node]:
    found, open_ = [], [root]
    while open_:
        n = open_.pop()
        if n.around or n.named and not hidden:
            continue
        if wanted(n):
            found.append(n)
        else:
            open_ += [c for c in reversed(n.children) if isinstance(c, Node)]
    return found


def mains(node: Node) -> list[Node]:
    """The elements that hold the story: outermost articles, or main elements where those hold more than twice their text, as
    where articles are teasers; those that only a class hides if there are no others; else none. Of several articles those
    that are mostly links are left out. Without any text the first kind found counts."""
    masses: dict = {}
    for hidden in (False, True):
        articles = _outermost(node, lambda n: n.tag == "article", hidden)
        main = _outermost(node, lambda n: n.tag == "main" or ("role", "main") in n.attrs, hidden)
        if not articles or not main and len(articles) < 2:
            if found := articles or main:
                return found
            continue
        masses = masses or _masses(node)
        of = lambda ns, k: sum(masses.get(id(n), (0, 0))[k] for n in ns)
        told = [n for n in articles if 3 * of([n], 1) <= 2 * of([n], 0)] or articles
        return main if main and of(main, 0) > 2 * of(told, 0) else told
    return []


def _downward(root: Node, around: bool = True) -> list[Node]:
    """root and all elements in it, each before what it holds; without around none that is surroundings by itself."""
    out, open_ = [], [root]
    while open_:
        n = open_.pop()
        out.append(n)
        open_ += [c for c in n.children if isinstance(c, Node) and (around or not c.around)]
    return out


def text_sizes(root: Node) -> dict[int, int]:
    """Characters of text in every element, by its id(), without elements that are surroundings by themselves."""
    out: dict[int, int] = {}
    for n in reversed(_downward(root, around=False)):
        out[id(n)] = sum(out.get(id(c), 0) if isinstance(c, Node) else len(c.strip()) for c in n.children)
    return out


def subtree_hashes(root: Node) -> dict[int, int]:
    """A 64-bit hash of every element with text, by the element's id()."""
    out: dict[int, int] = {}
    for n in reversed(_downward(root)):
        parts = [n.tag.encode()]
        for c in n.children:
            if isinstance(c, Node):
                if id(c) in out:
                    parts.append(out[id(c)].to_bytes(8, "little", signed=True))
            elif c.strip():
                parts.append(b"\0" + " ".join(c.split()).encode("utf-8", "replace"))
        if len(parts) > 1:
            out[id(n)] = int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)
    return out


def recurring(tops: list[Node], hashes: dict[int, int], template: frozenset) -> list[Node]:
    """The outermost blocks below tops that are template."""
    found, open_ = [], [c for n in tops for c in n.children if isinstance(c, Node)]
    while open_:
        n = open_.pop()
        if n.tag in TEMPLATE and hashes.get(id(n)) in template:
            found.append(n)
        elif not n.around:
            open_ += [c for c in n.children if isinstance(c, Node)]
    return found


def _titled(header: Node) -> bool:
    """Whether a header without an article holds the story's title: a first heading that is no link, and no navigation."""
    inside = _downward(header)[1:]
    heads = [n for n in inside if n.tag == "h1"]
    return bool(heads) and not any(n.around for n in inside) and not any(c.tag == "a" for h in heads for c in _downward(h))


def main_text(page: str, template: frozenset = frozenset()) -> str:
    root = parse(page)
    own = mains(root)
    tops = own or [root]
    sizes: dict[int, int] = {}
    for n in tops:
        sizes |= text_sizes(n)
    whole = sum(sizes[id(n)] for n in tops)
    gone = recurring(tops, subtree_hashes(root), template) if template else []
    if own and 2 * sum(sizes.get(id(n), 0) for n in gone) > whole:
        gone = []
    dropped = {id(n) for n in gone}
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    def gone_from(n: Node, parent: Node) -> bool:
        if n.around or id(n) in dropped or n.tag == "header" and not own and not _titled(n):
            return True
        if n.tag == "button":
            # one that stands in a sentence is read with it
            return not any(isinstance(c, str) and c.strip() for c in parent.children)
        # a class word does not take all of the text, nor, unless it is of a certain kind, most of it
        size = sizes.get(id(n), 0)
        return n.named and (size < whole if n.never else 2 * size <= whole)

    for top in tops:
        # a block that ends leaves None behind it
        ahead: list = [(top, top)]
        while ahead:
            n, parent = ahead.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                line.append(n)
            elif n is top or not gone_from(n, parent):
                if n.tag in BLOCK:
                    flush()
                    ahead.append((None, n))
                elif n.tag in ("br", "td", "th"):
                    line.append(" ")
                ahead += [(c, n) for c in reversed(n.children)]
        flush()
    return "\n".join(blocks)


def _texts(kind: str):
    def run(batches):
        for batch in pieces(batches, "html"):
            known = batch.column("template").to_pylist()
            texts = [main_text(page or "", frozenset(t or ())) for page, t in zip(batch.column("html").to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return run


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, h1, h2, template): for each different page that has some, the hashes of its subtrees that are the host's template.

    pages has (host, html); h1 and h2 name a page. A subtree is template if it occurs in at least least_pages different articles
    or, on pages without one, pages of the host. A page's list holds no more hashes than the page has elements.
    """
    different = pages.select("host", "html", *_page_keys())
    listed = different.mapInArrow(_page_hashes, "host string, h1 long, h2 long, whole long, subtrees array<long>").select("host", "h1", "h2", "whole", F.explode("subtrees").alias("subtree"))
    listed = written(listed.distinct(), "html-subtrees")
    counts = listed.select("host", "subtree", "whole").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    hits = listed.join(hinted(counts.select("host", "subtree"), BROADCAST_ROWS), ["host", "subtree"])
    return hits.groupBy("host", "h1", "h2").agg(F.collect_set("subtree").alias("template"))


def _page_keys() -> tuple:
    return F.xxhash64("html").alias("h1"), F.xxhash64(F.lit(4), "html").alias("h2")


def _page_hashes(batches):
    for batch in pieces(batches, "html"):
        rows, wholes = [], []
        for page, h in zip(batch.column("html").to_pylist(), batch.column("h1").to_pylist(), strict=True):
            root = parse(page or "")
            own, hashes = mains(root), subtree_hashes(root)
            found, open_ = set(), [c for n in own or [root] for c in n.children if isinstance(c, Node)]
            while open_:
                n = open_.pop()
                if n.around:
                    continue
                if n.tag in TEMPLATE and id(n) in hashes:
                    found.add(hashes[id(n)])
                open_ += [c for c in n.children if isinstance(c, Node)]
            rows.append(sorted(found))
            whole = hashlib.blake2b(b"".join(hashes.get(id(n), 0).to_bytes(8, "little", signed=True) for n in own), digest_size=8)
            wholes.append(int.from_bytes(whole.digest(), "little", signed=True) if own else h)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("host", "h1", "h2")), pa.array(wholes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["host", "h1", "h2", "whole", "subtrees"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Blocks of text in page order, one a line. A null html is empty; a null url belongs to a host of its own name; a page
    without article, main or other text has an empty text. Repeated rows have a row each. Other columns are left out.
    """
    own = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"))
    known = written(templates(own.select("host", "html"), least_pages), "html-templates")
    kind = dict(pages.dtypes)["page_id"]
    rows = own.select("*", *_page_keys()).join(known.hint("merge"), ["host", "h1", "h2"], "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_texts(kind), f"page_id {kind}, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_text": op4_html_text}
