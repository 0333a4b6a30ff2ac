"""Main text of web pages by site template removal.

Pass 1 parses each page, hashes the subtrees of its elements (tag, class, text and children) and counts them per host in Spark: a
subtree found beside many different bodies of a host is part of the site's template. A page's body is told by its three longest blocks, so
copies of an article count once and do not make their own text a template. Pass 2 parses again, deletes those subtrees and the elements
that are never article text, and joins what is left: of the article or main elements where they hold a third of it or more, else of
the page.
"""

from __future__ import annotations

import heapq
import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import settle

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("head script style noscript template nav footer aside form iframe object svg math canvas button select textarea dialog menu audio video".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre a b i em strong span code q cite sub sup small mark figcaption caption tr tbody".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CHROME = frozenset(
    "ad ads advert advertisement adverts advertising sponsored sponsor promo promotion banner cookie cookies consent notice notices alert sidebar "
    "menu menus navbar navigation nav breadcrumb breadcrumbs footer masthead comment comments discussion respond replies disqus newsletter "
    "subscribe subscription share sharing social related recommended popup modal overlay widget widgets pagination pager toolbar login signup".split())
ARTICLE_CHROME = frozenset("ad comment related sponsored teaser teasers".split())
# Start tags that end an open element of the same kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSES_P = BLOCK - {"br", "html", "head", "body", "title", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
MODIFIERS = frozenset("no not has with without is".split())  # "no-sidebar" tells of a page without one
_WORDS = re.compile(r"[a-z0-9]+")
SHARE, LEAST = 0.3, 5  # a template subtree is beside this share of a host's bodies, and beside so many at least
MAIN_SHARE = 3  # articles and main elements with less than one part in three of the text left are teasers


def told_by_class(tag: str, names: str) -> bool:
    """Whether the words of an element's class and id tell of something around an article."""
    if tag in ("html", "body", "main"):
        return False
    parts = [_WORDS.findall(n) for n in names.split()]
    words = {w for p in parts if p and p[0] not in MODIFIERS for w in p}
    return not words.isdisjoint(ARTICLE_CHROME if tag == "article" else CHROME)


class Node:
    __slots__ = ("tag", "label", "chrome", "children", "hash")

    def __init__(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')}".lower()
        self.tag, self.label, self.children, self.hash = tag, f"{tag}.{given.get('class', '')}", [], 0
        self.chrome = (
            tag in NEVER or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            or bool(names.strip()) and told_by_class(tag, names))


class Tree(HTMLParser):
    """A tree of a page, however broken: an end tag closes up to its element, and what is open at the end is closed there."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", [])
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._end("p", BLOCK - {"p"})
        if tag in ENDS:
            self._end_any(ENDS[tag], FENCE[tag])
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end(tag, frozenset() if tag in BLOCK else BLOCK - {"br"})

    def _end(self, tag: str, fence: frozenset) -> None:
        self._end_any({tag}, fence)

    def _end_any(self, tags: set, fence) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in fence:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    return Tree(html or "").root


def _walk(root: Node):
    """Nodes, children before parents, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    return reversed(out)


def hash_subtrees(root: Node) -> None:
    """Set each node's hash; 0 for a subtree without text."""
    for node in _walk(root):
        parts, full = [node.label], False
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"<{c.hash}>")
                full = full or c.hash != 0
            elif text := " ".join(c.split()):
                parts.append(text)
                full = True
        node.hash = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) if full else 0


def _mains(root: Node) -> list[Node]:
    """The outermost articles that lie in no chrome; else the outermost main elements."""
    articles, mains, todo = [], [], [(root, False)]
    while todo:
        node, in_main = todo.pop()
        if node.chrome:
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" and not in_main:
            mains.append(node)
        todo.extend((c, in_main or node.tag == "main") for c in reversed(node.children) if isinstance(c, Node))
    return articles or mains


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def template_candidates(root: Node) -> set[int]:
    """Hashes of the subtrees that may be template: elements around the text, and blocks of it that no article or main element holds."""
    out, mains = set(), {id(m) for m in _mains(root)}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        main = id(node) in mains
        if node.hash and node.tag not in ("", "html", "body", "head", "title", "script", "style") and not main and not (inside and node.tag in PROSE):
            out.add(_signed(node.hash))
        todo.extend((c, inside or main) for c in node.children if isinstance(c, Node))
    return out


def body(root: Node) -> int:
    """Hash of the three elements outside chrome with the most text of their own (three, as one or two may be template); 0 without text."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.chrome:
            continue
        if size := sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace()):
            found.add((size, node.hash))
        todo.extend(c for c in node.children if isinstance(c, Node))
    most = "\x1f".join(str(h) for _, h in heapq.nlargest(3, found))
    return _signed(xxhash.xxh64_intdigest(most)) if most else 0


def _left(starts: list[Node], mains: list[Node], template: set[int]) -> str:
    """The text of `starts` without chrome and template subtrees, in page order. Inside `mains`, prose is no template."""
    parts: list[str] = []
    held = {id(m) for m in mains}
    todo: list = [(x, False) for x in reversed(starts)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        main = id(x) in held
        inside = inside or main
        if x.chrome or x.tag == "header" and not inside or x.tag == "title":
            continue
        if x.hash and _signed(x.hash) in template and not main and not (inside and x.tag in PROSE):
            continue
        if x.tag in BLOCK:
            parts.append(" ")
            todo.append((" ", inside))
        todo.extend((c, inside) for c in reversed(x.children))
    return " ".join("".join(parts).split())


def main_text(root: Node, template: set[int]) -> str:
    """The text left of the article or main elements where it is a third of what is left of the page or more; else all that is left."""
    mains = _mains(root)
    whole = _left([root], mains, template)
    part = _left(mains, mains, template)
    return part if mains and MAIN_SHARE * len(part) >= len(whole) else whole


def _count(batches):
    for batch in batches:
        hosts, hashes, bodies = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(html)
            hash_subtrees(root)
            own = [None, *template_candidates(root)]
            hashes.extend(own)
            hosts.extend([host] * len(own))
            bodies.extend([body(root)] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(bodies, pa.int64())], names=["host", "subtree", "body"])


def _extract(batches):
    for batch in batches:
        texts = []
        for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
            root = parse(html)
            hash_subtrees(root)
            texts.append(main_text(root, set(template or ())).encode("utf-8", "replace").decode())
        keep = ["page_id", "url"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, template): hashes of subtrees beside at least `share` of a host's different bodies, and `least` of them.

    A host's list is bounded by the mean number of subtrees of its bodies over `share`, however many pages it has. A subtree
    counts once a body; rows are dealt by host, subtree and body first and combined before the second shuffle, so a host with a
    third of all pages is no hot key. The row without subtree counts the host's bodies.
    """
    found = _pages(pages).select("host", "html").mapInArrow(_count, "host string, subtree long, body long").distinct()
    counts = settle(found.groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("subtree").isNull()))
    sizes = counts.where("subtree IS NULL").select("host", F.col("n").alias("bodies"))
    many = counts.where("subtree IS NOT NULL").join(sizes, "host").where(F.col("n") >= share * F.col("bodies"))
    return many.groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(page_id, url, text): one row per row of `pages`; text is empty where the page has none.

    NULL or empty html gives the empty text; a page without url belongs to the host ''. Repeated rows are extracted each.
    White space (with no-break spaces) inside and between blocks becomes one space; character references are decoded, broken
    ones stay as they are. An empty table gives no rows. `salts` splits the pages of a host over as many keys.
    """
    own = _pages(pages)
    sets = settle(templates(pages)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    met = salted.join(sets, ["host", "salt"], "left").select("page_id", "url", "html", "template")
    return met.mapInArrow(_extract, "page_id long, url string, text string")
