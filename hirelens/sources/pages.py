"""Captured HTML pages: result cards, detail descriptions, query parts of the address."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from hirelens.constants import CARD_COLUMNS, DESCRIPTION_SELECTORS, EMPTY_TAGS, VERIFY_MARKS
from hirelens.functions.text import first_match, plain_text, strip, tags_or_default

ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"
ANCHOR_CARD = r'<li><a href="([^"]*)">([^<]*)</a></li>'


# --- detail pages ---------------------------------------------------------------------------

def extract_article(html: Column, patterns: list[str] | None = None) -> Column:
    """Description by regex: the first pattern with non-blank content, tags removed."""
    return plain_text(first_match(html, patterns or [ARTICLE]))


# Text, then a plain tag: quoted attributes without <, > or &. Whatever else a page holds (comments, scripts, loose <) is left to HTMLParser.
_NAME, _GAP = "[a-zA-Z][a-zA-Z0-9]*", "[ \\t\\n\\r\\f]"
_ATTRIBUTE = f"{_GAP}+[a-zA-Z][-a-zA-Z0-9_:]*=(?:\"[^\"<>&]*\"|'[^'<>&]*')"
_MARK = re.compile(f"([^<]*)<(?:/({_NAME})|({_NAME})((?:{_ATTRIBUTE})*){_GAP}*(/?))>")
_ATTRIBUTES = re.compile(f"{_GAP}+([a-zA-Z][-a-zA-Z0-9_:]*)=(?:\"([^\"<>&]*)\"|'([^'<>&]*)')")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


def _marks(html: str) -> tuple[list[tuple], str] | None:
    """(text, end tag, start tag, attributes, slash) of each tag of a page of plain tags, and the text after the last; None for other pages."""
    found, at = [], 0
    for m in iter(_MARK.scanner(html).match, None):
        found.append(m.groups())
        at = m.end()
    tail = html[at:]
    if "<" in tail or "&" in tail or any(tag and tag.lower() in _RAW for _, _, tag, _, _ in found):
        return None
    return found, tail


class _Elements(HTMLParser):
    """Keeps the open elements, (tag, classes) from the outside in; an end tag closes all inside its element."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []

    def read(self, html: str) -> None:
        """What `feed` does; pages of plain tags, which most are, are cut by one pattern and cost a fraction of it."""
        marks = _marks(html)
        if marks is None:
            self.feed(html)
            return
        known: dict = {"": ()}
        for text, end, start, attributes, slash in marks[0]:
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if end:
                self.handle_endtag(end.lower())
                continue
            if attributes not in known:  # a page says the same thing over and over
                known[attributes] = [(k.lower(), v or w) for k, v, w in _ATTRIBUTES.findall(attributes)]
            self.handle_starttag(start.lower(), known[attributes])
            if slash:
                self.handle_endtag(start.lower())
        if marks[1]:
            self.handle_data(marks[1])

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.open.append((tag, dict(attrs).get("class") or "" if attrs else ""))
            self.opened()

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            del self.open[-1]
            self.closed()
            return
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]
            self.closed()

    def opened(self):
        """The last of `open` has just been opened."""

    def closed(self):
        """`open` has become shorter."""


class _Selected(_Elements):
    """Per descendant selector of class tests, the text of the first element that matches it; one pass for all of them."""

    def __init__(self, selectors: list[list[tuple[str, bool]]]):
        super().__init__()
        self.selectors = selectors
        self.depth: list[int | None] = [None] * len(selectors)
        self.done = [False] * len(selectors)
        self.parts: list[list[str]] = [[] for _ in selectors]

    def opened(self):
        for i, steps in enumerate(self.selectors):
            if self.depth[i] is None and self._matches(steps):
                self.depth[i] = len(self.open)

    def closed(self):
        for i, depth in enumerate(self.depth):
            if depth is not None and len(self.open) < depth:
                self.done[i] = True

    def handle_data(self, data):
        for i, depth in enumerate(self.depth):
            if depth is not None and not self.done[i]:
                self.parts[i].append(data)

    def _matches(self, steps) -> bool:
        classes = [c for _, c in self.open]
        if not _passes(classes[-1], steps[-1]):
            return False
        left = list(steps[:-1])
        for c in reversed(classes[:-1]):
            if left and _passes(c, left[-1]):
                left.pop()
        return not left


def _passes(classes: str, step: tuple[str, bool]) -> bool:
    name, part = step
    return name in classes if part else name in classes.split()


def _steps(selector: str) -> list[tuple[str, bool]]:
    """'.a .b' or '[class*="x"] .b' to (class name, is a part) pairs."""
    out = []
    for word in selector.split():
        part = re.fullmatch(r'\[class\*="([^"]+)"\]', word)
        out.append((part.group(1), True) if part else (word.lstrip("."), False))
    return out


def _first_text(html: str | None, selectors: list[list[tuple[str, bool]]]) -> str:
    parser = _Selected(selectors)
    parser.read(html or "")
    return next((text for parts in parser.parts if (text := "".join(parts).strip())), "")


def extract_description(pages: DataFrame, selectors: list[str] | None = None, html: str = "html") -> DataFrame:
    """Add `description`: stripped text of the first selector that finds a non-blank element, else ''.

    Nested elements need a parser, so this runs in Arrow batches; see `extract_article` for the
    built-in form for flat pages.
    """
    steps = [_steps(s) for s in (selectors or DESCRIPTION_SELECTORS)]

    @F.pandas_udf("string")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: _first_text(page, steps))

    return pages.withColumn("description", pick(F.col(html)))


def detail_status(http_status: Column, final_url: Column, text: Column) -> Column:
    """404 is closed; another status but 200, or a redirect to verification, is failed; no text is empty."""
    redirected = F.lit(False)
    for mark in VERIFY_MARKS:
        redirected = redirected | F.coalesce(F.contains(final_url, F.lit(mark)), F.lit(False))
    return (
        F.when(http_status == 404, "closed")
        .when(F.coalesce(http_status, F.lit(0)) != 200, "failed")
        .when(redirected, "failed")
        .when(strip(F.coalesce(text, F.lit(""))) == "", "empty")
        .otherwise("ok")
    )


# --- result pages ---------------------------------------------------------------------------

class _Cards(_Elements):
    """The cards of a result page: texts of their fields, wherever in the card and in whatever element they stand."""

    CARD, TAG = "joblist-box__item", "joblist-box__item-tag"
    FIRST = {"jobinfo__name": "name", "companyinfo__name": "company", "jobinfo__salary": "salary"}
    BLOCKS = {"jobinfo__tag": "tags", "companyinfo__tag": "company_tags"}

    def __init__(self):
        super().__init__()
        self.cards: list[dict] = []
        self.inside: list[tuple[str, int]] = []  # card and tag blocks that are open, with their depth
        self.taking: list[tuple[list[str], int]] = []  # texts that are being read, with the depth of their element

    def opened(self):
        depth, classes = len(self.open), self.open[-1][1].split()
        if not classes:
            return
        if self.CARD in classes:
            self.cards.append({"name": None, "company": None, "salary": None, "card_info": [], "tags": None, "company_tags": None})
            self.inside.append(("card", depth))
        if not self.inside:  # a card comes first there and goes last
            return
        card = self.cards[-1]
        for cls in classes:
            if cls in self.FIRST and card[self.FIRST[cls]] is None:
                card[self.FIRST[cls]] = self._take(depth)
            elif cls == "jobinfo__other-info-item":
                card["card_info"].append(self._take(depth))
            elif cls in self.BLOCKS and card[self.BLOCKS[cls]] is None:
                card[self.BLOCKS[cls]] = []
                self.inside.append((self.BLOCKS[cls], depth))
            elif cls == self.TAG:
                for kind in {k for k, _ in self.inside} - {"card"}:
                    card[kind].append(self._take(depth))

    def _take(self, depth: int) -> list[str]:
        self.taking.append(([], depth))
        return self.taking[-1][0]

    def closed(self):
        for held in (self.inside, self.taking):  # depths ascend
            while held and held[-1][1] > len(self.open):
                del held[-1]

    def handle_data(self, data):
        for parts, _ in self.taking:
            parts.append(data)


def _text(parts: list[str] | None) -> str | None:
    return None if parts is None else " ".join(" ".join(parts).split())


def _cards(html: str | None) -> list[dict]:
    parser = _Cards()
    parser.read(html or "")
    many = lambda found: [_text(p) for p in found or []]
    return [
        {k: many(v) if k in ("card_info", "tags", "company_tags") else _text(v) for k, v in card.items()}
        for card in parser.cards if card["name"] is not None and card["company"] is not None and card["salary"] is not None]


CARD_TYPE = "array<struct<name: string, company: string, salary: string, card_info: array<string>, tags: array<string>, company_tags: array<string>>>"


def extract_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per card of a result page under the published column names.

    A card without a name, a company or a salary element is dropped; the other fields get defaults. Tags are the tag elements
    anywhere in the first tag block, whatever their element. Elements nest, so this runs in Arrow batches.
    """

    keep = [c for c in pages.columns if c != html]
    schema = pages.select(*keep).schema.add("_card", StructType.fromDDL(f"c {CARD_TYPE}")["c"].dataType.elementType)
    kind = to_arrow_type(schema["_card"].dataType)

    def find(batches):
        for batch in batches:
            found = [_cards(page) for page in batch.column(html).to_pylist()]
            at = pa.array([i for i, cards in enumerate(found) for _ in cards], pa.int64())
            kept = [batch.column(c).take(at) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for cards in found for c in cards], kind)], names=[*keep, "_card"])

    cards = pages.select(*keep, html).mapInArrow(find, schema)
    fields = split_card_info(cards.select(*keep, "_card", F.col("_card.card_info").alias("card_info")))
    name, company, salary, need, place, tags, firm = CARD_COLUMNS
    return fields.select(
        *keep,
        F.col("_card.name").alias(name),
        F.col("_card.company").alias(company),
        F.col("_card.salary").alias(salary),
        F.col("requirement").alias(need),
        F.col("location").alias(place),
        tags_or_default(F.col("_card.tags"), EMPTY_TAGS).alias(tags),
        tags_or_default(F.col("_card.company_tags"), EMPTY_TAGS).alias(firm),
    )


def extract_anchor_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cards of a plain link list: (name, link) of each list item, with its place in the page."""
    found = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(ANCHOR_CARD), 0),
        lambda card: F.struct(
            F.regexp_extract(card, ANCHOR_CARD, 1).alias("link"), F.trim(F.regexp_extract(card, ANCHOR_CARD, 2)).alias("name")),
    )
    return pages.select(
        *[c for c in pages.columns if c != html], F.posexplode(found).alias("pos_in_page", "_card"),
    ).select("*", "_card.name", "_card.link").drop("_card")


def split_card_info(df: DataFrame, info: str = "card_info") -> DataFrame:
    """Info items by place: location, experience, education; a missing one is ''; requirement = "exp,edu"."""
    item = lambda i: F.coalesce(F.get(F.col(info), F.lit(i)), F.lit(""))
    named = df.withColumns({"location": item(0), "experience": item(1), "education": item(2)})
    return named.withColumn("requirement", F.concat_ws(",", "experience", "education"))


def default_text(df: DataFrame, cols: list[str], text: str = EMPTY_TAGS) -> DataFrame:
    """Fill NULL or blank fields with the marker for "none"."""
    return df.withColumns({c: F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", text).otherwise(F.col(c)) for c in cols})


# --- addresses ------------------------------------------------------------------------------

def parse_query(df: DataFrame, url: str = "url", names: dict[str, str] | None = None) -> DataFrame:
    """Region, keyword and page number out of the query part of a result-page address.

    `names` maps region, keyword, page_no to the parameters that hold them.
    """
    names = names or {"region": "jl", "keyword": "kw", "page_no": "p"}
    part = lambda key: F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(names[key]))
    return df.withColumns({"region": part("region"), "keyword": part("keyword"), "page_no": part("page_no").try_cast("int")})


def page_range(df: DataFrame, start: int, last: int) -> DataFrame:
    """Pages start..last, both included."""
    return df.where(F.col("page_no").between(start, last))
