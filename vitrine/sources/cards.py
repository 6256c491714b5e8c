"""Cards out of listing pages: the text and picture around each link."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.sources.pages import DECORATION

#: Characters a card may have, and levels between a link and its card.
CARD_CHARS, CARD_LEVELS, PHOTO_LEVELS = 1500, 6, 4
#: The same of a rendered page's card, and characters up to which the level above a price is still the card.
RENDERED_CHARS, RENDERED_LEVELS, ABOVE_CHARS = 4000, 6, 600
# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


class _Node:
    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def text(self) -> str:
        """Visible text, a line per element."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x.tag not in ("script", "style"):
                stack += reversed(x.parts)
        return "\n".join(t for t in out if t)

    def nodes(self):
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack += reversed([p for p in x.parts if isinstance(p, _Node)])


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _photo(node: _Node, base: str) -> str | None:
    """The first picture at the link or up to some levels above: an image, a background, a path in an attribute."""
    level = 0
    while node is not None and level <= PHOTO_LEVELS:
        for x in node.nodes():
            values = [x.attrs.get(k) for k in ("data-src", "data-lazy", "data-original", "srcset", "src")] if x.tag in ("img", "source") else []
            values += re.findall(r"background-image:\s*url\(\s*['\"]?([^)'\"]+)", x.attrs.get("style") or "", re.I)
            values += [v for v in x.attrs.values() if v and re.fullmatch(r"(?:https?:)?/[^\s\"']{5,300}?\.(?:jpe?g|png|webp|avif)[^\s\"']{0,90}", v, re.I)]
            for v in filter(None, values):
                full = urljoin(base, v.split(",")[-1].strip().split(" ")[0])
                if full.startswith("http") and not re.search(DECORATION, full, re.I):
                    return full
        node, level = node.parent, level + 1
    return None


def _cards(page: str, base: str, containing: str, mark: str) -> list[tuple]:
    tree = _Tree()
    tree.feed(page)
    out: dict[str, tuple] = {}
    for link in tree.root.nodes():
        href = link.attrs.get("href") if link.tag == "a" else None
        if not href or containing not in href:
            continue
        full = urljoin(base, href)
        block, found = link, None
        for _ in range(CARD_LEVELS + 1):
            if block is None or found is not None:
                break
            text = block.text()
            if len(text) >= CARD_CHARS:
                break
            found = text if mark in text else None
            block = block.parent
        card = (full, found if found is not None else link.text(), _photo(link, base))
        if full not in out or len(card[1]) > len(out[full][1]):
            out[full] = card
    return list(out.values())


def _rendered(page: str, base: str, containing: str, mark: str) -> list[tuple]:
    tree = _Tree()
    tree.feed(page)

    def listings(node: _Node) -> set[str]:
        return {urljoin(base, x.attrs["href"]) for x in node.nodes() if x.tag == "a" and containing in (x.attrs.get("href") or "")}

    out: dict[str, tuple] = {}
    for link in tree.root.nodes():
        href = (link.attrs.get("href") or "") if link.tag == "a" else ""
        full = urljoin(base, href)
        if containing not in href or not href or full in out:
            continue
        block, text = link, link.text()
        for _ in range(RENDERED_LEVELS):
            above = block.parent
            if above is None or len(above.text()) > RENDERED_CHARS or len(listings(above)) > 1:
                break
            block, text = above, above.text()
            if mark in text:
                # What stands around a price may belong to the card as well.
                wider = block.parent
                if wider is not None and len(text) < len(wider.text()) <= ABOVE_CHARS and len(listings(wider)) <= 1:
                    text = wider.text()
                break
        out[full] = (full, text, _photo(block, base))
    return list(out.values())


def rendered_cards(pages: DataFrame, *, url: str, html: str, containing: str, mark: str = "R$") -> DataFrame:
    """``(page, href, text, photo)``: one card per listing link of a rendered page, from the link's first occurrence.

    From the link upwards, at most ``RENDERED_LEVELS`` levels and
    ``RENDERED_CHARS`` characters, to the first element that shows a price; an
    element with links to several listings is a list and no card. One level
    more is taken if it is no list and has at most ``ABOVE_CHARS`` characters.
    """
    return _read(pages, _rendered, url, html, containing, mark)


def _read(pages: DataFrame, cards, url: str, html: str, containing: str, mark: str) -> DataFrame:
    def read(urls: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([cards(t, u or "", containing, mark) if t else [] for u, t in zip(urls, texts, strict=True)])

    kind = "array<struct<href:string,text:string,photo:string>>"
    return pages.select(F.col(url).alias("page"), F.explode(F.pandas_udf(read, kind)(F.col(url), F.col(html))).alias("c")).select("page", "c.href", "c.text", "c.photo")


def page_cards(pages: DataFrame, *, url: str, html: str, containing: str, mark: str = "R$") -> DataFrame:
    """``(page, href, text, photo)``: one card per listing link.

    A card is the closest element around the link that shows a price, within
    ``CARD_LEVELS`` levels and ``CARD_CHARS`` characters, else the link's own
    text; of several cards of a link the longest stays. Null pages have none.
    """

    return _read(pages, _cards, url, html, containing, mark)
