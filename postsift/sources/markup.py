"""Postings inside HTML pages: embedded structured data and result cards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.functions import fixed

_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_LD_POSTING = T.StructType([
    T.StructField(name, T.StringType()) for name in ("title", "description", "url", "datePosted")])


@F.pandas_udf(_LD_POSTING)
def _first_posting(blocks: pd.Series) -> pd.DataFrame:
    """The first posting among the JSON texts of each page; lists and objects may nest as deep as they like."""
    names, rows = _LD_POSTING.names, []
    for texts in blocks:
        node = _search_posting(texts) if texts is not None else None
        found = {k: node.get(k) for k in names} if node else {}
        rows.append([
            None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)
            for v in map(found.get, names)])
    return pd.DataFrame(rows, columns=names, dtype="object")


def _search_posting(texts) -> dict | None:
    for text in texts:
        try:
            pending = [json.loads(text, strict=False)]
        except (ValueError, RecursionError):  # no JSON, or nested beyond what the reader takes: the next block counts
            continue
        while pending:
            node = pending.pop()
            if isinstance(node, list):
                pending.extend(reversed(node))
            elif isinstance(node, dict):
                if node.get("@type") == "JobPosting":
                    return node
                pending.append(node.get("@graph"))
    return None


def extract_ld_posting(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each page with its first ``JobPosting`` block as ``ld_*`` columns; null when it has none.

    Blocks are read in page order; control characters in them count as blanks. Only pages that name a posting
    inside a block leave the JVM.
    """
    blocks = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(_BLOCK), F.lit(1)), lambda b: F.regexp_replace(b, r"[\x00-\x1F]", " "))
    named = F.filter(blocks, lambda b: b.contains("JobPosting"))
    page = F.when(F.col(html).contains("ld+json"), named)
    found = pages.withColumn("_ld", _first_posting(F.when(F.size(page) > 0, page)))
    return found.withColumns({
        f"ld_{name}": F.col(f"_ld.{name}") for name in ("title", "description", "url", "datePosted")}).drop("_ld")


# --- result cards ------------------------------------------------------------------------


class _Block:
    """What has been read inside one open ``div``."""

    def __init__(self, depth: int = 0):
        self.depth, self.saved, self.heading_depth = depth, False, None
        self.title, self.link = "", ""
        self.logos, self.links, self.paragraphs, self.beside = [], [], [], []

    def take(self, inner: _Block) -> None:
        """An inner block that was no card is part of the one around it."""
        self.saved |= inner.saved
        for mine, more in zip(self._lists(), inner._lists(), strict=True):
            mine.extend(more)
        if self.heading_depth is None and inner.heading_depth is not None:
            self.heading_depth, self.title, self.link = inner.heading_depth, inner.title, inner.link
            self.beside = inner.beside

    def _lists(self):
        return self.logos, self.links, self.paragraphs


class CardReader(HTMLParser):
    """Reads a page once and emits a card whenever a ``div`` closes that holds both a heading and a save link.

    The board's own marks (the save link, what is no logo and no place) are in ``fixed``.
    """

    _VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.host = base, base.split("//")[-1].removeprefix("www.")
        self.open, self.blocks, self.cards = [], [_Block()], []
        self.texts: list[list[str]] = []  # one per open element: the text inside it

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "img" and (alt := given.get("alt", "").strip()) not in fixed.CARD_NOT_A_LOGO:
            self.blocks[-1].logos.append(alt)
        if tag in self._VOID:
            return
        self.open.append((tag, given))
        self.texts.append([])
        if tag == "div":
            self.blocks.append(_Block(len(self.open)))

    def handle_data(self, data):
        if data.strip():
            for text in self.texts:
                text.append(data.strip())

    def handle_endtag(self, tag):
        if tag in (name for name, _ in self.open):
            while self._close() != tag:
                pass

    def close(self):
        super().close()
        while self.open:
            self._close()

    def _close(self) -> str:
        (tag, given), text, depth = self.open.pop(), self.texts.pop(), len(self.open)
        block, href = self.blocks[-1], given.get("href", "")
        if tag == "div":
            self.blocks.pop()
            if block.saved and block.title:
                self.cards.append(self._card(block))
            else:
                self.blocks[-1].take(block)
        elif tag == "p" and text:
            block.paragraphs.append("".join(text))
        elif tag == "a":
            block.saved |= bool(re.search(fixed.CARD_SAVE_LINK, href))
            block.links.append((href, "".join(text)))
            if block.heading_depth is None and any(name == "h4" for name, _ in self.open):
                block.title, block.link = "".join(text), href
        elif tag == "h4" and block.heading_depth is None:
            block.heading_depth = depth
            return tag
        if block.heading_depth == depth and tag != "h4":
            block.beside.append(" ".join(text))
        return tag

    def _card(self, block: _Block) -> tuple[str, str, str, str, str]:
        action = next((h for h, t in block.links if fixed.CARD_ACTION in t.lower()), "")
        url = action or block.link
        away = (t for h, t in block.links if t and h.startswith("http") and self.host not in h)
        place = next((
            t for t in block.beside
            if t and len(t) < fixed.CARD_PLACE_LENGTH and not t.startswith(fixed.CARD_NOT_A_PLACE)), "")
        return (
            block.title, self.base + url if url.startswith("/") else url, next(iter(block.logos), None) or next(away, ""),
            place, " ".join(block.paragraphs[: fixed.CARD_PARAGRAPHS]))


def cards_of(page: str, base: str) -> list[tuple[str, str, str, str, str]]:
    """(title, url, company, location, description) of every result card of one page."""
    reader = CardReader(base)
    reader.feed(page)
    reader.close()
    return reader.cards


def parse_cards(pages: DataFrame, key: str, html: str = "html", base: str = "https://www.jobindex.dk") -> DataFrame:
    """One row per result card of every page; a nested layout has no column expression."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, i, *card)
                for k, page in zip(batch[key], batch[html])
                for i, card in enumerate(cards_of(page or "", base))
            ]
            yield pd.DataFrame(
                rows, columns=[key, "card", "title", "url", "company", "location", "description"]
            )

    kind = pages.schema[key].dataType.simpleString()
    schema = (
        f"{key} {kind}, card bigint, title string, url string, company string, "
        "location string, description string"
    )
    return pages.select(key, html).mapInPandas(read, schema)
