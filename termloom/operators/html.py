"""Title, text, headlines, links and robots directives of HTML pages, by one Arrow-batched parse per page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINKS = {"a": "href", "frame": "src", "iframe": "src"}
_REFERENCES = {"img": "src", "input": "src", "link": "href", "script": "src", "applet": "code"}
_BLANKS = re.compile(r"\s+")
PAGE = "title string, text string, headlines array<string>, base string, links array<string>, refs array<string>, robots array<string>"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.text: list[str] = []
        self.headlines: list[list[str]] = []
        self.links: list[str] = []
        self.refs: list[str] = []
        self.robots: list[str] = []
        self.base: str | None = None
        self.skipped = 0
        self.in_title = self.in_head = False
        self.open_headline = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "noscript", "style"):
            self.skipped += 1
        if tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "title":
            self.in_title = True
        elif tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"]
        elif tag == "meta" and a.get("name", "").lower() == "robots":
            self.robots += [w.strip().upper() for w in a.get("content", "").split(",") if w.strip()]
        elif re.fullmatch("h[1-6]", tag):
            self.headlines.append([])
            self.open_headline = True
        if tag in _LINKS and a.get(_LINKS[tag]):
            self.links.append(a[_LINKS[tag]])
        elif tag in _REFERENCES and a.get(_REFERENCES[tag]):
            self.refs.append(a[_REFERENCES[tag]])

    def handle_endtag(self, tag):
        if tag in ("script", "noscript", "style"):
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        elif re.fullmatch("h[1-6]", tag):
            self.open_headline = False

    def handle_data(self, data):
        if self.skipped:
            return
        if self.in_title:
            self.title.append(data)
        elif not self.in_head:
            self.text.append(data)
            if self.open_headline:
                self.headlines[-1].append(data)


def _joined(parts: list[str]) -> str:
    return _BLANKS.sub(" ", " ".join(parts)).strip()


def absolute(base: str, links: list[str]) -> list[str]:
    """Absolute URIs without fragments, in order, each once; what can't be resolved is left out."""
    out: dict[str, None] = {}
    for link in links:
        try:
            uri = urldefrag(urljoin(base, link.strip()))[0]
        except ValueError:
            continue
        if uri:
            out[uri] = None
    return list(out)


def parse_page(url: str | None, html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    base = urljoin(url or "", page.base or "") or (url or "")
    return {
        "title": _joined(page.title),
        "text": _joined(page.text),
        "headlines": [h for h in map(_joined, page.headlines) if h],
        "base": base,
        "links": absolute(base, page.links),
        "refs": absolute(base, page.refs),
        "robots": page.robots,
    }


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """url, the kept columns, and title, text, headlines, base, links, refs, robots. Null pages are empty ones."""
    rows = pages.select(F.col(url).alias("url"), *keep, F.col(html).alias("html"))
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = pd.DataFrame([parse_page(u, h) for u, h in zip(f["url"], f["html"])], columns=[c.split()[0] for c in PAGE.split(", ")])
            yield pd.concat([f.drop(columns="html").reset_index(drop=True), parsed], axis=1)

    return rows.mapInPandas(run, "url string, " + (kept + ", " if kept else "") + PAGE)


def indexable(parsed: DataFrame) -> DataFrame:
    """Pages not marked NOINDEX."""
    return parsed.where(~F.array_contains("robots", "NOINDEX"))


def followed_links(parsed: DataFrame) -> DataFrame:
    """url, link of the pages not marked NOFOLLOW."""
    return parsed.where(~F.array_contains("robots", "NOFOLLOW")).select("url", F.explode("links").alias("link"))


def title_or_name(title: str = "title", url: str = "url"):
    """The title, else the last path segment of the URL."""
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1))


def page_documents(parsed: DataFrame, contexts: tuple[str, ...] = ("title", "text", "headlines"), limit: int | None = None) -> DataFrame:
    """Ingest records of pages: contexts hold letters and digits only, descriptions the text; empty contexts are left out."""
    from termloom.functions.text import alnum_only, limit_length

    as_text = {c: F.array_join(c, " ") if c == "headlines" else F.col(c) for c in contexts}
    shown = {c: limit_length(t, limit) if limit else t for c, t in as_text.items()}
    quoted = lambda t: F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    filled = lambda values: F.map_filter(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]), lambda _, v: (v != "") & (v != '""'))
    return parsed.select(
        F.col("url").alias("uri"),
        filled({c: alnum_only(t) for c, t in as_text.items()}).alias("index"),
        filled({c: quoted(t) for c, t in shown.items()}).alias("description"),
        F.lit(None).cast("double").alias("weight"),
    )
