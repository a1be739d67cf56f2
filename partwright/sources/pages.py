"""Facts out of fetched HTML pages: title, meta, links, images, definition pairs, JSON-LD."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "tr", "dd", "dt", "br"}
_CHROME = {"nav", "footer", "header", "aside"}


class _Page(HTMLParser):
    """Collects (fact, name, value) rows in the order they stand on the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.facts: list[tuple[str, str, str]] = []
        self.skip = self.chrome = 0
        self.text: list[str] = []
        self.title: list[str] | None = None
        self.ld: list[str] | None = None
        self.anchor: list | None = None
        self.cell: list[str] | None = None
        self.row: list[str] = []
        self.term = ""
        self.define: tuple[str, list[str]] | None = None

    def block(self):
        t = " ".join("".join(self.text).split())
        self.text = []
        if t and not self.chrome:
            self.facts.append(("text", "", t))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld = []
        elif tag in _SKIP:
            self.skip += 1
        elif tag in _CHROME:
            self.block()
            self.chrome += 1
        elif tag == "title":
            self.title = []
        elif tag == "meta" and (a.get("name") or a.get("property")) and a.get("content"):
            self.facts.append(("meta", (a.get("name") or a["property"]).lower(), a["content"].strip()))
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and a.get("href"):
            self.facts.append(("canonical", "", a["href"].strip()))
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"].strip(), []]
        elif tag in ("img", "source") and (a.get("src") or a.get("srcset")):
            self.facts.append(("image", a.get("alt", "").strip(), (a.get("src") or a["srcset"].split(",")[0].split()[0]).strip()))
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "tr":
            self.row = []
        elif tag in ("dt", "dd"):
            self.define = (tag, [])
        if tag in _BLOCKS:
            self.block()

    def handle_endtag(self, tag):
        if tag == "script" and self.ld is not None:
            self.facts.append(("json_ld", "", "".join(self.ld).strip()))
            self.ld = None
        elif tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _CHROME:
            self.text = []
            self.chrome = max(0, self.chrome - 1)
        elif tag == "title" and self.title is not None:
            self.facts.append(("title", "", " ".join("".join(self.title).split())))
            self.title = None
        elif tag == "a" and self.anchor:
            self.facts.append(("link", " ".join("".join(self.anchor[1]).split()), self.anchor[0]))
            self.anchor = None
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr":
            if len(self.row) == 2 and all(self.row):
                self.facts.append(("pair", self.row[0].rstrip(":"), self.row[1]))
            self.row = []
        elif tag in ("dt", "dd") and self.define:
            t = " ".join("".join(self.define[1]).split())
            if tag == "dt":
                self.term = t
            elif self.term and t:
                self.facts.append(("pair", self.term.rstrip(":"), t))
            self.define = None
        if tag in _BLOCKS:
            self.block()

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        elif self.title is not None:
            self.title.append(data)
        elif not self.skip:
            for part in (self.cell, self.define[1] if self.define else None, self.anchor[1] if self.anchor else None):
                if part is not None:
                    part.append(data)
            self.text.append(data)


def page_facts(html: str) -> list[tuple[str, str, str]]:
    """All facts of a page; of JSON-LD every scalar of its product nodes as ``product`` with its path."""
    page = _Page()
    page.feed(html)
    page.close()
    page.block()
    out = list(page.facts)

    def walk(top) -> None:
        todo = [(top, "")]
        while todo:
            node, path = todo.pop()
            if isinstance(node, list):
                todo += [(x, path) for x in reversed(node)]
            elif isinstance(node, dict):
                todo += [(v, f"{path}.{k}" if path else str(k)) for k, v in reversed(node.items())]
            elif node is not None:
                out.append(("product", path, str(node).strip()))

    def products(top) -> None:
        todo = [top]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += reversed(node)
            elif isinstance(node, dict):
                kinds = node.get("@type")
                if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                    walk({k: v for k, v in node.items() if not k.startswith("@")})
                else:
                    todo.append(node.get("@graph"))

    for kind, _, text in page.facts:
        if kind == "json_ld":
            try:
                products(json.loads(text))
            except (ValueError, RecursionError):  # no JSON text, or nested deeper than the parser goes
                continue
    return out


def html_facts(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per fact: key, ``place``, ``fact``, ``name``, ``value``.

    Null and empty pages give none; broken mark-up gives what can be read.  One Arrow pass, no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, i, *f) for k, h in zip(pdf["_key"], pdf["_html"]) for i, f in enumerate(page_facts(h), 1)]
            yield pd.DataFrame(rows, columns=["_key", "place", "fact", "name", "value"])

    pages = df.filter(F.length(html) > 0).select(F.col(key).alias("_key"), F.col(html).alias("_html"))
    return pages.mapInPandas(run, f"_key {kind}, place int, fact string, name string, value string").withColumnRenamed("_key", key)
