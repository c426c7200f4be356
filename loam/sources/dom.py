"""Fields of an HTML page: title, metadata, headings, blocks, tables, lists, links. Standard library only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least lengths of a content block and a list item; the part of a block that is looked for in others.
LEAST_BLOCK, LEAST_ITEM, BLOCK_HEAD = 30, 10, 50

_SKIP = {"script", "style", "noscript", "template", "svg"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCKS = {"p", "article", "section", "main", "div", "li", "td", "blockquote"}
SCHEMA = "title string, description string, keywords string, headings array<struct<level:int,text:string,id:string>>, blocks array<string>, tables array<array<array<string>>>, lists array<array<string>>, links array<struct<href:string,text:string>>"


def _squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


class _Reader(HTMLParser):
    def __init__(self, strip_footer: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped = _SKIP | ({"footer"} if strip_footer else set())
        self.skip = 0
        self.open: list[tuple[str, list[str], dict]] = []
        self.title, self.meta = "", {}
        self.headings, self.blocks, self.tables, self.lists, self.links = [], [], [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = {k: v or "" for k, v in attrs}
        if tag in self.skipped:
            self.skip += 1
        elif tag == "meta":
            self.meta.setdefault(held.get("name", "").lower(), held.get("content", ""))
        elif tag == "table" and not self.skip:
            self.tables.append([])
        elif tag == "tr" and self.tables and not self.skip:
            self.tables[-1].append([])
        elif tag in ("ul", "ol") and not self.skip:
            self.lists.append([])
        if tag not in _VOID:
            self.open.append((tag, [], held))

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, parts, _a in self.open:
                parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            self.skip = max(0, self.skip - 1)
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        while len(self.open) > at:
            name, parts, held = self.open.pop()
            self._close(name, _squeeze("".join(parts)), held)

    def _close(self, tag: str, text: str, held: dict) -> None:
        if tag == "title" and not self.title:
            self.title = text
        elif re.fullmatch("h[1-6]", tag) and text:
            self.headings.append((int(tag[1]), text, held.get("id") or None))
        elif tag == "a" and held.get("href"):
            self.links.append((held["href"], text))
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(text)
        elif tag == "li" and self.lists and len(text) > LEAST_ITEM:
            self.lists[-1].append(text)
        if tag in _BLOCKS and len(text) > LEAST_BLOCK and not any(text[:BLOCK_HEAD] in b for b in self.blocks):
            self.blocks.append(text)


def read_page(html: str | None, strip_footer: bool = True) -> tuple:
    """The fields of SCHEMA; broken markup is read as far as it goes."""
    r = _Reader(strip_footer)
    r.feed(html or "")
    r.close()
    while r.open:
        r.handle_endtag(r.open[-1][0])
    return (r.title, r.meta.get("description"), r.meta.get("keywords"), r.headings, r.blocks, [t for t in ([row for row in t if row] for t in r.tables) if t], [x for x in r.lists if x], r.links)


def with_defaults(pages: DataFrame) -> DataFrame:
    """Extracted fields with nulls replaced: texts by '', lists by empty ones."""
    kinds = {f.name: f.dataType for f in pages.schema.fields}
    fill = lambda c: F.coalesce(F.col(c), F.lit("") if kinds[c].simpleString() == "string" else F.array().cast(kinds[c]))
    return pages.withColumns({c: fill(c) for c in (p.split(" ")[0] for p in SCHEMA.split(", ")) if c in kinds})


def extract(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, fields of SCHEMA) of HTML texts."""
    names = [p.split(" ")[0] for p in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [dict(zip(names, read_page(h))) for h in b["h"]]
            for x in rows:
                x["headings"] = [{"level": n, "text": t, "id": i} for n, t, i in x["headings"]]
                x["links"] = [{"href": a, "text": t} for a, t in x["links"]]
            yield pd.DataFrame([{"k": k} | x for k, x in zip(b["k"], rows)], columns=["k", *names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)
