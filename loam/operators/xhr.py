"""Captured responses: filters, items, and text fragments."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.dates import DATE_KEYS
from loam.functions.text import PY_WS
from loam.operators.shred import clean, parse

# Urls whose responses are ignored; keys of item lists; limits of fragments.
IGNORED = ("translation.json", "frontendlive", "trigger-count", "/locales/", "/i18n")
LIST_KEYS = ("data", "results", "items", "records", "list")
DEEPEST, WIDEST, LONGEST, MOST = 6, 50, 400, 60

_WS = re.compile(f"{PY_WS}+")


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, status, data) of all captured responses."""
    each = pages.select("page_id", F.posexplode("xhr_responses").alias("pos", "r"))
    held = each.schema["r"].dataType.fieldNames()
    return each.select("page_id", "pos", "r.url", "r.status", "r.data", *[f"r.{c}" for c in ("content_type",) if c in held])


def accepted(pages: DataFrame) -> DataFrame:
    """The first response of each page and url, if its status is good and its body is a JSON object or array; a bad
    first one hides later ones. A type of content, where the responses have one, must be JSON or empty."""
    kept = responses(pages).where("url is not null")
    for part in IGNORED:
        kept = kept.where(~F.contains(F.lower("url"), F.lit(part)))
    first = kept.groupBy("page_id", "url").agg(F.min_by(F.struct(*[c for c in kept.columns if c not in ("page_id", "url")]), "pos").alias("x")).select("page_id", "url", "x.*")
    body = F.ltrim("data")
    good = F.col("status").between(200, 299) & (F.startswith(body, F.lit("{")) | F.startswith(body, F.lit("["))) & F.try_parse_json("data").isNotNull()
    if "content_type" in kept.columns:
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        good = good & ((kind == "") | F.contains(kind, F.lit("json")))
    return first.where(good)


def fragments(value: object, path: tuple[str, ...] = (), depth: int = 0) -> Iterator[str]:
    """Texts of a JSON value with their path; numbers, long arrays and texts with few letters are left out."""
    if value is None or depth > DEEPEST or isinstance(value, (bool, int, float)):
        return
    if isinstance(value, str):
        s = _WS.sub(" ", value).strip()
        if s and len(re.findall("[a-zA-Z]", s)) >= min(6, math.ceil(len(s) * 0.2)):
            s = s if len(s) <= LONGEST else s[:LONGEST] + "..."
            yield f"{' > '.join(path)}: {s}" if path else s
    elif isinstance(value, list):
        if len(value) <= WIDEST:
            for i, x in enumerate(value, 1):
                yield from fragments(x, (*path, f"#{i}"), depth + 1)
    elif isinstance(value, dict):
        for k, x in list(value.items())[:WIDEST]:
            yield from fragments(x, (*path, k), depth + 1)


def fragment_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, n, fragment): the first fragments of each response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, pos, text in zip(b["page_id"], b["pos"], b["data"]):
                ok, value = parse(text)
                if ok:
                    out += [(page, pos, n, clean(f)) for n, f in zip(range(1, MOST + 1), fragments(value))]
            yield pd.DataFrame(out, columns=["page_id", "pos", "n", "fragment"])

    return responses(pages).select("page_id", "pos", "data").mapInPandas(run, "page_id bigint, pos int, n int, fragment string")


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, text): the fragments of a page's responses, a section for each that has any, numbered by its place."""
    lines = fragment_rows(pages).groupBy("page_id", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "fragment"))).alias("f")).select("page_id", "pos", F.array_join(F.transform("f", lambda x: x["fragment"]), "\n").alias("lines"))
    heads = pages.select("page_id", F.posexplode("xhr_responses").alias("pos", "r")).select("page_id", "pos", F.filter(F.array(F.nullif("r.url", F.lit("")), F.concat(F.lit("status "), F.col("r.status")), F.date_format("r.captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), lambda x: x.isNotNull()).alias("h"))
    head = F.concat(F.lit("XHR "), F.col("pos") + 1, F.when(F.size("h") > 0, F.concat(F.lit(" ("), F.array_join("h", " | "), F.lit(")"))).otherwise(""), F.lit("\n"), F.col("lines"))
    return lines.join(heads, ["page_id", "pos"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", head.alias("x")))).alias("s")).select("page_id", F.array_join(F.transform("s", lambda x: x["x"]), "\n\n").alias("text"))


def merged(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries (page_key, url, captured_at, ...) of pages, the first of each url and time: what was captured under
    several names of one page becomes one list. Null urls and times count as equal."""
    rest = [c for c in entries.columns if c not in ("page_key", "url", "captured_at")]
    held = entries.groupBy("page_key", F.coalesce("url", F.lit("")).alias("url"), "captured_at").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return held.select("page_key", "url", "captured_at", "__x.*")


_DIGITS = re.compile(r"[0-9]{10,}")


def first_date(item: dict) -> str | None:
    """The first value of the date keys that is a time, as text; numbers are seconds, or milliseconds if over 1e12."""
    for k in DATE_KEYS:
        v = item.get(k)
        if isinstance(v, bool) or v is None:
            continue
        if isinstance(v, (int, float)) or isinstance(v, str) and _DIGITS.fullmatch(v.strip()):
            x = float(v)
            if abs(x if x > 1e12 else x * 1000) <= 8.64e15:
                return v.strip() if isinstance(v, str) else json.dumps(v)
        elif isinstance(v, str) and v.strip():
            try:
                datetime.fromisoformat(v.strip())
                return v.strip()
            except ValueError:
                continue
    return None


def item_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, n, title, date_text): items of top-level arrays or of the known list keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, pos, text in zip(b["page_id"], b["pos"], b["data"]):
                ok, value = parse(text)
                lists = [value] if isinstance(value, list) else [value[k] for k in LIST_KEYS if isinstance(value.get(k), list)] if ok and isinstance(value, dict) else []
                n = 0
                for xs in lists:
                    if not xs or not isinstance(xs[0], dict):
                        continue
                    for x in xs:
                        if not isinstance(x, dict):
                            continue
                        n += 1
                        date = first_date(x)
                        title = x.get("title")
                        out.append((page, pos, n, clean(title) if isinstance(title, str) else None, None if date is None else clean(date)))
            yield pd.DataFrame(out, columns=["page_id", "pos", "n", "title", "date_text"])

    return responses(pages).select("page_id", "pos", "data").mapInPandas(run, "page_id bigint, pos int, n int, title string, date_text string")
