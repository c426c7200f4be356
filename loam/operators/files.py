"""Records of files: from captured items, with dates and policy of sitemaps, merged over captures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import categories, dates, urls
from loam.functions.text import word_count
from loam.operators import xhr
from loam.operators.shred import clean, parse

# Fields of an item that may hold a file's url, its title, its text; fields of a nested link.
URL_FIELDS = ("link", "url", "file", "document", "path")
NESTED_FIELDS = ("url", "href")
TITLE_FIELDS = ("title", "name", "notification", "subject", "fileName", "caption", "heading")
TEXT_FIELDS = ("description", "summary", "details", "note", "content", "notification")
#: Categories whose files must be listed in a sitemap.
LISTED = ("tender", "notices")


def file_url(item: dict) -> str | None:
    """The first field with the url of a file, itself or nested one level."""
    for f in URL_FIELDS:
        v = item.get(f)
        if isinstance(v, dict):
            v = next((v[k] for k in NESTED_FIELDS if isinstance(v.get(k), str)), None)
        if isinstance(v, str) and ".pdf" in v.lower():
            return v
    return None


def first_text(item: dict, fields: tuple[str, ...]) -> str | None:
    return next((item[f].strip() for f in fields if isinstance(item.get(f), str) and item[f].strip()), None)


def captured_files(pages: DataFrame, now: Column) -> DataFrame:
    """(page_id, pos, n, url, title, text, category, published_at, published_at_source, word_count): files that items of
    captured responses name, young enough for their category.

    The category comes from the upload folder, else from tags, else from url and words. pages holds page_id, url,
    xhr_responses. Items without a file, and files without an absolute url, are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, pos, text in zip(b["page_id"], b["pos"], b["data"]):
                ok, value = parse(text)
                lists = [value] if isinstance(value, list) else [value[k] for k in xhr.LIST_KEYS if isinstance(value.get(k), list)] if ok and isinstance(value, dict) else []
                n = 0
                for xs in lists:
                    if not xs or not isinstance(xs[0], dict):
                        continue
                    for x in xs:
                        if not isinstance(x, dict):
                            continue
                        n += 1
                        if (href := file_url(x)) is None:
                            continue
                        tags = x.get("notification_for")
                        said = " ".join(str(x.get(f) or "") for f in ("title", "notification")).strip()
                        names = [first_text(x, TITLE_FIELDS), first_text(x, TEXT_FIELDS), said, xhr.first_date(x)]
                        out.append((page, pos, n, clean(href), *(None if v is None else clean(v) for v in names), [clean(str(t)) for t in tags] if isinstance(tags, list) else None))
            yield pd.DataFrame(out, columns=["page_id", "pos", "n", "href", "title", "text", "said", "date", "tags"])

    first = xhr.accepted(pages).select("page_id", "pos", "data")
    items = first.mapInPandas(run, "page_id bigint, pos int, n int, href string, title string, text string, said string, date string, tags array<string>")
    held = items.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id").withColumn("url", urls.resolve(F.col("page_url"), F.col("href"))).where("url is not null")
    title = F.coalesce("title", urls.file_name(F.col("url")))
    category = F.coalesce(categories.pdf_category(F.col("url")), categories.from_tags(F.col("tags")), categories.category(F.col("url"), F.col("said")))
    full = held.select("page_id", "pos", "n", "url", title.alias("title"), F.coalesce("text", title).alias("text"), category.alias("category"), dates.item_date(F.col("date")).alias("published_at"))
    young = full.where(dates.is_recent(F.col("published_at"), F.when(F.col("category").isin("tender", "notices", "recruitments"), F.col("category")), now))
    return young.withColumn("published_at_source", F.when(F.col("published_at").isNotNull(), "item")).withColumn("word_count", word_count(F.col("text")))


def listed_files(entries: DataFrame, now: Column) -> DataFrame:
    """(file_key, listed_at) of sitemap entries (loc, lastmod timestamp, ord): files with a date, tenders and notices only if young
    enough; the last entry of a file stands."""
    kind = categories.pdf_category(F.col("loc"))
    dated = entries.where(F.col("lastmod").isNotNull() & F.endswith(F.lower("loc"), F.lit(".pdf")))
    kept = dated.where(dates.is_recent(F.col("lastmod"), F.when(kind.isin(*LISTED), kind), now))
    return kept.groupBy(F.lower("loc").alias("file_key")).agg(F.max_by("lastmod", "ord").alias("listed_at"))


def allowed(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (url, category): tenders and notices only if listed; others pass."""
    bound = F.coalesce(F.lower(F.coalesce(F.nullif("category", F.lit("")), categories.pdf_category(F.col("url")))).isin(*LISTED), F.lit(False))
    named = files.where(bound).withColumn("file_key", F.lower("url")).join(listed.select("file_key"), "file_key", "left_semi").drop("file_key")
    return files.where(~bound).unionByName(named)


def with_dates(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files with published_at and its source: their own, else the date of the sitemap."""
    held = files.withColumn("file_key", F.lower("url")).join(listed, "file_key", "left").drop("file_key")
    source = F.when(F.col("published_at").isNotNull(), F.col("published_at_source")).when(F.col("listed_at").isNotNull(), "sitemap")
    return held.withColumn("published_at_source", source).withColumn("published_at", F.coalesce("published_at", "listed_at")).drop("listed_at")


def built(captures: DataFrame, links: DataFrame) -> DataFrame:
    """Records of extracted files: (url, title, category, parent_page_url, parent_page_title, word_count) of captures
    (url, title, category, text) and the first link to each (url, text, title, source_url, source_title, link_id)."""
    first = links.where("url is not null").groupBy("url").agg(F.min_by(F.struct("text", "title", "source_url", "source_title"), "link_id").alias("l"))
    some = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    held = captures.join(first, "url", "left")
    title = some("title", "l.text", "l.title", urls.file_name(F.col("url")), "url")
    category = F.coalesce(F.nullif("category", F.lit("")), categories.pdf_category(F.col("url")), categories.category(F.col("url"), F.col("text")))
    return held.select(*[c for c in captures.columns if c not in ("title", "category")], title.alias("title"), category.alias("category"), F.coalesce("l.source_url", F.lit("")).alias("source_url"), F.coalesce("l.source_title", F.lit("")).alias("source_title"), word_count(F.col("text")).alias("words"))


def merged(captures: DataFrame, order: Column) -> DataFrame:
    """Captures of files folded by url in their order: a field has its last value that is not empty (or 0), the title
    that of the last capture."""
    last = lambda c, none: F.max_by(c, F.when(F.col(c) != none, F.col("__o"))).alias(c)
    fields = [last(c, F.lit("")) for c in ("category", "parent_page_title")] + [last(c, F.lit(0)) for c in ("pages", "word_count")]
    return captures.where("url is not null").withColumn("__o", order).groupBy("url").agg(F.max_by("title", "__o").alias("title"), *fields)
