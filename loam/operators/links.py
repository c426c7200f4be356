"""Links: counts, first and last links, the link database, and matching links to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.functions.text import WS
from loam.functions.urls import file_name, pdf_key, resolve
from loam.operators.ranking import numbered

# Most links of a question; score of a link among sources.
LINKS_PER_QUESTION, LINK_SCORE = 5, 0.8


def page_link_stats(links: DataFrame) -> DataFrame:
    """Links of each source page by type; links without source are left out."""
    one = lambda t: F.count_if(F.col("link_type") == t).alias(t)
    return links.where("source_url is not null and source_url <> ''").groupBy("source_url").agg(F.count("*").alias("total"), one("pdf"), one("internal"), one("external"), one("image"))


def pdf_ranking(links: DataFrame) -> DataFrame:
    """Pages by their number of file links; ties by url."""
    counts = page_link_stats(links).where("pdf > 0").select(F.col("source_url").alias("url"), F.col("pdf").alias("pdf_count"))
    return numbered(counts, [F.desc("pdf_count"), F.col("url")], "place")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: a keep-first that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*")


def unique_pdfs(pdfs: DataFrame) -> DataFrame:
    """One row for each file identity, with the first spelling of its url."""
    return pdfs.where("url is not null").select(pdf_key(F.col("url")).alias("pdf_key"), "url", "pdf_id").groupBy("pdf_key").agg(F.min_by("url", "pdf_id").alias("url"), F.count("*").alias("captures"))


def cleaned(links: DataFrame, resolved: bool = False) -> DataFrame:
    """Links that lead somewhere, the first for each page and target; with resolved, targets are made absolute first."""
    low = F.lower("url")
    kept = links.where(F.col("url").isNotNull() & (F.col("url") != "") & ~low.startswith("javascript:") & ~low.startswith("mailto:") & ~low.startswith("tel:") & (F.col("url") != "#"))
    if resolved:
        kept = kept.withColumn("url", resolve(F.col("source_url"), F.col("url"))).where("url is not null")
    return first_by(kept.select("snapshot_id", "source_url", "url", "link_id", "text", "link_type"), ["snapshot_id", "source_url", "url"], ["link_id"])


def with_source_titles(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Links or files (snapshot_id, source_url, source_title) with the title of the page they stand on, where that page was
    captured in the same snapshot: the last captured title that is not null."""
    titles = pages.where("title is not null").groupBy("snapshot_id", F.col("url").alias("source_url")).agg(F.max_by("title", "page_id").alias("__title"))
    return rows.join(titles, ["snapshot_id", "source_url"], "left").withColumn("source_title", F.coalesce("__title", "source_title")).drop("__title")


def key_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"{WS}+", "_")


def link_database(links: DataFrame, pages: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(key, first, type, url, text, category, context): place of the first insertion, value of the last write of a key.

    Order: file links (by text, then by file name), page links, pages, files; each by id. Null texts count as ''.
    Tables without category or context give null.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    value = lambda kind, url, t, category=none, context=none: F.struct(F.lit(kind).alias("type"), url.alias("url"), t.alias("text"), category.alias("category"), context.alias("context"))
    at = lambda a, b, c: F.struct(F.lit(a).alias("a"), b.alias("b"), F.lit(c).alias("c")).alias("ord")
    key = lambda head, c: F.concat(F.lit(head), c).alias("key")
    own = lambda df, c: F.col(c) if c in df.columns else none
    pdf = links.where("link_type = 'pdf' and url is not null")
    link = lambda kind: value(kind, F.col("url"), text, context=own(links, "context")).alias("v")
    title = F.coalesce("title", F.lit(""))
    name = F.lower(F.regexp_replace(file_name(F.col("url")), r"^(.*?)\.pdf", "$1"))
    parts = [
        pdf.select(key("pdf_", key_text(text)), at(1, F.col("link_id"), 0), link("pdf")),
        pdf.select(key("pdf_", name), at(1, F.col("link_id"), 1), link("pdf")),
        links.where("link_type = 'internal' and url is not null").select(key("page_", key_text(text)), at(2, F.col("link_id"), 0), link("page")),
        pages.select(key("page_", key_text(title)), at(3, F.col("page_id"), 0), value("page", F.col("url"), title, own(pages, "category")).alias("v")),
        pdfs.select(key("pdf_", key_text(title)), at(4, F.col("pdf_id"), 0), value("pdf_document", F.col("url"), title, own(pdfs, "category")).alias("v")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    held = every.groupBy("key").agg(F.min("ord").alias("first"), F.max_by("v", "ord").alias("v"))
    return held.select("key", "first", "v.*")
