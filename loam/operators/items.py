"""Ingestion items: pages and files as structured text, the two virtual items, and chunk metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.functions.categories import or_general
from loam.functions.text import trim_ws, word_count
from loam.operators.links import page_link_stats

# Least length of a kept item; links of the directory item; characters of a stored chunk.
LEAST_TEXT, DIRECTORY_LINKS, STORED_TEXT = 100, 50, 1000


def empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def standing(df: DataFrame, id_col: str) -> DataFrame:
    """The last capture of each url of a snapshot."""
    order = W.partitionBy("snapshot_id", "url").orderBy(F.col("ts").desc_nulls_last(), F.col(id_col).desc())
    return df.where("url is not null").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def table_lines(tables: Column) -> Column:
    """Rows of all tables as lines of cells; rows without a cell that is not blank are dropped."""
    rows = F.flatten(F.coalesce(tables, F.array().cast("array<array<array<string>>>")))
    filled = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return F.transform(filled, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit(""))), " | "))


def table_text(tables: Column) -> Column:
    """Rows of all tables as lines of cells joined by a space; blank cells and rows are dropped."""
    rows = F.flatten(F.coalesce(tables, F.array().cast("array<array<array<string>>>")))
    lines = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit(""))), lambda c: c != ""), " "))
    return F.filter(lines, lambda x: x != "")


def page_content(pages: DataFrame) -> Column:
    """The content of a page from its fields: title, headings, blocks, table lines, list items, metadata, by spaces."""
    none = F.array().cast("array<string>")
    heads = F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,id:string>>")), lambda h: h["text"])
    every = F.concat(F.array("title"), heads, F.coalesce("raw_content", none), table_text(F.col("tables")), F.flatten(F.coalesce("lists", F.array().cast("array<array<string>>"))), F.array("metadata.description", "metadata.keywords"))
    return F.array_join(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def page_text(pages: DataFrame, captured: Column | None = None) -> Column:
    """Title, url, category, headings, content, tables, lists, description, keywords, captured responses (a text of
    sections, see xhr.sections), in paragraphs."""
    heads = F.array_join(F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,id:string>>")), lambda h: F.concat(F.lit("Heading "), F.coalesce(h["level"].cast("string"), F.lit("")), F.lit(": "), F.coalesce(h["text"], F.lit("")))), "\n")
    lists = F.array_join(F.transform(F.coalesce("lists", F.array().cast("array<array<string>>")), lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("")))), "\n")), "\n\n")
    parts = F.array(
        F.concat(F.lit("Title: "), empty("title")),
        F.concat(F.lit("URL: "), empty("url")),
        F.concat(F.lit("Category: "), or_general(F.col("category"))),
        heads,
        empty("content"),
        F.array_join(table_lines(F.col("tables")), "\n"),
        lists,
        F.concat(F.lit("Description: "), F.coalesce("metadata.description", F.lit(""))),
        F.concat(F.lit("Keywords: "), F.coalesce("metadata.keywords", F.lit(""))),
        F.coalesce(captured, F.lit("")) if captured is not None else F.lit(""),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def pdf_text() -> Column:
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("PDF Title: "), empty("title")),
        F.concat(F.lit("URL: "), empty("url")),
        F.concat(F.lit("Category: "), or_general(F.col("category"))),
        F.concat(F.lit("Pages: "), F.coalesce(F.col("pages").cast("string"), F.lit(""))),
        F.concat(F.lit("Source Page: "), F.coalesce(F.nullif("parent_page_title", F.lit("")), F.lit("Unknown"))),
        F.concat(F.lit("Content: "), empty("text")),
    )


def page_items(pages: DataFrame) -> DataFrame:
    held = pages.select("snapshot_id", "url", F.lit("page").alias("type"), empty("title").alias("title"), or_general(F.col("category")).alias("category"), page_text(pages).alias("text"))
    return held.where(F.length(trim_ws(F.col("text"))) > LEAST_TEXT)


def pdf_items(pdfs: DataFrame) -> DataFrame:
    long = pdfs.where(F.length(trim_ws(empty("text"))) > LEAST_TEXT)
    return long.select("snapshot_id", "url", F.lit("pdf").alias("type"), empty("title").alias("title"), or_general(F.col("category")).alias("category"), pdf_text().alias("text"))


def items(pages: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(snapshot_id, url, type, title, category, text, word_count) of standing pages and files."""
    every = page_items(standing(pages, "page_id")).unionByName(pdf_items(standing(pdfs, "pdf_id")))
    return every.withColumn("word_count", word_count(F.col("text")))


# Urls and titles of the virtual items.
VIRTUAL = {"directory": ("virtual://links-directory", "Website Links Directory"), "statistics": ("virtual://statistics", "Website Statistics Overview")}


def virtual_items(pages: DataFrame, pdfs: DataFrame, links: DataFrame) -> DataFrame:
    """The directory and the statistics of each snapshot as items; short ones are left out like all items."""
    parts = {"directory": links_directory(links), "statistics": statistics_item(pages, pdfs, links)}
    made = [df.select("snapshot_id", F.lit(VIRTUAL[k][0]).alias("url"), F.lit("page").alias("type"), F.lit(VIRTUAL[k][1]).alias("title"), F.lit("virtual").alias("category"), "text") for k, df in parts.items()]
    every = made[0].unionByName(made[1]).where(F.length(trim_ws(F.col("text"))) > LEAST_TEXT)
    return every.withColumn("word_count", word_count(F.col("text")))


def all_items(pages: DataFrame, pdfs: DataFrame, links: DataFrame) -> DataFrame:
    """Items of all four kinds: pages, files, directory, statistics."""
    return items(pages, pdfs).unionByName(virtual_items(pages, pdfs, links))


def chunk_records(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """(chunk_id, text, chunk_index, total_chunks, link_stats, ...) of chunks (url, idx, total, text, chunk_id) of pages:
    the text that is stored (its first characters), the counts of links as JSON, and what the page holds."""
    stats = F.to_json(F.struct(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "pdf", "internal", "external", "image")]))
    held = metadata.select("url", stats.alias("link_stats"), "has_links", "has_tables", "has_lists", "xhr_count")
    return chunks.withColumnRenamed("total", "total_chunks").join(held, "url", "left").select("chunk_id", "url", F.substring("text", 1, STORED_TEXT).alias("text"), F.col("idx").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), "link_stats", "has_links", "has_tables", "has_lists", (F.coalesce("xhr_count", F.lit(0)) > 0).alias("has_xhr"), F.coalesce("xhr_count", F.lit(0)).alias("xhr_count"))


def links_directory(links: DataFrame) -> DataFrame:
    """(snapshot_id, text): all file links and the first internal links of each snapshot, as one text."""
    line = F.concat(F.lit("- "), empty("text"), F.lit(" - "), empty("url"))
    pdf = links.where("link_type = 'pdf'").groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("link_id", F.concat(line, F.lit(" (Found on: "), empty("source_title"), F.lit(")")).alias("x")))).alias("p"))
    first = links.where("link_type = 'internal'").withColumn("n", F.row_number().over(W.partitionBy("snapshot_id").orderBy("link_id"))).where(F.col("n") <= DIRECTORY_LINKS)
    page = first.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("link_id", line.alias("x")))).alias("i"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["x"]), "\n")
    return pdf.join(page, "snapshot_id", "full").select("snapshot_id", F.concat(F.lit("PDF Documents Available:\n"), F.coalesce(text("p"), F.lit("No PDFs found")), F.lit("\n\nInternal Pages:\n"), F.coalesce(text("i"), F.lit("No internal links found"))).alias("text"))


def statistics_item(pages: DataFrame, pdfs: DataFrame, links: DataFrame) -> DataFrame:
    """(snapshot_id, text): totals, pages by category, and the files of each snapshot."""
    cats = pages.groupBy("snapshot_id", or_general(F.col("category")).alias("c")).agg(F.count("*").alias("n")).groupBy("snapshot_id").agg(F.sum("n").alias("pages"), F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("c"), F.lit(": "), F.col("n"), F.lit(" pages")))).alias("lines"))
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    line = F.concat(F.lit("- "), empty("title"), F.lit(" ("), count("pages"), F.lit(" pages, "), count("word_count"), F.lit(" words) - "), or_general(F.col("category")))
    files = pdfs.groupBy("snapshot_id").agg(F.count("*").alias("pdfs"), F.array_sort(F.collect_list(F.struct("pdf_id", line.alias("x")))).alias("files"))
    found = links.groupBy("snapshot_id").agg(F.count("*").alias("links"))
    held = cats.join(files, "snapshot_id", "left").join(found, "snapshot_id", "left").fillna(0)
    named = F.coalesce(F.array_join(F.transform("files", lambda f: f["x"]), "\n"), F.lit("No PDFs processed"))
    return held.select("snapshot_id", F.concat(F.lit("Total Pages Scraped: "), F.col("pages"), F.lit("\nTotal PDF Documents: "), F.col("pdfs"), F.lit("\nTotal Links Found: "), F.col("links"), F.lit("\nCategories Breakdown:\n"), F.array_join("lines", "\n"), F.lit("\n\nAvailable PDF Documents:\n"), named).alias("text"))


def page_metadata(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with the counts of their links (zeros without any) and what they hold."""
    stats = page_link_stats(links).withColumnRenamed("source_url", "url")
    held = pages.select("page_id", "url", F.coalesce(F.size("tables") > 0, F.lit(False)).alias("has_tables"), F.coalesce(F.size("lists") > 0, F.lit(False)).alias("has_lists"), F.coalesce(F.greatest(F.size("xhr_responses"), F.lit(0)), F.lit(0)).cast("bigint").alias("xhr_count"))
    return held.join(stats, "url", "left").fillna(0, ["total", "pdf", "internal", "external", "image"]).withColumn("has_links", F.col("total") > 0)
