"""Change ledger: which items and chunks a run adds, changes, keeps or leaves stale, and the merged ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import chunk_id, trim_ws


def page_plan(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """(url, hash, status) of items (url, text) against ledger (url, content_hash, deleted)."""
    now = items.select("url", F.sha2(trim_ws(F.col("text")), 256).alias("hash"))
    old = ledger.select("url", "content_hash", "deleted")
    known = F.col("content_hash").isNotNull() & ~F.coalesce("deleted", F.lit(False))
    return now.join(old, "url", "left").select("url", "hash", F.when(~known, "NEW").when(F.col("hash") == F.col("content_hash"), "UNCHANGED").otherwise("MODIFIED").alias("status"))


def line_chunks(items: DataFrame) -> DataFrame:
    """(url, idx, text, text_hash, chunk_id, total): one chunk for each line that is not blank."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    each = items.select("url", F.size(lines).cast("bigint").alias("total"), F.posexplode(lines).alias("idx", "text"))
    hashed = each.withColumn("text_hash", F.sha2("text", 256))
    return hashed.withColumn("chunk_id", chunk_id(F.col("url"), F.col("idx"), F.col("text_hash")))


def to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks without a stored chunk of the same id and text."""
    return chunks.join(stored.select("url", "chunk_id", "text_hash"), ["url", "chunk_id", "text_hash"], "left_anti")


def stale(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored chunks of re-processed urls that no longer exist."""
    return stored.join(chunks.select("url").distinct(), "url", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def merge_pages(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """(url, content_hash, version, deleted): the page ledger after a run; urls that the run lacks stay."""
    old = ledger.select("url", F.col("content_hash").alias("old_hash"), "version", "deleted")
    changed = F.col("status").isin("NEW", "MODIFIED")
    return plan.join(old, "url", "full").select("url", F.coalesce("hash", "old_hash").alias("content_hash"), (F.coalesce("version", F.lit(0)) + F.when(changed, 1).otherwise(0)).cast("bigint").alias("version"), F.when(F.col("status").isNotNull(), False).otherwise(F.col("deleted")).alias("deleted"))


def merge_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, chunk_id, text_hash): the chunk ledger after a run."""
    cols = ["url", "chunk_id", "text_hash"]
    kept = stored.select(*cols).join(stale(chunks, stored).select("chunk_id"), "chunk_id", "left_anti").join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*cols).unionByName(chunks.select(*cols).distinct())


#: Columns of the whole page ledger.
PAGE_COLUMNS = ("url", "type", "title", "category", "word_count", "content_hash", "chunk_count", "last_seen_at", "deleted", "version", "last_embedded_at")


def page_rows(items: DataFrame, plan: DataFrame, chunks: DataFrame, stored: DataFrame, old: DataFrame, started: Column, updated: Column) -> DataFrame:
    """The whole page ledger (PAGE_COLUMNS) after a run; urls that the run lacks stay as they are.

    items are (url, type, title, category, word_count) and plan (url, hash, status) of the run, chunks and stored the
    chunks of its new and changed pages and those of the ledger before. A version goes up if chunks were embedded, if
    the page is new, or if a changed page only lost chunks; these (but for new pages without chunks) are stamped with
    updated. All stamps are those of the run.
    """
    touched = plan.where("status <> 'UNCHANGED'").select("url", "status")
    own = chunks.join(touched.select("url"), "url", "left_semi")
    new = to_embed(own, stored).groupBy("url").agg(F.count("*").alias("new"))
    # Pages that lost all their chunks have none to be found by.
    gone = stored.join(touched.select("url"), "url", "left_semi").join(own.select("chunk_id"), "chunk_id", "left_anti").groupBy("url").agg(F.count("*").alias("gone"))
    count = own.groupBy("url").agg(F.count("*").alias("own"))
    was = old.select("url", *[F.col(c).alias(f"__{c}") for c in PAGE_COLUMNS[1:]], F.lit(True).alias("__was"))
    run = items.select("url", "type", "title", "category", "word_count").join(plan, "url").join(new, "url", "left").join(gone, "url", "left").join(count, "url", "left").fillna(0, ["new", "gone", "own"])
    both = run.join(was, "url", "full")
    only_lost = (F.col("status") == "MODIFIED") & (F.col("gone") > 0) & (F.col("new") == 0)
    embedded = F.col("new") > 0
    up = embedded | (F.col("status") == "NEW") | only_lost
    seen = F.col("status").isNotNull()
    pick = lambda fresh, c: F.when(seen, fresh).otherwise(F.col(f"__{c}")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "url",
        *[pick(F.col(c), c) for c in ("type", "title", "category", "word_count")],
        pick(F.col("hash"), "content_hash"),
        pick(F.when(F.col("status") == "UNCHANGED", zero("__chunk_count")).otherwise(F.col("own")), "chunk_count"),
        pick(started, "last_seen_at"),
        pick(F.lit(False), "deleted"),
        pick((zero("__version") + F.when(up, 1).otherwise(0)).cast("bigint"), "version"),
        pick(F.when(embedded | only_lost, updated).otherwise(F.col("__last_embedded_at")), "last_embedded_at"),
    )


def active(pages: DataFrame) -> DataFrame:
    """Pages of the ledger that are not deleted."""
    return pages.where(~F.coalesce("deleted", F.lit(False)))


def stamped_chunks(chunks: DataFrame, items: DataFrame, at: Column) -> DataFrame:
    """Rows of the chunk ledger: chunks with one stamp for the run and a snapshot of their item's metadata."""
    held = items.select("url", F.struct("type", "title", "category").alias("metadata"))
    return chunks.join(held, "url", "left").select("chunk_id", "url", "idx", "text_hash", F.col("chunk_id").alias("vector_id"), at.alias("stored_at"), "metadata")
