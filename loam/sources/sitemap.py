"""Sitemap files as tables."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.storage import cut


def locs(xml: Column) -> Column:
    """All locations of a sitemap or of an index."""
    return F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def entries(files: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., loc, lastmod) of the url blocks of sitemaps; blocks without loc are dropped."""
    block = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    each = files.select(*keep, F.explode(block).alias("b"))
    loc = F.regexp_extract("b", r"(?is)<loc>\s*([^<\s]+)\s*</loc>", 1)
    mod = F.nullif(F.regexp_extract("b", r"(?is)<lastmod>\s*([^<]*?)\s*</lastmod>", 1), F.lit(""))
    return each.select(*keep, loc.alias("loc"), mod.alias("lastmod")).where("loc <> ''")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, xml) of sitemap files; those that end in .gz are unpacked, unreadable ones are left out. url is the path."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, c in zip(b["url"], b["content"]):
                try:
                    c = bytes(c)
                    out.append((u, (gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c).decode("utf-8")))
                except (OSError, EOFError, ValueError, zlib.error):
                    continue
            yield pd.DataFrame(out, columns=["url", "xml"])

    return raw.mapInPandas(unpack, "url string, xml string")


_INDEX = r"(?i)<sitemapindex[\s>]"


def tree(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(loc, lastmod) reached from root files (url) over index files; files is (url, xml). A file is read once, so a
    circle of index files ends; a file without url blocks gives its bare locations."""
    frontier = cut(roots.select("url").distinct())
    seen, out = frontier, None
    while True:
        level = files.join(frontier, "url", "left_semi")
        leaves = level.where(~F.col("xml").rlike(_INDEX))
        blocks = F.col("xml").rlike(r"(?is)<url\b[^>]*>.*?<loc>")
        bare = leaves.where(~blocks).select(F.explode(locs(F.col("xml"))).alias("loc"), F.lit(None).cast("string").alias("lastmod"))
        part = entries(leaves.where(blocks)).unionByName(bare)
        out = part if out is None else out.unionByName(part)
        named = level.where(F.col("xml").rlike(_INDEX)).select(F.explode(locs(F.col("xml"))).alias("url")).distinct()
        frontier = cut(named.join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            return out.distinct()
        seen = seen.unionByName(frontier)
