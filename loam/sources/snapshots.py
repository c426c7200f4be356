"""Snapshot files: one nested JSON document for each crawl run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK = "struct<url:string,text:string,title:string,sourceUrl:string,sourceTitle:string,context:string>"
PAGE = "struct<url:string,timestamp:string,depth:int,title:string,headings:array<struct<level:int,text:string,id:string>>,content:string,rawContent:array<string>,tables:array<array<array<string>>>,lists:array<array<string>>,metadata:struct<description:string,keywords:string>,category:string,wordCount:int>"
PDF = "struct<url:string,title:string,text:string,pages:int,category:string,timestamp:string,parentPageUrl:string,parentPageTitle:string,sourceUrl:string,sourceTitle:string,wordCount:int,publishedAt:string,publishedAtSource:string>"
SCHEMA = f"metadata struct<timestamp:string,source:string,baseUrl:string,scrapeType:string,maxPages:int,maxDepth:int>, pages array<{PAGE}>, documents struct<pdfs:array<{PDF}>>, links struct<internal:array<{LINK}>,external:array<{LINK}>,pdf:array<{LINK}>,image:array<{LINK}>>, _corrupt string"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshot files, with missing parts as empty; malformed files are left out."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    held = raw.select("*", F.col("_metadata.file_name").alias("file")).where("_corrupt is null").drop("_corrupt")
    return held.withColumn("pages", F.coalesce("pages", F.array().cast(f"array<{PAGE}>"))).withColumn("pdfs", F.coalesce("documents.pdfs", F.array().cast(f"array<{PDF}>")))


def latest(snapshots: DataFrame) -> DataFrame:
    """The snapshot of the greatest file name."""
    return snapshots.orderBy(F.desc("file")).limit(1)


def summary(snapshots: DataFrame) -> DataFrame:
    n = lambda c: F.greatest(F.size(c), F.lit(0)).alias(c.split(".")[-1])
    return snapshots.select("file", "metadata.timestamp", n("pages"), n("pdfs"), n("links.internal"), n("links.external"), n("links.pdf"), n("links.image"))


def write_snapshot(pages: DataFrame, pdfs: DataFrame, path: str, links: DataFrame | None = None) -> None:
    """Write tables of a run as JSON lines, pages, files, links and statistics apart; an existing folder is an error."""
    pages.write.mode("error").json(f"{path}/pages")
    pdfs.write.mode("error").json(f"{path}/pdfs")
    if links is not None:
        links.write.mode("error").json(f"{path}/links")
        statistics(pages, pdfs, links).coalesce(1).write.mode("error").json(f"{path}/statistics")


def statistics(pages: DataFrame, pdfs: DataFrame, links: DataFrame) -> DataFrame:
    """(total_pages, total_pdfs, total_links, total_images, categorized_pages) of a run, in one row."""
    parts = [pages.select(F.lit("page").alias("k")), pdfs.select(F.lit("pdf").alias("k")), links.select(F.when(F.col("link_type") == "image", "image").otherwise("link").alias("k"))]
    n = lambda *ks: F.count_if(F.col("k").isin(*ks))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(n("page").alias("total_pages"), n("pdf").alias("total_pdfs"), n("link", "image").alias("total_links"), n("image").alias("total_images"), n("page").alias("categorized_pages"))


def write_files(pdfs: DataFrame, path: str, version: int) -> str:
    """Write enriched files beside the versions before, never over what may still be read; returns the folder."""
    folder = f"{path}/v={version}"
    pdfs.write.mode("error").json(folder)
    return folder
