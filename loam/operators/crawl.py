"""Breadth-first crawl over known links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.ranking import numbered
from loam.storage import cut


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, excluded: DataFrame | None = None) -> DataFrame:
    """(url, depth): urls reached from seeds (url) over edges (source, target), with their least depth.

    Each level joins the frontier with the edges and leaves out what was visited or excluded; a level is cut off in
    the shared checkpoint folder, so plans do not grow with the depth.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "/+$", "")
    pairs = edges.where("source is not null and target is not null").select(key(F.col("source")).alias("source"), key(F.col("target")).alias("target")).distinct()
    frontier = seeds.select(key(F.col("url")).alias("url")).distinct()
    if excluded is not None:
        banned = excluded.select(key(F.col("url")).alias("url"))
        frontier = frontier.join(banned, "url", "left_anti")
    visited = cut(frontier.withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        found = frontier.join(pairs, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        if excluded is not None:
            found = found.join(banned, "url", "left_anti")
        frontier = cut(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def budgeted(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, priority: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(url, depth, place): the first max_pages urls of a crawl in its order of visits.

    edges are (source, target, ord), seeds and priority (url, ord). Priority urls come first, then seeds, then what
    was found on them, in the order of the pages and of the links on a page: a queue, level by level. A url is visited
    once, under its key; its first entry counts. Pages that lead nowhere take part of the budget as well.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "/+$", "")
    pairs = edges.where("source is not null and target is not null").groupBy(key(F.col("source")).alias("source"), key(F.col("target")).alias("url")).agg(F.min("ord").alias("ord"))
    starts = seeds.select(key(F.col("url")).alias("url"), F.struct(F.lit(1).cast("bigint").alias("a"), F.col("ord").cast("bigint").alias("b")).alias("at"))
    if priority is not None:
        starts = starts.unionByName(priority.select(key(F.col("url")).alias("url"), F.struct(F.lit(0).cast("bigint").alias("a"), F.col("ord").cast("bigint").alias("b")).alias("at")))
    banned = None if excluded is None else excluded.select(key(F.col("url")).alias("url")).distinct()
    visited, found, place, depth = None, starts.where("url is not null"), 0, 0
    while True:
        if banned is not None:
            found = found.join(banned, "url", "left_anti")
        if visited is not None:
            found = found.join(visited.select("url"), "url", "left_anti")
        once = found.groupBy("url").agg(F.min("at").alias("at"))
        level = cut(numbered(once, [F.col("at"), F.col("url")], "n").where(F.col("n") <= max_pages - place).select("url", F.lit(depth).alias("depth"), (F.col("n") + place).alias("place")))
        n = level.count()
        visited = level if visited is None else visited.unionByName(level)
        place, depth = place + n, depth + 1
        if n == 0 or place >= max_pages or depth > max_depth:
            return visited
        found = level.select(F.col("url").alias("source"), "place").join(pairs, "source").select("url", F.struct(F.col("place").cast("bigint").alias("a"), F.col("ord").cast("bigint").alias("b")).alias("at"))
