"""Queries of the general training-data problems (2, 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import WS
from loam.operators import shred, snapshot_diff
from loam.sources.tables import table


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of text, title and category, with the fields that changed as comma list."""
    t = lambda n: table(spark, folder, n)
    out = snapshot_diff.snapshot_changes(t("snapshots"), t("pages"), t("pdfs"), ("content", "title", "category"), ("text", "title", "category"))
    return out.withColumn("changed_fields", F.array_join("changed_fields", ","))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, folder, "snapshots"), table(spark, folder, "pages"), table(spark, folder, "pdfs")).drop("changed_fields")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.nested_rows(table(spark, folder, "pages"))


def p4_fields(spark: SparkSession, folder: str) -> DataFrame:
    return shred.field_rows(table(spark, folder, "pages"))


def p4_columns(spark: SparkSession, folder: str) -> DataFrame:
    return shred.leaf_columns(table(spark, folder, "pages"))


def p4_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = shred.table_rows(table(spark, folder, "pages"))
    return rows.select("page_id", F.col("path").alias("row_path"), F.posexplode("cells").alias("cell_no", "cell"))


_SQUEEZED = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"
_P2_SQL = f"""
WITH k AS (
  SELECT snapshot_id, 'page' AS rec_kind, regexp_replace(lower(split_part(url, '#', 1)), '/+$', '') AS url_key, ts, page_id AS id,
         {_SQUEEZED('content')} AS body, {_SQUEEZED('title')} AS title, {_SQUEEZED('category')} AS category FROM pages WHERE url IS NOT NULL
  UNION ALL
  SELECT snapshot_id, 'pdf', regexp_replace(lower(split_part(url, '#', 1)), '/+$', ''), ts, pdf_id,
         {_SQUEEZED('text')}, {_SQUEEZED('title')}, {_SQUEEZED('category')} FROM pdfs WHERE url IS NOT NULL),
s AS (SELECT snapshot_id, row_number() OVER (ORDER BY taken_at NULLS FIRST, snapshot_id) AS r FROM snapshots),
l AS (SELECT r, k.* FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, rec_kind, url_key ORDER BY ts DESC NULLS LAST, id DESC) AS n FROM k) k
      JOIN s USING (snapshot_id) WHERE n = 1),
d AS (SELECT coalesce(b.r, a.r + 1) AS r, coalesce(b.rec_kind, a.rec_kind) AS rec_kind, coalesce(b.url_key, a.url_key) AS url_key,
        CASE WHEN a.url_key IS NULL THEN 'added' WHEN b.url_key IS NULL THEN 'removed' WHEN a.body <> b.body THEN 'changed' END AS change
      FROM l a FULL OUTER JOIN l b ON a.r + 1 = b.r AND a.rec_kind = b.rec_kind AND a.url_key = b.url_key)
SELECT s.snapshot_id, d.rec_kind, d.url_key, d.change FROM d JOIN s ON s.r = d.r WHERE d.change IS NOT NULL AND d.r > 1"""

QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes, "p4_found": p4_found, "p4_fields": p4_fields, "p4_columns": p4_columns, "p4_cells": p4_cells}

# A case is an object whose place ends in an index; its parent is the longest place of another case that it lies in.
_P4_SQL = """
WITH r AS (SELECT page_id, i - 1 AS i, xhr_responses[i].data AS data FROM (SELECT page_id, xhr_responses, unnest(generate_series(1, len(xhr_responses))) AS i FROM pages)),
t AS (SELECT r.page_id, r.i, j.fullkey, j.type FROM r, json_tree(CASE WHEN json_valid(data) THEN data END) j WHERE data IS NOT NULL),
c AS (SELECT page_id, i, replace(fullkey, '"', '') AS k FROM t WHERE type = 'OBJECT' AND ends_with(fullkey, ']')),
p AS (SELECT c.page_id, c.i, c.k, arg_max(o.k, length(o.k)) AS above FROM c LEFT JOIN c o ON o.page_id = c.page_id AND o.i = c.i AND length(o.k) < length(c.k) AND starts_with(c.k, o.k) AND substr(c.k, length(o.k) + 1, 1) IN ('.', '[') GROUP BY 1, 2, 3)
SELECT page_id, 'xhr_responses[' || i || '].data' || k[2:] AS path, CASE WHEN above IS NULL THEN 'xhr_responses[' || i || ']' ELSE 'xhr_responses[' || i || '].data' || above[2:] END AS parent_path FROM p
UNION ALL SELECT page_id, 'tables[' || (t - 1) || '][' || (n - 1) || ']', 'tables[' || (t - 1) || ']' FROM (
  SELECT page_id, t, unnest(generate_series(1, len(tab))) AS n FROM (SELECT page_id, t, tables[t] AS tab FROM (SELECT page_id, tables, unnest(generate_series(1, len(tables))) AS t FROM pages)))"""
ORACLES = {
    "p4_found": _P4_SQL,
    "p2_found": _P2_SQL,
    "p2_changes": _P2_SQL.replace("a.body <> b.body", "a.body <> b.body OR a.title <> b.title OR a.category <> b.category").replace("END AS change\n", """END AS change,
        CASE WHEN a.url_key IS NULL OR b.url_key IS NULL THEN '' ELSE array_to_string(list_sort(list_filter([CASE WHEN a.body <> b.body THEN CASE a.rec_kind WHEN 'page' THEN 'content' ELSE 'text' END END, CASE WHEN a.title <> b.title THEN 'title' END, CASE WHEN a.category <> b.category THEN 'category' END], lambda x: x IS NOT NULL)), ',') END AS changed_fields
""").replace("d.url_key, d.change FROM d", "d.url_key, d.change, d.changed_fields FROM d"),
    "p4_cells": """
SELECT page_id, 'tables[' || (t - 1) || '][' || (r - 1) || ']' AS row_path, CAST(c - 1 AS INTEGER) AS cell_no, row_[c] AS cell FROM (
  SELECT page_id, t, r, row_, unnest(generate_series(1, len(row_))) AS c FROM (
    SELECT page_id, t, r, tab[r] AS row_ FROM (
      SELECT page_id, t, tab, unnest(generate_series(1, len(tab))) AS r FROM (
        SELECT page_id, t, tables[t] AS tab FROM (SELECT page_id, tables, unnest(generate_series(1, len(tables))) AS t FROM pages)))))""",
}
