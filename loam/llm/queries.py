"""Queries of the text problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import WS
from loam.llm import frame, mixing, repeated, residue, scans, splitting, subjects, tokenize
from loam.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found(table(spark, folder, "pdfs"))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of files, repaired."""
    return scans.repaired(table(spark, folder, "pdfs"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(splitting.items(table(spark, folder, "pages"), table(spark, folder, "pdfs")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(splitting.pieces(splitting.items(table(spark, folder, "pages"), table(spark, folder, "pdfs")), with_text=False))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, folder, "pages"))


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated blocks of 1, 2, 4, ... lines."""
    return repeated.block_counts(table(spark, folder, "pages"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return repeated.remove_lines(pages, repeated.repeated_lines(pages))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pages(table(spark, folder, "pages"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of pages without residue."""
    pages = table(spark, folder, "pages")
    return residue.clean_pages(pages.select("page_id", "url", "title", "content"), residue.residue_pages(pages))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return frame.frames(table(spark, folder, "pages"))


def p7_body(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return frame.main_body(pages, frame.frames(pages))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "ids")


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids decoded again, against the text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = tokenize.encode(docs, "doc_id", "text").join(docs, "doc_id")
    return coded.select("doc_id", (tokenize.decode(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    sizes = tokenize.encode(docs, "doc_id", "text", keep=("source",)).select("doc_id", "source", F.size("ids").alias("n_tokens"))
    return mixing.mix(sizes, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, folder))


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return subjects.doc_subjects(docs, subjects.fit(docs, table(spark, folder, "doc_labels"), table(spark, folder, "subjects")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder).select("doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The make-up of the corpus by area."""
    return subjects.composition(table(spark, folder, "documents"), _areas(spark, folder))


QUERIES = {
    "p1_found": p1_found,
    "p1_text": p1_text,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p5_found": p5_found,
    "p5_blocks": p5_blocks,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_body": p7_body,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_NOT_WS = "[^" + WS[1:]
_P5 = f"""
WITH l AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS site, regexp_replace(lower(split_part(url, '#', 1)), '/+$', '') AS k,
         unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM pages WHERE url IS NOT NULL),
n AS (SELECT *, regexp_replace(lower(trim(regexp_replace(t, '{WS}+', ' ', 'g'))), '[0-9]+', '0', 'g') AS x FROM l),
f AS (SELECT site, x FROM n WHERE x <> '' GROUP BY site, x HAVING count(DISTINCT k) >= 6)"""
ORACLES = {
    "p5_blocks": f"""{_P5.replace("f AS", "g AS")},
w AS (SELECT page_id, site, k, list(x ORDER BY line_no) AS xs FROM n WHERE x <> '' GROUP BY 1, 2, 3),
s AS (SELECT site, k, xs, unnest(range(1, len(xs) + 1)) AS i FROM w),
v AS (SELECT site, k, l, xs[i : i + (1 << l) - 1] AS b FROM s, (SELECT unnest(range(0, 20)) AS l) WHERE i + (1 << l) - 1 <= len(xs)),
c AS (SELECT site, l, b, count(DISTINCT k) AS docs FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT k) >= 6)
SELECT CAST(1 << l AS BIGINT) AS lines, count(*) AS blocks, max(docs) AS most_docs FROM c GROUP BY 1""",
    "p5_found": f"{_P5} SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN f USING (site, x)",
    "p5_clean": f"""{_P5},
d AS (SELECT page_id, string_agg(t, chr(10) ORDER BY line_no) FILTER (WHERE f.x IS NULL) AS c FROM n LEFT JOIN f USING (site, x) GROUP BY page_id)
SELECT p.page_id, CASE WHEN p.content IS NULL OR p.url IS NULL THEN p.content ELSE coalesce(d.c, '') END AS content FROM pages p LEFT JOIN d USING (page_id)""",
    "p3_found": f"""
SELECT rec_kind, rec_id, CAST(regexp_matches(text, '{_NOT_WS}{{1000}}{_NOT_WS}{{201}}') AS INTEGER) AS forced FROM (
  SELECT 'page' AS rec_kind, page_id AS rec_id, content AS text FROM pages UNION ALL SELECT 'pdf', pdf_id, text FROM pdfs)
WHERE length(text) > 1200""",
    "p8_round_trip": "SELECT doc_id, true AS same FROM documents",
}
