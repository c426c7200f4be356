"""Queries of the corpus operators, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from loam.functions import categories, dates, text, urls
from loam.functions.text import WS
from loam.operators import chunk, conversation, crawl, files, items, ledger, links, matching, replay, snapshot_diff, vectors, xhr
from loam.sources import sitemap
from loam.sources.tables import table

DOMAIN = "vandalpur-tech.example"
NOW = "2024-02-15 00:00:00"
LEAST_SCORE = 0.25
EVERY = 100


def _t(name: str):
    return lambda s, d: table(s, d, name)


pages, pdfs, link_rows, snaps, docs, events, emb = map(_t, ("pages", "pdfs", "links", "snapshots", "documents", "events", "embeddings"))

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Urls and links ----------------------------------------------------------------------------------------------------
_KEY = "regexp_replace(lower(split_part(url, '#', 1)), '/+$', '')"
_SITE = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SEG = f"lower(regexp_extract({_PATH}, '^/*([^/]+)', 1))"


@query(f"SELECT page_id, {_KEY} AS url_key, {_SITE} AS site FROM pages")
def url_key(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", urls.url_key(F.col("url")).alias("url_key"), urls.site(F.col("url")).alias("site"))


@query(f"SELECT page_id, {_SEG} AS segment FROM pages")
def url_segment(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", urls.first_segment(F.col("url")).alias("segment"))


@query(f"""SELECT link_id, coalesce(contains({_SITE}, '{DOMAIN}') AND NOT (""" + " OR ".join([f"ends_with(lower({_PATH}), '{e}')" for e in urls.SKIPPED_ENDINGS] + [f"contains(lower(url), '{p}')" for p in urls.SKIPPED_PARTS]) + """), false) AS valid FROM links""")
def url_valid(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(spark, d).select("link_id", urls.is_valid(F.col("url"), DOMAIN).alias("valid"))


@query("SELECT lower(split_part(split_part(url, '#', 1), '?', 1)) AS pdf_key, arg_min(url, pdf_id) AS url, count(*) AS captures FROM pdfs WHERE url IS NOT NULL GROUP BY 1")
def pdf_key_unique(spark: SparkSession, d: str) -> DataFrame:
    return links.unique_pdfs(pdfs(spark, d))


@query(f"SELECT link_id, CASE WHEN contains(lower(url), '.pdf') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(?:jpg|jpeg|png|gif|webp)$') THEN 'image' WHEN contains(lower(url), '{DOMAIN}') THEN 'internal' ELSE 'external' END AS kind FROM links WHERE url IS NOT NULL")
def link_types(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(spark, d).where("url is not null").select("link_id", urls.link_type(F.col("url"), DOMAIN).alias("kind"))


_STATS = "SELECT source_url, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE link_type = '{k}') AS {k}" for k in ("pdf", "internal", "external", "image")) + " FROM links WHERE source_url IS NOT NULL AND source_url <> '' GROUP BY 1"


@query(_STATS)
def page_link_stats(spark: SparkSession, d: str) -> DataFrame:
    return links.page_link_stats(link_rows(spark, d))


@query(f"SELECT source_url AS url, pdf AS pdf_count, row_number() OVER (ORDER BY pdf DESC, source_url) AS place FROM ({_STATS}) WHERE pdf > 0")
def page_link_ranking(spark: SparkSession, d: str) -> DataFrame:
    return links.pdf_ranking(link_rows(spark, d))


@query("""SELECT snapshot_id, source_url, url, min(link_id) AS link_id, arg_min(coalesce(text, chr(0)), link_id) AS text, arg_min(link_type, link_id) AS link_type FROM links
WHERE url IS NOT NULL AND url <> '' AND NOT starts_with(lower(url), 'javascript:') AND NOT starts_with(lower(url), 'mailto:') AND NOT starts_with(lower(url), 'tel:') AND url <> '#' GROUP BY 1, 2, 3""")
def link_clean(spark: SparkSession, d: str) -> DataFrame:
    return links.cleaned(link_rows(spark, d)).withColumn("text", F.coalesce("text", F.lit("\0")))


@query("SELECT DISTINCT link_type FROM links WHERE link_type IS NOT NULL")
def link_type_list(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(spark, d).where("link_type is not null").select("link_type").distinct()


@query("SELECT link_id, url, text FROM links WHERE link_type = 'pdf'")
def links_of_type(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(spark, d).where("link_type = 'pdf'").select("link_id", "url", "text")


@query("""SELECT l.link_id, coalesce(p.title, l.source_title) AS source_title FROM links l LEFT JOIN (
  SELECT snapshot_id, url, arg_max(title, page_id) AS title FROM pages WHERE title IS NOT NULL GROUP BY 1, 2) p ON l.snapshot_id = p.snapshot_id AND l.source_url = p.url""")
def link_backfill(spark: SparkSession, d: str) -> DataFrame:
    return links.with_source_titles(link_rows(spark, d), pages(spark, d)).select("link_id", "source_title")


_LK = f"regexp_replace(lower(coalesce(X, '')), '{WS}+', '_', 'g')"
_LINK_DB = f"""
WITH e AS (
  SELECT 'pdf_' || {_LK.replace('X', 'text')} AS key, 1 AS a, link_id AS b, 0 AS c, 'pdf' AS type, url, coalesce(text, '') AS text, NULL AS category, context FROM links WHERE link_type = 'pdf' AND url IS NOT NULL
  UNION ALL SELECT 'pdf_' || lower(regexp_replace(split_part(url, '/', -1), '^(.*?)\\.pdf', '\\1')), 1, link_id, 1, 'pdf', url, coalesce(text, ''), NULL, context FROM links WHERE link_type = 'pdf' AND url IS NOT NULL
  UNION ALL SELECT 'page_' || {_LK.replace('X', 'text')}, 2, link_id, 0, 'page', url, coalesce(text, ''), NULL, context FROM links WHERE link_type = 'internal' AND url IS NOT NULL
  UNION ALL SELECT 'page_' || {_LK.replace('X', 'title')}, 3, page_id, 0, 'page', url, coalesce(title, ''), category, NULL FROM pages
  UNION ALL SELECT 'pdf_' || {_LK.replace('X', 'title')}, 4, pdf_id, 0, 'pdf_document', url, coalesce(title, ''), category, NULL FROM pdfs),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY a, b, c) AS f, row_number() OVER (PARTITION BY key ORDER BY a DESC, b DESC, c DESC) AS l FROM e)
SELECT x.key, x.a AS first_kind, x.b AS first_id, y.type, y.url, y.text, y.category, y.context FROM r x JOIN r y ON x.key = y.key AND x.f = 1 AND y.l = 1"""


@query(f"SELECT key, first_kind, first_id, type, url, text FROM ({_LINK_DB})")
def link_database(spark: SparkSession, d: str) -> DataFrame:
    held = links.link_database(link_rows(spark, d), pages(spark, d), pdfs(spark, d))
    return held.select("key", F.col("first.a").alias("first_kind"), F.col("first.b").alias("first_id"), "type", "url", "text")


@query(f"""WITH q AS (SELECT doc_id AS q_id, lower(regexp_replace(trim(text), '{WS}+', ' ', 'g')) AS question FROM documents WHERE doc_id % {EVERY} = 0 AND text IS NOT NULL),
db AS ({_LINK_DB}), l AS (SELECT key, first_kind, first_id, lower(text) AS t, category FROM db),
h AS (SELECT q_id, key, first_kind, first_id FROM q JOIN l ON contains(question, t) OR contains(t, question) OR (category <> '' AND contains(question, category)))
SELECT q_id, key, rank FROM (SELECT q_id, key, row_number() OVER (PARTITION BY q_id ORDER BY first_kind, first_id, key) AS rank FROM h) WHERE rank <= 5""")
def link_match(spark: SparkSession, d: str) -> DataFrame:
    q = docs(spark, d).where(f"doc_id % {EVERY} = 0 and text is not null").select(F.col("doc_id").alias("q_id"), F.regexp_replace(F.trim("text"), f"{WS}+", " ").alias("question"))
    db = links.link_database(link_rows(spark, d), pages(spark, d), pdfs(spark, d))
    first = db.withColumn("first", F.struct("first.a", "first.b"))
    return matching.match_links(q, first)


# Categories, dates, policies ---------------------------------------------------------------------------------------
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in categories.SEGMENTS.items()) + "}"
_BY_URL = f"coalesce({_MAP}[{_SEG}], CASE WHEN ends_with({_SEG}, 's') THEN {_MAP}[regexp_replace({_SEG}, 's$', '')] END)"
_BY_TEXT = "CASE " + " ".join(rf"WHEN regexp_matches(coalesce(content, ''), '(?i)\b(?:{w})\b') THEN '{n}'" for n, w in categories.CONTENT_WORDS) + " END"


@query(f"SELECT page_id, {_BY_URL} AS category FROM pages")
def category_by_url(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", categories.from_url(F.col("url")).alias("category"))


@query(f"SELECT page_id, {_BY_TEXT} AS category FROM pages")
def category_by_content(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", categories.from_content(F.coalesce("content", F.lit(""))).alias("category"))


@query(f"SELECT coalesce({_BY_URL}, {_BY_TEXT}, 'general') AS category, count(*) AS n, min(page_id) AS first_id FROM pages GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy(categories.category(F.col("url"), F.col("content")).alias("category")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


@query("SELECT pdf_id, CASE " + " ".join(f"WHEN contains(lower(url), '{f}') THEN '{n}'" for f, n in categories.FOLDERS) + " END AS category FROM pdfs")
def pdf_category(spark: SparkSession, d: str) -> DataFrame:
    return pdfs(spark, d).select("pdf_id", categories.pdf_category(F.col("url")).alias("category"))


_AGE = "CASE lower(category) WHEN 'tender' THEN 6 WHEN 'notices' THEN 1 WHEN 'notice' THEN 1 WHEN 'notification' THEN 1 WHEN 'notifications' THEN 1 WHEN 'recruitments' THEN 1 END"


@query(f"""SELECT pdf_id, published_at IS NOT NULL AND published_at >= CAST(date_trunc('month', DATE '2024-02-15') - to_months({_AGE}) AS DATE) + 14 AS recent FROM pdfs WHERE ({_AGE}) IS NOT NULL""")
def pdf_policy(spark: SparkSession, d: str) -> DataFrame:
    """Files of categories with an age limit: whether they are dated and young enough."""
    limited = pdfs(spark, d).withColumn("months", dates.max_age(F.col("category"))).where("months is not null")
    cutoff = dates.months_ago(F.lit(NOW).cast("timestamp"), F.col("months"))
    return limited.select("pdf_id", F.coalesce(F.col("published_at") >= cutoff, F.lit(False)).alias("recent"))


@query("""SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events""")
def item_dates(spark: SparkSession, d: str) -> DataFrame:
    """Times read back from texts in milliseconds."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events(spark, d).select("event_id", F.unix_millis(dates.item_date(ms.cast("string"))).alias("ms"))


@query("""WITH ok AS (SELECT DISTINCT lower(url) AS u FROM pdfs WHERE published_at IS NOT NULL),
c AS (SELECT pdf_id, url, coalesce(nullif(category, ''), CASE WHEN contains(lower(url), '/uploads/tender/') THEN 'tender' WHEN contains(lower(url), '/uploads/notices/') OR contains(lower(url), '/uploads/recruitments/') THEN 'notices' END) AS c FROM pdfs)
SELECT pdf_id FROM c WHERE coalesce(lower(c), '') NOT IN ('tender', 'notices') OR lower(url) IN (SELECT u FROM ok)""")
def pdf_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Tender and notice files only if they are listed with a date; others pass."""
    p = pdfs(spark, d)
    listed = p.where("published_at is not null and url is not null").select(F.lower("url").alias("file_key")).distinct()
    return files.allowed(p, listed).select("pdf_id")


# Texts and items ---------------------------------------------------------------------------------------------------
_SQ = f"trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(CASE WHEN {_SQ} = '' THEN 0 ELSE len(string_split({_SQ}, ' ')) END AS BIGINT) AS words, CAST(coalesce(len(string_split(text, ' ')), 0) AS BIGINT) AS pieces FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).alias("words"), text.space_pieces(F.col("text")).alias("pieces"))


_QK = f"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(title, ''), '{WS}+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}} ]+', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, left(sha256({_QK}), 32) AS key FROM documents")
def query_key(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.short_hash(text.query_key(F.col("title"))).alias("key"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split({_QK}, ' '), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)), ' ') AS key FROM documents")
def query_key_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.query_key(F.col("title"), True).alias("key"))


@query()
def query_key_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.query_key_nfkc(F.col("title")).alias("key"))


_E = lambda c: f"coalesce({c}, '')"
_GEN = "coalesce(nullif(category, ''), 'general')"
_ROWS = "flatten(coalesce(tables, []))"
_TRIMMED = f"list_transform({_ROWS}, lambda r: list_transform(r, lambda c: coalesce(trim(c), '')))"
_LINES = f"list_transform(list_filter({_TRIMMED}, lambda r: len(list_filter(r, lambda c: c <> '')) > 0), lambda r: array_to_string(r, ' | '))"
_HEADS = "array_to_string(list_transform(coalesce(headings, []), lambda h: 'Heading ' || coalesce(CAST(h.level AS VARCHAR), '') || ': ' || coalesce(h.text, '')), chr(10))"
_LISTS = "array_to_string(list_transform(coalesce(lists, []), lambda xs: array_to_string(list_transform(xs, lambda x: '- ' || coalesce(x, '')), chr(10))), chr(10) || chr(10))"
_PAGE = f"array_to_string(list_filter(['Title: ' || {_E('title')}, 'URL: ' || {_E('url')}, 'Category: ' || {_GEN}, {_HEADS}, {_E('content')}, array_to_string({_LINES}, chr(10)), {_LISTS}, 'Description: ' || {_E('metadata.description')}, 'Keywords: ' || {_E('metadata.keywords')}], lambda p: p <> ''), chr(10) || chr(10))"
_PDF = f"'PDF Title: ' || {_E('title')} || chr(10) || chr(10) || 'URL: ' || {_E('url')} || chr(10) || chr(10) || 'Category: ' || {_GEN} || chr(10) || chr(10) || 'Pages: ' || coalesce(CAST(pages AS VARCHAR), '') || chr(10) || chr(10) || 'Source Page: ' || coalesce(nullif(parent_page_title, ''), 'Unknown') || chr(10) || chr(10) || 'Content: ' || {_E('text')}"
_TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
_ITEMS = f"""(
SELECT snapshot_id, url, 'page' AS type, {_E('title')} AS title, {_GEN} AS category, {_PAGE} AS text FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, url ORDER BY ts DESC NULLS LAST, page_id DESC) AS n FROM pages WHERE url IS NOT NULL) WHERE n = 1 AND length({_TRIM(_PAGE)}) > 100
UNION ALL
SELECT snapshot_id, url, 'pdf', {_E('title')}, {_GEN}, {_PDF} FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, url ORDER BY ts DESC NULLS LAST, pdf_id DESC) AS n FROM pdfs WHERE url IS NOT NULL) WHERE n = 1 AND length({_TRIM(_E('text'))}) > 100)"""


@query(f"SELECT page_id, sha256({_PAGE}) AS hash FROM pages")
def structured_text(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return p.select("page_id", F.sha2(items.page_text(p), 256).alias("hash"))


@query(f"SELECT page_id, array_to_string({_LINES}, chr(10)) AS lines, array_to_string(list_filter(list_transform({_TRIMMED}, lambda r: array_to_string(list_filter(r, lambda c: c <> ''), ' ')), lambda x: x <> ''), chr(10)) AS plain FROM pages")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.array_join(items.table_lines(F.col("tables")), "\n").alias("lines"), F.array_join(items.table_text(F.col("tables")), "\n").alias("plain"))


@query(f"SELECT snapshot_id, url, type, title, category, sha256(text) AS hash, CAST(len(string_split({_SQ}, ' ')) AS BIGINT) AS word_count FROM {_ITEMS}")
def items_union(spark: SparkSession, d: str) -> DataFrame:
    held = items.items(pages(spark, d), pdfs(spark, d))
    return held.select("snapshot_id", "url", "type", "title", "category", F.sha2("text", 256).alias("hash"), "word_count")


@query("""WITH p AS (SELECT snapshot_id, string_agg('- ' || coalesce(text, '') || ' - ' || coalesce(url, '') || ' (Found on: ' || coalesce(source_title, '') || ')', chr(10) ORDER BY link_id) AS t FROM links WHERE link_type = 'pdf' GROUP BY 1),
i AS (SELECT snapshot_id, string_agg('- ' || coalesce(text, '') || ' - ' || coalesce(url, ''), chr(10) ORDER BY link_id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY link_id) AS n FROM links WHERE link_type = 'internal') WHERE n <= 50 GROUP BY 1)
SELECT coalesce(p.snapshot_id, i.snapshot_id) AS snapshot_id, sha256('PDF Documents Available:' || chr(10) || coalesce(p.t, 'No PDFs found') || chr(10) || chr(10) || 'Internal Pages:' || chr(10) || coalesce(i.t, 'No internal links found')) AS hash FROM p FULL JOIN i ON p.snapshot_id = i.snapshot_id""")
def links_directory(spark: SparkSession, d: str) -> DataFrame:
    return items.links_directory(link_rows(spark, d)).select("snapshot_id", F.sha2("text", 256).alias("hash"))


@query(f"""WITH c AS (SELECT snapshot_id, {_GEN} AS c, count(*) AS n FROM pages GROUP BY 1, 2),
p AS (SELECT snapshot_id, sum(n) AS n, string_agg('- ' || c || ': ' || n || ' pages', chr(10) ORDER BY '- ' || c || ': ' || n || ' pages') AS t FROM c GROUP BY 1)
SELECT p.snapshot_id, 'Total Pages Scraped: ' || p.n || chr(10) || 'Total PDF Documents: ' || coalesce(f.n, 0) || chr(10) || 'Total Links Found: ' || coalesce(l.n, 0) || chr(10) || 'Categories Breakdown:' || chr(10) || p.t || chr(10) || chr(10) || 'Available PDF Documents:' || chr(10) || coalesce(f.t, 'No PDFs processed') AS text
FROM p LEFT JOIN (SELECT snapshot_id, count(*) AS n, string_agg('- ' || coalesce(title, '') || ' (' || coalesce(pages, 0) || ' pages, ' || coalesce(word_count, 0) || ' words) - ' || {_GEN}, chr(10) ORDER BY pdf_id) AS t FROM pdfs GROUP BY 1) f USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM links GROUP BY 1) l USING (snapshot_id)""")
def stats_item(spark: SparkSession, d: str) -> DataFrame:
    return items.statistics_item(pages(spark, d), pdfs(spark, d), link_rows(spark, d))


@query(f"""SELECT p.page_id, p.url, coalesce(len(p.tables) > 0, false) AS has_tables, coalesce(len(p.lists) > 0, false) AS has_lists, coalesce(len(p.xhr_responses), 0) AS xhr_count,
  coalesce(s.total, 0) AS total, coalesce(s.pdf, 0) AS pdf, coalesce(s.internal, 0) AS internal, coalesce(s.external, 0) AS external, coalesce(s.image, 0) AS image, coalesce(s.total, 0) > 0 AS has_links
FROM pages p LEFT JOIN ({_STATS}) s ON p.url = s.source_url""")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return items.page_metadata(pages(spark, d), link_rows(spark, d))


@query(f"""SELECT s.snapshot_id, coalesce(p.n, 0) AS pages, coalesce(f.n, 0) AS pdfs, coalesce(l.n, 0) AS links, coalesce(p.c, 0) AS categories FROM snapshots s
LEFT JOIN (SELECT snapshot_id, count(*) AS n, count(DISTINCT {_GEN}) AS c FROM pages GROUP BY 1) p USING (snapshot_id)
LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM pdfs GROUP BY 1) f USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM links GROUP BY 1) l USING (snapshot_id)""")
def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    n = lambda df, name: df.groupBy("snapshot_id").agg(F.count("*").alias(name))
    p = pages(spark, d).groupBy("snapshot_id").agg(F.count("*").alias("pages"), F.count_distinct(categories.or_general(F.col("category"))).alias("categories"))
    return snaps(spark, d).select("snapshot_id").join(p, "snapshot_id", "left").join(n(pdfs(spark, d), "pdfs"), "snapshot_id", "left").join(n(link_rows(spark, d), "links"), "snapshot_id", "left").fillna(0)


# Ledger: the items of each snapshot in the order of ids against those of the snapshot before ------------------------
_RANKED = "(SELECT snapshot_id, row_number() OVER (ORDER BY taken_at DESC NULLS LAST, snapshot_id DESC) AS r FROM snapshots)"
_LAST, _BEFORE = (f"(SELECT snapshot_id FROM {_RANKED} WHERE r = {r})" for r in (1, 2))
_NOW, _OLD = f"(SELECT url, text FROM {_ITEMS} WHERE snapshot_id = {_LAST})", f"(SELECT url, sha256({_TRIM('text')}) AS content_hash, length(url) % 11 = 0 AS deleted, 1 AS version, text FROM {_ITEMS} WHERE snapshot_id = {_BEFORE})"
_STATUS = f"""SELECT n.url, sha256({_TRIM('n.text')}) AS hash, CASE WHEN o.content_hash IS NULL OR o.deleted THEN 'NEW' WHEN o.content_hash = sha256({_TRIM('n.text')}) THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM {_NOW} n LEFT JOIN {_OLD} o USING (url)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items of the latest run, and the ledger that the run before it left (some pages marked as deleted)."""
    every = items.items(pages(spark, d), pdfs(spark, d))
    ranks = snapshot_diff.snapshot_ranks(snaps(spark, d)).orderBy(F.desc("rank")).limit(2)
    held = every.join(F.broadcast(ranks), "snapshot_id")
    now = held.where("next_id is null").select("url", "text")
    old = held.where("next_id is not null").select("url", F.sha2(text.trim_ws(F.col("text")), 256).alias("content_hash"), (F.length("url") % 11 == 0).alias("deleted"), F.lit(1).alias("version"), "text")
    return now, old


@query(_STATUS)
def ledger_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.page_plan(*_runs(spark, d))


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY 1")
def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.page_plan(*_runs(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT coalesce(s.url, o.url) AS url, coalesce(s.hash, o.content_hash) AS content_hash, CAST(coalesce(o.version, 0) + CASE WHEN s.status IN ('NEW', 'MODIFIED') THEN 1 ELSE 0 END AS BIGINT) AS version, CASE WHEN s.status IS NOT NULL THEN false ELSE o.deleted END AS deleted
FROM ({_STATUS}) s FULL JOIN {_OLD} o ON s.url = o.url""")
def ledger_pages_merged(spark: SparkSession, d: str) -> DataFrame:
    now, old = _runs(spark, d)
    return ledger.merge_pages(ledger.page_plan(now, old), old)


def _chunk_sql(src: str) -> str:
    return f"""(SELECT url, i - 1 AS idx, len(ls) AS total, sha256(ls[i]) AS text_hash, left(sha256(url), 12) || ':' || printf('%04d', i - 1) || ':' || left(sha256(ls[i]), 10) AS chunk_id FROM (
  SELECT url, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT url, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM {src})))"""


@query(f"SELECT url, CAST(idx AS INTEGER) AS idx, CAST(total AS BIGINT) AS total, text_hash, chunk_id FROM {_chunk_sql(_NOW)}")
def chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return ledger.line_chunks(_runs(spark, d)[0]).drop("text")


@query(f"SELECT n.url, n.chunk_id FROM {_chunk_sql(_NOW)} n ANTI JOIN {_chunk_sql(_OLD)} o ON n.url = o.url AND n.chunk_id = o.chunk_id AND n.text_hash = o.text_hash")
def chunks_to_embed(spark: SparkSession, d: str) -> DataFrame:
    now, old = _runs(spark, d)
    return ledger.to_embed(ledger.line_chunks(now), ledger.line_chunks(old)).select("url", "chunk_id")


@query(f"SELECT o.url, o.chunk_id FROM {_chunk_sql(_OLD)} o SEMI JOIN {_NOW} u ON o.url = u.url ANTI JOIN {_chunk_sql(_NOW)} n ON o.chunk_id = n.chunk_id")
def chunks_stale(spark: SparkSession, d: str) -> DataFrame:
    now, old = _runs(spark, d)
    return ledger.stale(ledger.line_chunks(now), ledger.line_chunks(old)).select("url", "chunk_id")


@query(f"""SELECT url, chunk_id, text_hash FROM {_chunk_sql(_NOW)} UNION ALL
SELECT o.url, o.chunk_id, o.text_hash FROM {_chunk_sql(_OLD)} o ANTI JOIN {_NOW} u ON o.url = u.url""")
def ledger_chunks_merged(spark: SparkSession, d: str) -> DataFrame:
    now, old = _runs(spark, d)
    return ledger.merge_chunks(ledger.line_chunks(now), ledger.line_chunks(old))


@query("""WITH s AS (SELECT snapshot_id, row_number() OVER (ORDER BY taken_at NULLS FIRST, snapshot_id) AS r FROM snapshots),
p AS (SELECT pdfs.*, row_number() OVER (ORDER BY coalesce(r, 0), ts NULLS FIRST, pdf_id) AS o FROM pdfs LEFT JOIN s USING (snapshot_id) WHERE url IS NOT NULL)
SELECT url, arg_max_null(title, o) AS title, arg_max(category, o) FILTER (WHERE category <> '') AS category, arg_max(parent_page_title, o) FILTER (WHERE parent_page_title <> '') AS parent_page_title, arg_max(pages, o) FILTER (WHERE pages <> 0) AS pages, arg_max(word_count, o) FILTER (WHERE word_count <> 0) AS word_count FROM p GROUP BY url""")
def pdf_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All captures of files folded in the order of their snapshots."""
    ranks = snapshot_diff.snapshot_ranks(snaps(spark, d)).select("snapshot_id", "rank")
    held = pdfs(spark, d).join(ranks, "snapshot_id", "left")
    return files.merged(held, F.struct(F.coalesce("rank", F.lit(0)), "ts", "pdf_id"))


# Vectors -----------------------------------------------------------------------------------------------------------
_V = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_TOP = f"""(SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS place FROM (
  SELECT q.vec_id AS q_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM {_V} q JOIN {_V} v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0) QUALIFY place <= 8)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    v = emb(spark, d)
    return vectors.top_k(v, v.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("q_id"), "embedding"))


@query(f"SELECT * FROM {_TOP}")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(f"""WITH h AS (SELECT h.*, d.url, d.title, left(coalesce(d.text, ''), 200) || '...' AS text FROM {_TOP} h JOIN documents d ON h.vec_id = d.doc_id WHERE score >= {LEAST_SCORE}),
f AS (SELECT *, row_number() OVER (PARTITION BY q_id, url ORDER BY place) AS n FROM h)
SELECT q_id, url, title, score, text, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, place) AS rank FROM f WHERE n = 1 OR url IS NULL OR url = ''""")
def sources_ranked(spark: SparkSession, d: str) -> DataFrame:
    return vectors.sources(_hits(spark, d), docs(spark, d), LEAST_SCORE)


@query(f"SELECT q_id, max(score) AS confidence FROM {_TOP} GROUP BY 1")
def confidence_per_query(spark: SparkSession, d: str) -> DataFrame:
    return vectors.confidence(_hits(spark, d))


@query(f"""SELECT q_id, string_agg('[Page ' || place || ': ' || coalesce(title, '') || '] ' || left(coalesce(text, ''), 1000), chr(10) || chr(10) ORDER BY place) AS context FROM {_TOP} h JOIN documents d ON h.vec_id = d.doc_id GROUP BY 1""")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return conversation.context(_hits(spark, d), docs(spark, d))


BITS, RADIUS = 8, 1
_PLANES = vectors.planes(BITS, 64)
_SIG = "(SELECT vec_id, CAST(" + " + ".join(f"CASE WHEN round(list_dot_product(CAST(embedding AS DOUBLE[]), [{', '.join(map(repr, p))}]::DOUBLE[]), 9) >= 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(_PLANES)) + " AS BIGINT) AS sig FROM embeddings)"
_NEAR = f"(SELECT q.vec_id AS q_id, v.vec_id FROM {_SIG} q JOIN {_SIG} v ON bit_count(xor(q.sig, v.sig)) <= {RADIUS} AND q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0)"


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).withColumn("sig", vectors.signature(F.col("embedding"), _PLANES))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    s = _signed(spark, d)
    return vectors.near(s.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("q_id"), "sig"), s, BITS, RADIUS)


@query(_SIG)
def lsh_signature(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("vec_id", "sig")


@query(_NEAR)
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


@query(f"""SELECT q_id, vec_id, score FROM (SELECT n.q_id, n.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score, row_number() OVER (PARTITION BY n.q_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, n.vec_id) AS r
FROM {_NEAR} n JOIN {_V} q ON q.vec_id = n.q_id JOIN {_V} v ON v.vec_id = n.vec_id) WHERE r = 1 AND score >= {LEAST_SCORE}""")
def lsh_best_hit(spark: SparkSession, d: str) -> DataFrame:
    return vectors.best_hit(_candidates(spark, d), emb(spark, d), LEAST_SCORE)


# Conversations (events as messages) and replays --------------------------------------------------------------------
def _messages(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("msg_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise("SYSTEM").alias("role"), F.col("props").alias("content"))


@query("SELECT user_id AS session_id, event_id AS msg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 30")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return conversation.recent(_messages(spark, d)).select("session_id", "msg_id", "place")


@query("""SELECT user_id AS session_id, string_agg(CASE WHEN event_type = 'click' THEN 'User: ' ELSE 'Assistant: ' END || trim(coalesce(props, '')), chr(10) ORDER BY ts, event_id) AS history FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10 GROUP BY 1""")
def prompt_history(spark: SparkSession, d: str) -> DataFrame:
    return conversation.prompt_history(_messages(spark, d))


@query("SELECT event_id AS msg_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def cache_bypass(spark: SparkSession, d: str) -> DataFrame:
    return conversation.without_history(_messages(spark, d))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) > 1 AS hit FROM events")
def embed_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.cache_replay(events(spark, d).withColumn("key", F.concat_ws("|", "event_type", "user_id")), "key")


def _limit_sql(key: str, hours: int, limit: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, ts, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT k, min(ts) AS t FROM e GROUP BY k UNION ALL SELECT * FROM (SELECT s.k, (SELECT min(e.ts) FROM e WHERE e.k = s.k AND e.ts > s.t + INTERVAL {hours} HOUR) AS t FROM s) WHERE t IS NOT NULL)
SELECT event_id, row_number() OVER (PARTITION BY e.k, s.t ORDER BY e.ts, e.event_id) <= {limit} AS allowed FROM e ASOF JOIN s ON e.k = s.k AND e.ts >= s.t"""


@query(_limit_sql("user_id", 6, 1))
def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.rate_limit(events(spark, d), "user_id", 1, 6 * 3600)


@query(_limit_sql("event_type", 24, 10))
def rate_limit_by_type(spark: SparkSession, d: str) -> DataFrame:
    return replay.rate_limit(events(spark, d), "event_type", 10, 24 * 3600)


@query()
def lru_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.lru_replay(events(spark, d), "event_type", "user_id", 20)


# Crawl, sitemaps, captured responses, chunks -----------------------------------------------------------------------
_NK = lambda c: f"regexp_replace(lower({c}), '/+$', '')"


@query(f"""WITH RECURSIVE g AS (SELECT DISTINCT {_NK('source_url')} AS s, {_NK('url')} AS t FROM links WHERE source_url IS NOT NULL AND url IS NOT NULL),
w AS (SELECT DISTINCT {_NK('base_url')} AS url, 0 AS depth FROM snapshots UNION SELECT g.t, w.depth + 1 FROM w JOIN g ON g.s = w.url WHERE w.depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY 1""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    edges = link_rows(spark, d).select(F.col("source_url").alias("source"), F.col("url").alias("target"))
    return crawl.crawl(edges, snaps(spark, d).select(F.col("base_url").alias("url")), 3)


@query("SELECT page_id, url AS loc, strftime(ts, '%Y-%m-%d') AS lastmod FROM pages WHERE url IS NOT NULL AND ts IS NOT NULL AND NOT contains(url, '<') AND NOT contains(url, ' ')")
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries read from url blocks that are written from the pages."""
    xml = F.concat(F.lit("<urlset><URL>\n<loc> "), F.col("url"), F.lit(" </loc><lastmod>"), F.date_format("ts", "yyyy-MM-dd"), F.lit(" </lastmod></URL><url><x/></url></urlset>"))
    p = pages(spark, d).where("url is not null and ts is not null and not contains(url, '<') and not contains(url, ' ')")
    return sitemap.entries(p.select("page_id", xml.alias("xml")), keep=("page_id",))


@query("""SELECT page_id, pos - 1 AS pos, r.status AS status FROM (SELECT page_id, r, pos, row_number() OVER (PARTITION BY page_id, r.url ORDER BY pos) AS n FROM (
  SELECT page_id, unnest(xhr_responses) AS r, generate_subscripts(xhr_responses, 1) AS pos FROM pages) WHERE r.url IS NOT NULL """ + " ".join(f"AND NOT contains(lower(r.url), '{x}')" for x in xhr.IGNORED) + ") WHERE n = 1 AND r.status BETWEEN 200 AND 299 AND json_valid(r.data) AND json_type(r.data) IN ('OBJECT', 'ARRAY')")
def xhr_accepted(spark: SparkSession, d: str) -> DataFrame:
    return xhr.accepted(pages(spark, d)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "status")


@query()
def xhr_items(spark: SparkSession, d: str) -> DataFrame:
    return xhr.item_rows(pages(spark, d))


@query()
def json_fragments(spark: SparkSession, d: str) -> DataFrame:
    return xhr.fragment_rows(pages(spark, d))


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(docs(spark, d), "doc_id", "text")


@query("SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT url) FROM pages) AS urls, (SELECT count(*) FROM pdfs) AS pdfs, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM embeddings) AS vectors")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    parts = [pages(spark, d).agg(F.count("*").alias("n"), F.count_distinct("url").alias("u")).select(F.lit("pages").alias("k"), "n", "u")]
    parts += [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n", F.lit(0).cast("bigint").alias("u")) for k, df in (("pdfs", pdfs(spark, d)), ("links", link_rows(spark, d)), ("vectors", emb(spark, d)))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n = lambda k: F.max(F.when(F.col("k") == k, F.col("n"))).alias(k)
    return every.agg(n("pages"), F.max("u").alias("urls"), n("pdfs"), n("links"), n("vectors"))


