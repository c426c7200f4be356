"""Queries of files, policies, link answers, whole ledgers and codecs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import categories, codec, dates, language, urls
from loam.operators import crawl, files, items, ledger, links, matching, replay, snapshot_diff, vectors, xhr
from loam.plans import corpus
from loam.plans.corpus import LEAST_SCORE, NOW, _E, _GEN, _LINK_DB, _TOP, docs, emb, events, link_rows, pages, pdfs, snaps
from loam.sources import dom
from loam.sources.snapshots import statistics

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_NOW_SQL = "DATE '2024-02-15'"
_MONTHS = lambda n: f"(CAST(date_trunc('month', {_NOW_SQL}) - to_months({n}) AS DATE) + 14)"

# Urls and codecs ---------------------------------------------------------------------------------------------------


@query("""SELECT link_id, lower(CASE WHEN p = '' THEN source_url ELSE regexp_extract(source_url, '^[A-Za-z]+://[^/?#]+', 0) || p END) AS key FROM (
SELECT link_id, source_url, regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[A-Za-z0-9_/.-]*)?', 1) AS p FROM links WHERE regexp_matches(source_url, '^https?://[^/?#]+/[A-Za-z0-9_/.-]*$') AND url IS NOT NULL)
WHERE NOT contains(p, './') AND NOT ends_with(p, '/.') AND NOT ends_with(p, '..') AND NOT starts_with(p, '//')""")
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Paths of links, resolved against the page they stand on."""
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+(/[A-Za-z0-9_/.-]*)?", 1)
    held = link_rows(spark, d).where(F.col("source_url").rlike(r"^https?://[^/?#]+/[A-Za-z0-9_/.-]*$") & F.col("url").isNotNull()).select("link_id", "source_url", path.alias("p"))
    plain = ~F.contains("p", F.lit("./")) & ~F.endswith("p", F.lit("/.")) & ~F.endswith("p", F.lit("..")) & ~F.startswith("p", F.lit("//"))
    return held.where(plain).select("link_id", urls.comparison_key(F.col("source_url"), F.col("p")).alias("key"))


@query("SELECT page_id, list_filter(list_transform(string_split(coalesce(metadata.keywords, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS entries FROM pages")
def input_lists(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", urls.input_list(F.col("metadata.keywords")).alias("entries"))


@query("""SELECT page_id, CASE WHEN len(list_intersect(list_transform(string_split(coalesce(metadata.keywords, ''), ','), lambda x: lower(trim(x))), ['announcement', 'notice', 'notifications', 'recruitments'])) > 0 THEN 'notices' END AS category FROM pages""")
def category_by_tags(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", categories.from_tags(urls.input_list(F.col("metadata.keywords"))).alias("category"))


@query("SELECT vec_id, embedding FROM embeddings")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as base64 and read back."""
    return emb(spark, d).select("vec_id", codec.decode_vector(codec.encode_vector(F.col("embedding"))).alias("embedding"))


@query("""SELECT doc_id, CASE WHEN lower(lang) IN ('english', 'hindi') THEN lower(lang) WHEN lang = 'hi' THEN 'hindi' ELSE 'english' END AS language, coalesce(lower(trim(title)) IN ('change-language', 'change language', 'bhasha badlo', 'भाषा बदलो', 'language change karo', '/language', '/lang'), false) AS change FROM documents""")
def languages(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", language.language(F.when(F.col("lang") == "hi", "Hindi").otherwise(F.col("lang"))).alias("language"), language.is_change_request(F.col("title")).alias("change"))


@query("SELECT doc_id, CASE WHEN lower(lang) = 'hi' THEN 'कुल ' || coalesce(CAST(n_chars AS VARCHAR), '{0}') ELSE coalesce(CAST(n_chars AS VARCHAR), '{0}') || ' in all, {1}' END AS text FROM documents")
def messages_filled(spark: SparkSession, d: str) -> DataFrame:
    held = {"total": {"english": "{0} in all, {1}", "hi": "कुल {0}"}}
    return docs(spark, d).select("doc_id", language.message(held, F.lit("total"), F.col("lang"), F.col("n_chars")).alias("text"))


@query("""SELECT link_id, url AS href, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM links
WHERE url IS NOT NULL AND url <> '' AND NOT regexp_matches(url, '[<>"&'' ]') AND NOT regexp_matches(coalesce(text, ''), '[^ -~ऀ-ॿ]')""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Anchors written as HTML and read by the page reader."""
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = link_rows(spark, d).where(F.col("url").isNotNull() & (F.col("url") != "") & ~F.col("url").rlike("[<>\"&' ]") & ~F.coalesce("text", F.lit("")).rlike("[^ -~ऀ-ॿ]"))
    html = plain.select("link_id", F.concat(F.lit('<html><body><div><a href="'), F.col("url"), F.lit('">'), safe, F.lit("</a></div></body></html>")).alias("html"))
    return dom.extract(html, "link_id", "html").select("link_id", F.explode("links").alias("a")).select("link_id", "a.href", "a.text")


_CLEAN = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""SELECT page_id, {_CLEAN('title')} AS title, list_filter(list_transform(coalesce(headings, []), lambda h: {_CLEAN('h.text')}), lambda t: t <> '') AS heads FROM pages
WHERE NOT regexp_matches(coalesce(title, '') || array_to_string(list_transform(coalesce(headings, []), lambda h: coalesce(h.text, '')), ''), '[^ -~\\sऀ-ॿ]')""")
def dom_extract(spark: SparkSession, d: str) -> DataFrame:
    """Title and headings written as HTML and read by the page reader."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    none = F.array().cast("array<struct<level:int,text:string,id:string>>")
    heads = F.transform(F.coalesce("headings", none), lambda h: F.coalesce(h["text"], F.lit("")))
    plain = pages(spark, d).where(~F.concat(F.coalesce("title", F.lit("")), F.array_join(heads, "")).rlike(r"[^ -~\sऀ-ॿ]"))
    body = F.array_join(F.transform(heads, lambda t: F.concat(F.lit("<h2 id=x>"), esc(t), F.lit("</h2>"))), "")
    html = plain.select("page_id", F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title></head><body>"), body, F.lit("<footer><h2>foot</h2></footer></body></html>")).alias("html"))
    return dom.extract(html, "page_id", "html").select("page_id", "title", F.transform("headings", lambda h: h["text"]).alias("heads"))


# Files and policies ------------------------------------------------------------------------------------------------


@query()
def captured_files(spark: SparkSession, d: str) -> DataFrame:
    """Files named by items of captured responses."""
    return files.captured_files(pages(spark, d), F.lit(NOW).cast("timestamp"))


@query(f"""SELECT pdf_id, published_at IS NULL OR published_at >= CASE lower(category) WHEN 'tender' THEN {_MONTHS(6)} WHEN 'notices' THEN {_MONTHS(1)} WHEN 'notice' THEN {_MONTHS(1)} WHEN 'notification' THEN {_MONTHS(1)} WHEN 'notifications' THEN {_MONTHS(1)} WHEN 'recruitments' THEN {_MONTHS(1)} ELSE DATE '0001-01-01' END AS recent FROM pdfs""")
def item_age(spark: SparkSession, d: str) -> DataFrame:
    """Whether files are young enough for their category; undated ones are."""
    return pdfs(spark, d).select("pdf_id", dates.is_recent(F.col("published_at"), F.col("category"), F.lit(NOW).cast("timestamp")).alias("recent"))


_FOLDER = "CASE WHEN contains(lower(url), '/uploads/tender/') THEN 'tender' WHEN contains(lower(url), '/uploads/notices/') THEN 'notices' WHEN contains(lower(url), '/uploads/recruitments/') THEN 'notices' END"
_LISTED = f"""(SELECT lower(url) AS file_key, arg_max(published_at, pdf_id) AS listed_at FROM pdfs WHERE ends_with(lower(url), '.pdf') AND published_at IS NOT NULL
  AND (({_FOLDER}) IS NULL OR published_at >= CASE {_FOLDER} WHEN 'tender' THEN {_MONTHS(6)} ELSE {_MONTHS(1)} END) GROUP BY 1)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """The files as a sitemap: their dates as the time of the last change."""
    return files.listed_files(pdfs(spark, d).select(F.col("url").alias("loc"), F.col("published_at").alias("lastmod"), F.col("pdf_id").alias("ord")), F.lit(NOW).cast("timestamp"))


@query(f"SELECT file_key, epoch_us(listed_at) AS listed_us FROM {_LISTED}")
def sitemap_policy(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("file_key", F.unix_micros(F.col("listed_at").cast("timestamp")).alias("listed_us"))


@query(f"SELECT pdf_id FROM pdfs WHERE url IS NOT NULL AND (coalesce(lower(coalesce(nullif(category, ''), {_FOLDER})), '') NOT IN ('tender', 'notices') OR lower(url) IN (SELECT file_key FROM {_LISTED}))")
def files_allowed(spark: SparkSession, d: str) -> DataFrame:
    return files.allowed(pdfs(spark, d).where("url is not null").select("pdf_id", "url", "category"), _listed(spark, d)).select("pdf_id")


@query(f"""SELECT pdf_id, epoch_us(coalesce(published_at, listed_at)) AS published_us, CASE WHEN published_at IS NOT NULL THEN published_at_source WHEN listed_at IS NOT NULL THEN 'sitemap' END AS source
FROM pdfs LEFT JOIN {_LISTED} l ON lower(pdfs.url) = l.file_key""")
def file_dates(spark: SparkSession, d: str) -> DataFrame:
    return files.with_dates(pdfs(spark, d), _listed(spark, d)).select("pdf_id", F.unix_micros(F.col("published_at").cast("timestamp")).alias("published_us"), F.col("published_at_source").alias("source"))


_SOME = lambda *cs: "coalesce(" + ", ".join(f"nullif(trim({c}, ' '), '')" for c in cs) + ")"


@query(f"""SELECT pdf_id, {_SOME('p.title', 'l.text', 'l.title', "split_part(p.url, '/', -1)", 'p.url')} AS title, coalesce(l.source_url, '') AS source_url, coalesce(l.source_title, '') AS source_title
FROM pdfs p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY link_id) AS n FROM links WHERE url IS NOT NULL) WHERE n = 1) l ON p.url = l.url""")
def file_records(spark: SparkSession, d: str) -> DataFrame:
    held = files.built(pdfs(spark, d).select("pdf_id", "url", "title", "category", "text"), link_rows(spark, d))
    return held.select("pdf_id", "title", "source_url", "source_title")


@query("""SELECT page_key, url, captured_at, status FROM (SELECT *, row_number() OVER (PARTITION BY page_key, coalesce(url, ''), captured_at ORDER BY page_id, pos) AS n FROM (
  SELECT page_key, page_id, pos, coalesce(r.url, '') AS url, r.captured_at AS captured_at, r.status AS status FROM (SELECT lower(url) AS page_key, page_id, unnest(xhr_responses) AS r, generate_subscripts(xhr_responses, 1) AS pos FROM pages WHERE url IS NOT NULL))) WHERE n = 1""")
def xhr_merge(spark: SparkSession, d: str) -> DataFrame:
    """Captured responses of all spellings of a page, each once."""
    each = pages(spark, d).where("url is not null").select(F.lower("url").alias("page_key"), "page_id", F.posexplode("xhr_responses").alias("pos", "r")).select("page_key", "page_id", "pos", "r.url", "r.captured_at", "r.status")
    return xhr.merged(each, ["page_id", "pos"]).select("page_key", "url", "captured_at", "status")


@query()
def xhr_sections(spark: SparkSession, d: str) -> DataFrame:
    return xhr.sections(pages(spark, d))


@query()
def page_text_captured(spark: SparkSession, d: str) -> DataFrame:
    """The structured text of pages with their captured responses."""
    p = pages(spark, d)
    held = p.join(xhr.sections(p).withColumnRenamed("text", "captured"), "page_id", "left")
    return held.select("page_id", F.sha2(items.page_text(held, F.col("captured")), 256).alias("hash"))


_TEXTS = "list_transform(flatten(coalesce(tables, [])), lambda r: array_to_string(list_filter(list_transform(r, lambda c: coalesce(trim(c), '')), lambda c: c <> ''), ' '))"


@query(f"""SELECT page_id, array_to_string(list_filter([title] || list_transform(coalesce(headings, []), lambda h: h.text) || coalesce(raw_content, []) || {_TEXTS} || flatten(coalesce(lists, [])) || [metadata.description, metadata.keywords], lambda x: coalesce(x, '') <> ''), ' ') AS content FROM pages""")
def page_content(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return p.select("page_id", items.page_content(p).alias("content"))


# Items, chunks, ledgers --------------------------------------------------------------------------------------------


_DIRECTORY = corpus.ORACLES["links_directory"].replace("sha256('PDF", "('PDF").replace(") AS hash FROM p FULL", ") AS text FROM p FULL")
_VIRTUAL = " UNION ALL ".join(f"SELECT snapshot_id, '{url}' AS url, 'page' AS type, '{title}' AS title, 'virtual' AS category, text FROM ({sql})" for url, title, sql in (("virtual://links-directory", "Website Links Directory", _DIRECTORY), ("virtual://statistics", "Website Statistics Overview", corpus.ORACLES["stats_item"])))


@query(f"""SELECT snapshot_id, url, type, title, category, sha256(text) AS hash, CAST(len(string_split({corpus._SQ}, ' ')) AS BIGINT) AS word_count FROM (
SELECT * FROM {corpus._ITEMS} UNION ALL SELECT * FROM ({_VIRTUAL}) WHERE length({corpus._TRIM('text')}) > 100)""")
def items_all(spark: SparkSession, d: str) -> DataFrame:
    """All four kinds of items."""
    held = items.all_items(pages(spark, d), pdfs(spark, d), link_rows(spark, d))
    return held.select("snapshot_id", "url", "type", "title", "category", F.sha2("text", 256).alias("hash"), "word_count")


_META = f"""(SELECT url, max(coalesce(len(tables) > 0, false)) AS has_tables, max(coalesce(len(lists) > 0, false)) AS has_lists, max(coalesce(len(xhr_responses), 0)) AS xhr_count FROM pages WHERE url IS NOT NULL GROUP BY 1)"""
_CHUNKS = corpus._chunk_sql(corpus._NOW)


@query(f"""SELECT n.chunk_id, n.url, left(n.text, 1000) AS text, CAST(n.idx AS BIGINT) AS chunk_index, CAST(n.total AS BIGINT) AS total_chunks,
  CASE WHEN m.url IS NOT NULL THEN '{{"total":' || coalesce(s.total, 0) || ',"pdf":' || coalesce(s.pdf, 0) || ',"internal":' || coalesce(s.internal, 0) || ',"external":' || coalesce(s.external, 0) || ',"image":' || coalesce(s.image, 0) || '}}' END AS link_stats,
  CASE WHEN m.url IS NOT NULL THEN coalesce(s.total, 0) > 0 END AS has_links, m.has_tables, m.has_lists, coalesce(m.xhr_count, 0) > 0 AS has_xhr, coalesce(m.xhr_count, 0) AS xhr_count
FROM {_CHUNKS.replace("sha256(ls[i]) AS text_hash", "ls[i] AS text, sha256(ls[i]) AS text_hash")} n LEFT JOIN {_META} m ON n.url = m.url LEFT JOIN ({corpus._STATS}) s ON m.url = s.source_url""")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    now, _ = corpus._runs(spark, d)
    held = items.page_metadata(pages(spark, d), link_rows(spark, d)).where("url is not null")
    once = held.groupBy("url").agg(*[F.max(c).alias(c) for c in held.columns if c not in ("url", "page_id")])
    return items.chunk_records(ledger.line_chunks(now), once)


_STARTED, _UPDATED = "2024-02-15 00:00:00", "2024-02-15 01:00:00"
_OLD_ROWS = f"(SELECT o.url, content_hash, deleted, version, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS chunk_count FROM {corpus._OLD} o)"
_RUN_ITEMS = f"(SELECT url, type, title, category, CAST(len(string_split({corpus._SQ}, ' ')) AS BIGINT) AS word_count FROM {corpus._ITEMS} WHERE snapshot_id = {corpus._LAST})"


@query(f"""WITH st AS ({corpus._STATUS}), c AS (SELECT n.* FROM {_CHUNKS} n JOIN st USING (url) WHERE st.status <> 'UNCHANGED'), k AS (SELECT * FROM {corpus._chunk_sql(corpus._OLD)}),
nw AS (SELECT c.url, count(*) AS new FROM c ANTI JOIN k ON c.url = k.url AND c.chunk_id = k.chunk_id AND c.text_hash = k.text_hash GROUP BY 1),
gn AS (SELECT k.url, count(*) AS gone FROM k JOIN st ON k.url = st.url AND st.status <> 'UNCHANGED' ANTI JOIN c ON k.chunk_id = c.chunk_id GROUP BY 1),
ct AS (SELECT url, count(*) AS own FROM c GROUP BY 1),
r AS (SELECT i.*, st.hash, st.status, coalesce(new, 0) AS new, coalesce(gone, 0) AS gone, coalesce(own, 0) AS own FROM {_RUN_ITEMS} i JOIN st USING (url) LEFT JOIN nw USING (url) LEFT JOIN gn USING (url) LEFT JOIN ct USING (url))
SELECT coalesce(r.url, o.url) AS url, r.type, r.title, r.category, r.word_count, coalesce(r.hash, o.content_hash) AS content_hash,
  CAST(CASE WHEN r.url IS NULL OR r.status = 'UNCHANGED' THEN coalesce(o.chunk_count, 0) ELSE r.own END AS BIGINT) AS chunk_count,
  CASE WHEN r.url IS NOT NULL THEN '{_STARTED}' ELSE '2024-01-01' END AS last_seen_at, CASE WHEN r.url IS NOT NULL THEN false ELSE o.deleted END AS deleted,
  CAST(coalesce(o.version, 0) + CASE WHEN r.new > 0 OR r.status = 'NEW' OR (r.status = 'MODIFIED' AND r.gone > 0 AND r.new = 0) THEN 1 ELSE 0 END AS BIGINT) AS version,
  CASE WHEN r.new > 0 OR (r.status = 'MODIFIED' AND r.gone > 0 AND r.new = 0) THEN '{_UPDATED}' WHEN o.url IS NOT NULL THEN '2024-01-01' END AS last_embedded_at
FROM r FULL JOIN {_OLD_ROWS} o ON r.url = o.url""")
def ledger_pages_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole page ledger after the latest run."""
    now, old = corpus._runs(spark, d)
    every = items.items(pages(spark, d), pdfs(spark, d))
    last = snapshot_diff.snapshot_ranks(snaps(spark, d)).where("next_id is null").select("snapshot_id")
    run = every.join(F.broadcast(last), "snapshot_id")
    none = F.lit(None).cast("string")
    stamp = F.lit("2024-01-01")
    held = old.select("url", none.alias("type"), none.alias("title"), none.alias("category"), F.lit(None).cast("bigint").alias("word_count"), "content_hash", F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).cast("bigint").alias("chunk_count"), stamp.alias("last_seen_at"), "deleted", "version", stamp.alias("last_embedded_at"))
    return ledger.page_rows(run, ledger.page_plan(now, old), ledger.line_chunks(now), ledger.line_chunks(old), held, F.lit(_STARTED), F.lit(_UPDATED))


@query(f"SELECT count(*) AS pages, count(*) FILTER (WHERE NOT deleted) AS active FROM {corpus._OLD}")
def ledger_active(spark: SparkSession, d: str) -> DataFrame:
    old = corpus._runs(spark, d)[1]
    return old.agg(F.count("*").alias("pages"), F.count_if(~F.col("deleted")).alias("active"))


@query("SELECT label, count(*) AS vectors FROM embeddings GROUP BY 1")
def vector_namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by namespace (their label)."""
    return emb(spark, d).groupBy("label").agg(F.count("*").alias("vectors"))


@query("SELECT (SELECT count(*) FROM pages) AS total_pages, (SELECT count(*) FROM pdfs) AS total_pdfs, (SELECT count(*) FROM links) AS total_links, (SELECT count(*) FROM links WHERE link_type = 'image') AS total_images, (SELECT count(*) FROM pages) AS categorized_pages")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return statistics(pages(spark, d), pdfs(spark, d), link_rows(spark, d))


# Search and answers ------------------------------------------------------------------------------------------------


@query(f"SELECT q_id, vec_id, score, place FROM {_TOP} WHERE score >= {LEAST_SCORE}")
def cosine_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The best hits of all queries at once, over a least score."""
    v = emb(spark, d)
    return vectors.top_k(v, v.where(f"vec_id % {corpus.EVERY} = 0").select(F.col("vec_id").alias("q_id"), "embedding"), least=LEAST_SCORE)


_MATCHED = f"SELECT * FROM ({corpus.ORACLES['link_match']})"


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    db = links.link_database(link_rows(spark, d), pages(spark, d), pdfs(spark, d)).withColumn("first", F.struct("first.a", "first.b"))
    return corpus.QUERIES["link_match"](spark, d), db


@query(f"""WITH db AS ({_LINK_DB}), l AS (SELECT key, first_kind, first_id, lower(text) AS t FROM db WHERE text <> '' AND starts_with(key, 'pdf_')),
h AS (SELECT DISTINCT q_id, key, first_kind, first_id FROM {_TOP} t JOIN documents d ON t.vec_id = d.doc_id JOIN l ON contains(lower(d.text), l.t))
SELECT q_id, key, rank FROM (SELECT q_id, key, row_number() OVER (PARTITION BY q_id ORDER BY first_kind, first_id, key) AS rank FROM h) WHERE rank <= 5""")
def doc_link_match(spark: SparkSession, d: str) -> DataFrame:
    """File links whose text lies in a document retrieved for a question."""
    return matching.document_links(corpus._hits(spark, d), docs(spark, d), _linked(spark, d)[1])


@query(f"""WITH m AS ({_MATCHED}), db AS ({_LINK_DB})
SELECT q_id, 'Relevant Links Available:' || chr(10) || string_agg('• ' || coalesce(text, '') || ': ' || coalesce(url, '') || CASE WHEN type = 'pdf' THEN ' (PDF Document)' ELSE ' (Web Page)' END, chr(10) ORDER BY rank) AS text FROM m JOIN db USING (key) GROUP BY 1""")
def links_context(spark: SparkSession, d: str) -> DataFrame:
    return matching.links_text(*_linked(spark, d))


@query(f"""WITH m AS ({_MATCHED}), db AS ({_LINK_DB}),
s AS (SELECT q_id, 0 AS k, place, d.url, d.title, score, left(coalesce(d.text, ''), 200) || '...' AS text, 'document' AS source FROM {_TOP} h JOIN documents d ON h.vec_id = d.doc_id
  UNION ALL SELECT q_id, 1, rank, url, text, 0.8, coalesce(nullif(context, ''), text), type FROM m JOIN db USING (key)),
f AS (SELECT *, row_number() OVER (PARTITION BY q_id, url ORDER BY k, place) AS n FROM s WHERE score >= {LEAST_SCORE})
SELECT q_id, url, title, score, text, source, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, k, place) AS rank FROM f WHERE n = 1 OR url IS NULL OR url = ''""")
def sources_with_links(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents and of matched links together."""
    matched, db = _linked(spark, d)
    return vectors.sources(corpus._hits(spark, d), docs(spark, d), LEAST_SCORE, vectors.link_sources(matched, db))


@query("SELECT count(*) FILTER (WHERE n > 1) AS hits, count(*) FILTER (WHERE n = 1) AS misses FROM (SELECT row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events)")
def cache_counters(spark: SparkSession, d: str) -> DataFrame:
    return replay.hit_counts(corpus.QUERIES["embed_cache_replay"](spark, d))


@query()
def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 visits of a crawl from the base urls."""
    edges = link_rows(spark, d).select(F.col("source_url").alias("source"), F.col("url").alias("target"), F.col("link_id").alias("ord"))
    return crawl.budgeted(edges, snaps(spark, d).select(F.col("base_url").alias("url"), F.col("snapshot_id").alias("ord")), 3, 500)


# An index that reaches the recall of 0.9 on these vectors: more tables of fewer bits. One table of 8 bits is the setting
# of lsh_best_hit.
TABLES, TABLE_BITS = 4, 4
_PLANE_SETS = [vectors.planes(TABLE_BITS, 64, f"table:{t}") for t in range(TABLES)]
_SIG_SQL = lambda ps: "(SELECT vec_id, CAST(" + " + ".join(f"CASE WHEN round(list_dot_product(CAST(embedding AS DOUBLE[]), [{', '.join(map(repr, p))}]::DOUBLE[]), 9) >= 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(ps)) + " AS BIGINT) AS sig FROM embeddings)"
_WIDE = "(" + " UNION ".join(f"SELECT q.vec_id AS q_id, v.vec_id FROM {_SIG_SQL(ps)} q JOIN {_SIG_SQL(ps)} v ON bit_count(xor(q.sig, v.sig)) <= 1 AND q.vec_id <> v.vec_id WHERE q.vec_id % {corpus.EVERY} = 0" for ps in _PLANE_SETS) + ")"


@query(f"""SELECT q_id, vec_id, score FROM (SELECT n.q_id, n.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score, row_number() OVER (PARTITION BY n.q_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, n.vec_id) AS r
FROM {_WIDE} n JOIN {corpus._V} q ON q.vec_id = n.q_id JOIN {corpus._V} v ON v.vec_id = n.vec_id) WHERE r = 1 AND score >= {LEAST_SCORE}""")
def lsh_wide_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best hit over several tables."""
    v = emb(spark, d)
    return vectors.best_hit(vectors.near_any(v.where(f"vec_id % {corpus.EVERY} = 0"), v, _PLANE_SETS, 1), v, LEAST_SCORE)
