"""Which texts lie in which others, and the links that fit a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.operators.links import LINKS_PER_QUESTION

#: Characters of the substrings that needles are looked up by.
GRAM = 8


def substrings(c: Column, n: int) -> Column:
    """Distinct substrings of length n."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(hays: DataFrame, needles: DataFrame, gram: int = GRAM) -> DataFrame:
    """(h_id, n_id): needles (n_id, needle) that lie in hays (h_id, hay) as a substring; empty needles in none.

    A needle is looked up by the rarest of its substrings of gram characters (by itself if it is shorter): one that
    occurs in no hay drops it, and only hays that have the rarest one are looked at. No pair is formed without it.
    """
    some = needles.where("n_id is not null and needle <> ''").withColumn("n", F.least(F.length("needle"), F.lit(gram)))
    lengths = sorted(r["n"] for r in some.select("n").distinct().collect())  # gram values at most
    if not lengths:
        return hays.select("h_id").limit(0).join(needles.select("n_id").limit(0))
    parts = lambda c: F.flatten(F.array(*[substrings(F.col(c), n) for n in lengths]))
    index = hays.where("hay is not null").select("h_id", F.explode(parts("hay")).alias("g"))
    counts = index.groupBy("g").agg(F.count("*").alias("c"))
    own = F.coalesce(*[F.when(F.col("n") == n, substrings(F.col("needle"), n)) for n in lengths])
    each = some.select("n_id", F.explode(own).alias("g")).join(counts, "g", "left")
    rarest = each.groupBy("n_id").agg(F.min(F.coalesce("c", F.lit(0))).alias("c"), F.min_by("g", F.struct("c", "g")).alias("g")).where("c > 0").select("n_id", "g")
    near = rarest.join(index, "g").select("n_id", "h_id")
    return near.join(some.select("n_id", "needle"), "n_id").join(hays.select("h_id", "hay"), "h_id").where(F.contains("hay", F.col("needle"))).select("h_id", "n_id")


def _first(links: DataFrame, by: str, most: int) -> DataFrame:
    """The first links of each value of by: no question takes more."""
    return links.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy("first", "key"))).where(F.col("__n") <= most).drop("__n")


def match_links(questions: DataFrame, links: DataFrame, most: int = LINKS_PER_QUESTION) -> DataFrame:
    """(q_id, key, rank): the first links that fit each question (q_id, question).

    A link (key, first, text, category) fits if its text lies in the question, the question in its text, or its
    category in the question, letter case aside; an empty text lies in every question. Null texts count as empty, null
    questions take no part.
    """
    q = questions.where("question is not null").select("q_id", F.lower("question").alias("question"))
    low = links.select("key", "first", F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.nullif("category", F.lit("")).alias("category"))
    texts = low.where("t <> ''").select("t").distinct()
    by_text = _first(low, "t", most)
    forth = contained(q.select(F.col("q_id").alias("h_id"), F.col("question").alias("hay")), texts.select(F.col("t").alias("n_id"), F.col("t").alias("needle"))).select(F.col("h_id").alias("q_id"), F.col("n_id").alias("t"))
    back = contained(texts.select(F.col("t").alias("h_id"), F.col("t").alias("hay")), q.select(F.col("q_id").alias("n_id"), F.col("question").alias("needle"))).select(F.col("n_id").alias("q_id"), F.col("h_id").alias("t"))
    hits = forth.unionByName(back).distinct().join(by_text, "t").select("q_id", "key", "first")
    cats = low.where("category is not null").select("category").distinct()
    named = contained(q.select(F.col("q_id").alias("h_id"), F.col("question").alias("hay")), cats.select(F.col("category").alias("n_id"), F.col("category").alias("needle"))).select(F.col("h_id").alias("q_id"), F.col("n_id").alias("category"))
    hits = hits.unionByName(named.join(_first(low.where("category is not null"), "category", most), "category").select("q_id", "key", "first"))
    # An empty question lies in every text; empty texts lie in every question: the first few links decide both.
    none = by_text.where("t = ''").orderBy("first", "key").limit(most).select("key", "first")
    every = low.orderBy("first", "key").limit(most).select("key", "first")
    hits = hits.unionByName(q.select("q_id").join(F.broadcast(none))).unionByName(q.where("question = ''").select("q_id").join(F.broadcast(every)))
    ranked = hits.distinct().withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("first", "key")))
    return ranked.where(F.col("rank") <= most).select("q_id", "key", F.col("rank").cast("bigint").alias("rank"))


def document_links(hits: DataFrame, docs: DataFrame, links: DataFrame, most: int = LINKS_PER_QUESTION) -> DataFrame:
    """(q_id, key, rank): the first file links whose text lies in a document (doc_id, text) retrieved for the question.

    hits are (q_id, vec_id). Links with empty text are left out: they lie in every document.
    """
    low = links.where(F.startswith("key", F.lit("pdf_"))).select("key", "first", F.lower("text").alias("t")).where("t <> ''")
    met = docs.join(hits.select(F.col("vec_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = contained(met.select(F.col("doc_id").alias("h_id"), F.lower("text").alias("hay")), low.select("t").distinct().select(F.col("t").alias("n_id"), F.col("t").alias("needle")))
    by_doc = hits.select("q_id", F.col("vec_id").alias("h_id")).join(pairs, "h_id").select("q_id", F.col("n_id").alias("t")).distinct()
    found = by_doc.join(_first(low, "t", most), "t").select("q_id", "key", "first").distinct()
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("first", "key")))
    return ranked.where(F.col("rank") <= most).select("q_id", "key", F.col("rank").cast("bigint").alias("rank"))


def links_text(matched: DataFrame, links: DataFrame) -> DataFrame:
    """(q_id, text): the matched links of each question as lines; only the type pdf is named a file."""
    held = matched.join(links.select("key", "type", "url", "text"), "key")
    line = F.concat(F.lit("• "), F.coalesce("text", F.lit("")), F.lit(": "), F.coalesce("url", F.lit("")), F.when(F.col("type") == "pdf", " (PDF Document)").otherwise(" (Web Page)"))
    return held.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x")).select("q_id", F.concat(F.lit("Relevant Links Available:\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))
