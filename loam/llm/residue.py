"""Template residue and error-page text.

Messages are the titles and lines of pages (digits masked). Templates are mined with a fixed-depth prefix tree: a message
goes to the leaf of its number of words and its first DEPTH words (words with digits alike); in a leaf, a word stays if more than
SAME of the leaf's distinct messages have it at that place, and becomes <*> else. A message that keeps fewer than SIMILAR of
its words is not like its leaf and makes a template of its own. Each template is classified once: a text model (see
notices) gives log odds, and the share of its pages that have no prose besides it adds to or takes from them, as a
notice that stands instead of real text stands alone. Verdicts go back to the lines through their templates.

A template that is common on a site, or on sites in general, while most of its pages do have prose besides it is part of the frame
and no case there; a site on which many pages are broken is no such site. Unresolved slots inside ordinary text are
found apart, by sentence; a sentence that explains a slot is no case.

Defined cases: null titles and contents have no messages; blank lines none; rows without url count to the site ''; equal
copies of a row have equal verdicts; messages may have any length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.urls import site, url_key
from loam.llm.notices import text_model
from loam.llm.pages import norm_text
from loam.storage import cut, sized

#: Words of a message that the tree looks at; share of a leaf's messages that make a word fixed; share of fixed words
#: that makes a message like its leaf.
DEPTH, SAME, SIMILAR = 3, 0.5, 0.5
#: Least score of residue; weight of standing alone in it.
LEAST_SCORE, ALONE = 0.8, 0.6
#: A template on so many pages of a site, as a share of them, may belong to the frame.
FRAME_SHARE, FRAME_PAGES, FRAME_PAGES_ALL = 0.1, 3, 6
#: Characters of a line of prose.
PROSE = 120

# Shapes of unfilled slots, by a sign that each has.
SLOTS = {
    "{": (r"\{\{ ?[A-Za-z_][\w .]* ?\}\}", r"\$\{[A-Za-z_][\w.]*\}", r"\{[A-Za-z_]{4,}\}"),
    "[": (r"\[\[ ?[A-Za-z_][\w ]* ?\]\]", r"\[(?i:insert|enter|your|add) [A-Za-z ]+\]"),
    "<": (r"<%=? ?[\w.]+ ?%>", r"<[A-Za-z]+(?:_[A-Za-z]+)*>"),
    "#": (r"(?<![\w#])#[A-Za-z]+(?:_[A-Za-z]+)*#",),
    "%": (r"(?<![\w%])%[A-Za-z]+(?:_[A-Za-z]+)*%",),
    "__": (r"(?<![\w])__[A-Za-z]+(?:_[A-Za-z]+)*__",),
}
#: Words of a sentence that explains a slot.
EXPLAINED = r"(?i)\b(?:explains?|marks? the spot|stands? for|is written as|placeholders?|denotes?|means that|shows? how)\b"
# Words of which any prose has one (English, Hindi).
_PROSE_WORDS = (" the ", " of ", " and ", " to ", " in ", " for ", "ा")


def is_prose(message: Column) -> Column:
    words = F.contains(message, F.lit(_PROSE_WORDS[0]))
    for w in _PROSE_WORDS[1:]:
        words = words | F.contains(message, F.lit(w))
    ended = F.endswith(message, F.lit("."))
    for sign in (". ", "।", "?"):
        ended = ended | F.contains(message, F.lit(sign))
    return (F.length(message) >= PROSE) & ended & words


def with_slot(text: Column) -> Column:
    """Whether a text has the shape of a slot; a pattern is tried only where its sign stands."""
    out = F.lit(False)
    for sign, shapes in SLOTS.items():
        out = out | (F.contains(text, F.lit(sign)) & text.rlike("|".join(f"(?:{x})" for x in shapes)))
    return out


def has_slot(text: Column) -> Column:
    """Whether a sentence of the text has an unfilled slot without explaining it."""
    sentences = F.split(text, r"\n|(?<=[.?!।])\s+(?=[A-Z])")
    return F.when(with_slot(text), F.exists(sentences, lambda s: with_slot(s) & ~s.rlike(EXPLAINED))).otherwise(False)


def messages(pages: DataFrame) -> DataFrame:
    """(page_id, site, doc, messages, prose, slot): distinct messages of each page, and its lines of prose."""
    text = norm_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), "content"))
    lines = F.filter(F.array_distinct(F.split(F.trim(text), " ?\n ?", -1)), lambda m: m != "")
    held = pages.select("page_id", F.xxhash64(F.coalesce(site(F.col("url")), F.lit(""))).alias("site"), F.xxhash64(F.coalesce(url_key(F.col("url")), F.lit(""))).alias("doc"), lines.alias("messages"), has_slot(F.concat_ws("\n", "title", "content")).alias("slot"))
    return held.withColumn("prose", F.size(F.filter("messages", is_prose)))


def each_message(held: DataFrame) -> DataFrame:
    """(page_id, site, doc, message, alone): alone if the page has no prose besides the message."""
    each = held.select("page_id", "site", "doc", "prose", F.explode("messages").alias("message"))
    return each.select("page_id", "site", "doc", "message", (F.col("prose") - is_prose(F.col("message")).cast("int") == 0).alias("alone"))


def leaf(words: Column) -> Column:
    """The leaf of a message in the tree."""
    path = F.transform(F.slice(words, 1, DEPTH), lambda w: F.when(F.contains(w, F.lit("0")), F.lit("<*>")).otherwise(w))
    return F.xxhash64(F.size(words), F.array_join(path, " "))


def templates(once: DataFrame) -> DataFrame:
    """(message, template, ...) of distinct messages; other columns are kept."""
    held = once.withColumn("__words", F.split("message", " ")).withColumn("__leaf", leaf(F.col("__words")))
    sizes = held.groupBy("__leaf").agg(F.count("*").alias("__size")).where(F.col("__size") > 1)
    shared = held.join(sizes, "__leaf")
    words = shared.select("__leaf", "__size", F.posexplode("__words").alias("__at", "__w"))
    fixed = words.groupBy("__leaf", "__at", "__w").agg(F.count("*").alias("__n"), F.first("__size").alias("__size")).where(F.col("__n") > SAME * F.col("__size"))
    shape = sized(fixed.groupBy("__leaf").agg(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__w").alias("w"))).alias("__fixed")))
    kept = F.transform("__words", lambda w, i: F.when(F.array_contains(F.col("__fixed"), F.struct(i.alias("at"), w.alias("w"))), w).otherwise("<*>"))
    made = held.join(shape, "__leaf", "left").withColumn("__kept", kept)
    like = F.size(F.filter("__kept", lambda w: w != "<*>")) >= SIMILAR * F.size("__words")
    return made.withColumn("template", F.when(F.col("__fixed").isNotNull() & like, F.array_join("__kept", " ")).otherwise(F.col("message"))).select(*once.columns, "template")


def residue_templates(mined: DataFrame) -> DataFrame:
    """(template): templates of (template, n, alone) that are residue."""

    model = text_model()

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            alone = ALONE * (2 * b["alone"] / b["n"] - 1)
            score = b["template"].map(model.score).astype(float) + alone
            yield b.loc[score > LEAST_SCORE, ["template"]]

    return mined.groupBy("template").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone")).mapInPandas(classify, "template string")


def framed(lines: DataFrame, hosts: DataFrame) -> DataFrame:
    """(site, tid): templates of lines (site, doc, tid, alone) that belong to the frame of a site."""
    used = lines.groupBy("site", "tid").agg(F.count_distinct("doc").alias("k"), F.avg(F.col("alone").cast("double")).alias("alone"), F.count("*").alias("n")).join(hosts, "site")
    every = used.groupBy("tid").agg(F.sum("k").alias("ka"), F.sum("m").alias("ma"), (F.sum(F.col("alone") * F.col("n")) / F.sum("n")).alias("alone_all"))
    here = (F.col("k") >= FRAME_PAGES) & (F.col("k") >= FRAME_SHARE * F.col("m")) & (F.col("alone") < 0.5)
    anywhere = (F.col("ka") >= FRAME_PAGES_ALL) & (F.col("ka") >= FRAME_SHARE * F.col("ma")) & (F.col("alone_all") < 0.5)
    return used.join(every, "tid").where(here | anywhere).select("site", "tid")


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id): pages with residue in title or main body."""
    held = cut(messages(pages))
    each = each_message(held)
    once = each.groupBy("message").agg(F.count("*").alias("n"), F.count_if("alone").alias("alone"))
    mined = cut(templates(once))
    bad = mined.join(residue_templates(mined), "template").select(F.xxhash64("message").alias("id"), F.xxhash64("template").alias("tid"))
    lines = cut(each.withColumn("id", F.xxhash64("message")).join(sized(bad), "id").select("page_id", "site", "doc", "tid", "alone"))
    hosts = held.groupBy("site").agg(F.count_distinct("doc").alias("m"))
    found = lines.join(framed(lines, hosts), ["site", "tid"], "left_anti").select("page_id")
    return found.unionByName(held.where("slot").select("page_id")).distinct()


def clean_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages without the found rows."""
    return pages.join(found, "page_id", "left_anti")
