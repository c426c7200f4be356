"""Main content of pages, by a style tree of each site.

A page is a tree: its lines and lists hang below the page; a line cut by separators (a trail) is a branch with its parts
below it, a list a branch with its items. The pages of a host are merged into one tree. Content nodes are the texts of
lines and items (compared with digits and letter case masked). Elements are branches that begin alike: trails with the
same first part, lists with the same first item. Presentations of an element are the forms it takes: the number of parts
of a trail, the items of a list.

Importance is counted in bits. A content node on k of the m pages of a host has log2 m less the entropy of the node over
pages, which is log2 k as a page counts once: -log2(k / m). An element with l presentations has the entropy H of its
presentations, and a branch the composite (1 - GAMMA^l) * H + GAMMA^l * (importance of its content), where the content of a
trail is its first part and that of a list the median of its items; an item that is on several pages of the host, or that
is the title of another page, has no content of its own, any other has all. Branches and content nodes of at most
LEAST_BITS are pruned, a list together with the lines of its items, and the heading above a pruned list of other pages'
titles (a side box). A second tree merges all hosts that have a node, for nodes on few pages of a host. The page's own
title, headings and table rows are never pruned.

Pages are url keys. Defined cases: null content has no lines, null lists no items; rows without url are compared as
pages of the site '' of their own; blank lines are neither frame nor body; a node in fewer than LEAST_PAGES pages of a
host is judged by the tree of all hosts; equal copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.urls import site, url_key
from loam.llm.pages import norm, norm_lines
from loam.storage import cut, sized

#: Information (bits) up to which a node is frame: it is on a tenth of the pages or more.
LEAST_BITS = 3.33
LEAST_PAGES, LEAST_PAGES_ALL = 3, 6
#: Weight of content against presentation, by presentation.
GAMMA = 0.9
# Separators between the parts of trails and menus.
SEPARATORS = r" (?:>|»|/|\||·|›|→) "


def _id(text: Column) -> Column:
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(text))


def _ids(texts: Column) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.coalesce(_id(norm(x)), F.lit(0).cast("bigint")))


def views(pages: DataFrame) -> DataFrame:
    """One row for each page: identifiers of its nodes. trails holds node 0 for lines without separators."""
    where = F.coalesce(site(F.col("url")), F.lit(""))
    lines = norm_lines(F.coalesce("content", F.lit("")))
    rows = F.flatten(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: F.transform(F.coalesce(t, F.array().cast("array<array<string>>")), lambda r: F.array_join(r, " "))))
    held = pages.select("page_id", F.xxhash64(where).alias("site"), F.xxhash64(F.coalesce(url_key(F.col("url")), F.concat(F.lit("#"), F.col("page_id").cast("string")))).alias("doc"), "title", "headings", "lists", rows.alias("rows"), lines.alias("text"))
    trail = lambda parts: F.struct(F.xxhash64(F.lit("trail"), parts[0]).alias("node"), F.size(parts).cast("bigint").alias("style"))
    no_trail = F.struct(F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("style"))
    held = held.select(
        "page_id",
        "site",
        "doc",
        F.coalesce(_id(norm(F.col("title"))), F.lit(0)).alias("title"),
        F.transform("text", _id).alias("lines"),
        F.transform("text", lambda x: F.when(x.rlike(SEPARATORS), trail(F.split(x, SEPARATORS, -1))).otherwise(no_trail)).alias("trails"),
        F.transform(F.coalesce("lists", F.array().cast("array<array<string>>")), _ids).alias("lists"),
        F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,id:string>>")), lambda h: F.coalesce(_id(norm(h["text"])), F.lit(0).cast("bigint"))).alias("heads"),
        _ids(F.col("rows")).alias("rows"),
    )
    element = lambda xs: F.struct(F.when(F.size(xs) > 0, F.xxhash64(F.lit("list"), xs[0])).otherwise(F.lit(0).cast("bigint")).alias("node"), F.xxhash64(xs).alias("style"))
    return held.withColumn("boxes", F.transform("lists", element))


def _nodes() -> Column:
    """The nodes of a view, each with its presentation: content nodes have one only."""
    plain = F.transform(F.concat("lines", F.flatten("lists")), lambda x: F.struct(x.alias("node"), F.lit(0).cast("bigint").alias("style")))
    return F.filter(F.array_distinct(F.concat(plain, "trails", "boxes")), lambda x: x["node"] != 0)


def tree(held: DataFrame) -> DataFrame:
    """(site, node, frame, title, often, rich): nodes with a verdict; others are on one page only and body. rich marks
    lists whose presentations alone make them important."""
    each = held.select("site", "doc", F.explode(_nodes()).alias("x")).select("site", "doc", "x.node", "x.style").distinct()
    styles = each.groupBy("site", "node", "style").agg(F.count("*").alias("n"))
    own = styles.groupBy("site", "node").agg(F.sum("n").alias("k"), F.count("*").alias("l"), F.max("style").alias("style"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("spread"))
    titled = held.where("title <> 0").select("site", F.col("title").alias("node")).distinct().withColumn("titled", F.lit(True))
    hosts = held.select("site", "doc").distinct().groupBy("site").agg(F.count("*").alias("m"))
    sized = own.join(hosts, "site")
    every = sized.groupBy("node").agg(F.sum("k").alias("ka"), F.sum("m").alias("ma"), F.max("k").alias("most")).where("most > 1 or ka > 1").drop("most")
    bits = lambda k, m: -F.log2(F.col(k) / F.col(m))
    held_back = F.pow(F.lit(GAMMA), F.col("l"))
    is_branch = F.col("style") != 0
    shape = F.when(is_branch, (1 - held_back) * F.col("spread")).otherwise(0.0)
    low = lambda k, m: shape + F.when(is_branch, held_back).otherwise(1.0) * bits(k, m) <= LEAST_BITS
    judged = sized.join(every, "node").withColumn("frame", F.when(F.col("k") >= LEAST_PAGES, low("k", "m")).otherwise((F.col("ka") >= LEAST_PAGES_ALL) & low("ka", "ma"))).withColumn("rich", shape > LEAST_BITS)
    out = judged.select("site", "node", "frame", (F.col("k") > 1).alias("often"), "rich").where("frame or often")
    flags = [F.coalesce(c, F.lit(False)).alias(c if c != "titled" else "title") for c in ("frame", "titled", "often", "rich")]
    return out.join(titled, ["site", "node"], "full").select("site", "node", *flags)


_FLAGS = ("frame", "title", "often", "rich")


def judged_views(held: DataFrame) -> DataFrame:
    """Views with the sets of their nodes that have each flag."""
    nodes = F.array_distinct(F.transform(_nodes(), lambda x: x["node"]))
    each = held.select("page_id", "site", F.explode(nodes).alias("node"))
    hits = each.join(sized(tree(held)), ["site", "node"]).groupBy("page_id").agg(*[F.collect_list(F.when(F.col(c), F.col("node"))).alias(f"__{c}") for c in _FLAGS])
    none = F.array().cast("array<bigint>")
    return held.join(hits, "page_id", "left").withColumns({f"__{c}": F.coalesce(f"__{c}", none) for c in _FLAGS})


def frame_nodes(judged: DataFrame) -> DataFrame:
    """(page_id, field, pos): lines and lists that are not main body."""
    has = lambda name, x: F.array_contains(F.col(name), x)
    aside = lambda x: has("__title", x) & (x != F.col("title"))
    count = lambda xs, test: F.size(F.filter(xs, test))
    # The median item has no content of its own, and the presentations of the list do not make up for it.
    verdict = lambda xs: (F.size(xs) > 0) & (2 * count(xs, lambda x: has("__frame", x) | aside(x) | has("__often", x)) >= F.size(xs)) & ~has("__rich", F.xxhash64(F.lit("list"), xs[0]))
    side = lambda xs: verdict(xs) & F.exists(xs, aside)
    held = judged.withColumn("__lists", F.transform("lists", verdict))
    held = held.withColumn("__in", F.flatten(F.filter("lists", verdict))).withColumn("__side", F.flatten(F.filter("lists", side)))
    # The next line that is not blank, for headings of side boxes.
    nxt = F.transform("lines", lambda x, i: F.element_at(F.concat(F.filter(F.slice("lines", i + 2, 4), lambda y: y != 0), F.array(F.lit(0).cast("bigint"))), 1))
    held = held.withColumn("__next", nxt)

    def line(x: Column, i: Column) -> Column:
        trail = F.element_at("trails", i + 1)["node"]
        own = (x == F.col("title")) | has("rows", x)
        heading = has("heads", x)
        return F.when((x == 0) | own, False).when(heading, has("__side", F.element_at("__next", i + 1))).otherwise(has("__frame", x) | has("__in", x) | ((trail != 0) & has("__frame", trail)))

    positions = lambda flags: F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())
    lines = held.select("page_id", F.lit("content").alias("field"), F.explode(positions(F.transform("lines", line))).alias("pos"))
    lists = held.select("page_id", F.lit("lists").alias("field"), F.explode(positions(F.col("__lists"))).alias("pos"))
    return lines.unionByName(lists)


def frames(pages: DataFrame) -> DataFrame:
    return frame_nodes(judged_views(cut(views(pages))))


def main_body(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, content): contents without frame lines."""
    drop = found.where("field = 'content'").groupBy("page_id").agg(F.collect_set("pos").alias("__drop"))
    kept = F.array_join(F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains("__drop", i + 1)), "\n")
    return pages.select("page_id", "content").join(drop, "page_id", "left").select("page_id", F.when(F.col("__drop").isNull(), F.col("content")).otherwise(kept).alias("content"))
