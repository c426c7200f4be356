"""Lines repeated across one site's documents, by suffix arrays over line identifiers.

A document is its sequence of line identifiers; equal sequences of a document are kept once. A suffix is named by
prefix doubling: its name at level k stands for its first 2^k lines and is made of two names of level k - 1, inside the
row of its document. One global sort by (site, names) puts the suffixes of every site in an order in which all suffixes
that share their first 2^k lines are neighbours, at every level; ties are ordered by document, so that a line on a third
of all pages is spread over the sorted partitions like any other.

The intervals of common prefixes are read from that order in one pass over each sorted partition (a segment): equal names
of neighbours make an interval of depth 2^k, and an interval whose suffixes come from at least least documents is a
repeated block. Intervals at the ends of a segment may go on in the next one; each segment reports at most least distinct
documents of these, which is enough to decide them together.

A line is deleted where a repeated block covers it. If a block of several lines is repeated, so is each of its ends as
a block of its own, in the same documents; hence the covered lines are those at which a repeated block starts.

Documents are url keys, over all snapshots and rows. Lines are compared after squeezing white space, trimming,
lower-casing and taking every run of digits as the same.

Defined cases: blank lines belong to no block and end none; null and empty contents have no lines; rows without url are
left alone; a url without host counts to the site ''; equal copies of a row count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.pages import ids, line_arrays
from loam.storage import cut, sized

LEAST = 6
_SUFFIX = "seg int, seq_id bigint, place int, own bigint, head bigint, tail bigint, site bigint, level int, name bigint, docs array<bigint>"


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, site, doc, seq_id, seq, nos): identifiers of the lines that are not blank, and their line numbers."""
    held = line_arrays(pages.where("url is not null and content is not null"))
    full = F.filter(F.transform(ids(F.col("lines")), lambda x, i: F.struct(x.alias("id"), (i + 1).alias("no"))), lambda s: s["id"] != 0)
    named = held.select("page_id", F.xxhash64("site").alias("site"), F.xxhash64("url_key").alias("doc"), full.alias("full")).where(F.size("full") > 0)
    seq = F.transform("full", lambda s: s["id"])
    return named.select("page_id", "site", "doc", F.xxhash64("site", "doc", seq).alias("seq_id"), seq.alias("seq"), F.transform("full", lambda s: s["no"]).alias("nos"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(seq_id, site, doc, seq), each once."""
    return seqs.groupBy("seq_id").agg(*[F.first(c).alias(c) for c in ("site", "doc", "seq")])


def levels_of(seqs: DataFrame) -> int:
    """Levels of names: as many as the longest sequence needs."""
    return max(1, (seqs.agg(F.max(F.size("seq"))).first()[0] or 1).bit_length())


def suffixes(once: DataFrame, levels: int) -> DataFrame:
    """(site, names, doc, seq_id, place): one row for each suffix; names[k] stands for its first 2^k lines."""
    held = once.withColumn("__0", F.col("seq"))
    for k in range(1, levels):
        last, step = F.col(f"__{k - 1}"), 1 << (k - 1)
        # Two names of the level before, step lines apart, make one.
        pairs = F.zip_with(F.slice(last, 1, F.greatest(F.size(last) - step, F.lit(0))), F.slice(last, step + 1, F.size(last)), lambda a, b: F.xxhash64(a, b))
        held = held.withColumn(f"__{k}", F.when(F.size(last) > step, pairs).otherwise(F.array().cast("array<bigint>")))
    names = lambda i: F.filter(F.array(*[F.get(F.col(f"__{k}"), i) for k in range(levels)]), lambda x: x.isNotNull())
    each = F.transform(F.sequence(F.lit(0), F.size("seq") - 1), lambda i: F.struct(names(i).alias("names"), i.alias("place")))
    return held.select("site", "doc", "seq_id", F.explode(each).alias("x")).select("site", "x.names", "doc", "seq_id", "x.place")


def suffix_order(once: DataFrame, levels: int) -> DataFrame:
    """The suffixes in their order; hot lines are split, as ties are ordered by sequence and place."""
    return suffixes(once, levels).orderBy("site", "names", "seq_id", "place")


def intervals(order: DataFrame, least: int = LEAST) -> DataFrame:
    """Suffix rows with the levels (bits) whose interval is repeated (own) or lies at the segment's start or end (head,
    tail), and one row for each such open interval with at most least of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        held, seg = pa.Table.from_batches(rows), TaskContext.get().partitionId()
        whole = lambda c: pa.concat_arrays(held.column(c).chunks)
        site, doc = whole("site").to_numpy(), whole("doc").to_numpy()
        names = whole("names")
        offsets, values = names.offsets.to_numpy(), names.values.to_numpy()
        size, n = np.diff(offsets), held.num_rows
        code = np.unique(doc, return_inverse=True)[1].astype(np.int64)
        many = int(code.max()) + 1
        own, head, tail = (np.zeros(n, dtype=np.int64) for _ in range(3))
        ends: list[tuple[int, int, int, int, list[int]]] = []
        for k in range(int(size.max())):
            at = np.flatnonzero(size > k)
            name = values[offsets[at] + k]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (site[at[1:]] != site[at[:-1]]) | (at[1:] != at[:-1] + 1)
            group = np.cumsum(new) - 1
            count = np.bincount(np.unique(group * many + code[at]) // many, minlength=group[-1] + 1)
            bit = np.int64(1) << np.int64(k)
            own[at[count[group] >= least]] |= bit
            for side, mask, i, g, edge in ((0, head, 0, 0, 0), (1, tail, -1, group[-1], n - 1)):
                if at[i] == edge:
                    inside = at[group == g]
                    mask[inside] |= bit
                    ends.append((side, int(site[edge]), k, int(name[i]), np.unique(doc[inside])[:least].tolist()))
        i32, i64, docs = pa.int32(), pa.int64(), pa.list_(pa.int64())
        schema = pa.schema([("seg", i32), ("seq_id", i64), ("place", i32), ("own", i64), ("head", i64), ("tail", i64), ("site", i64), ("level", i32), ("name", i64), ("docs", docs)])
        none = lambda *kinds: [pa.nulls(m, kind) for kind in kinds]
        m = n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, seg), i32), whole("seq_id"), whole("place"), *map(pa.array, (own, head, tail)), *none(i64, i32, i64, docs)], schema=schema)
        m = len(ends)
        side, *rest = (pa.array([e[j] for e in ends], t) for j, t in enumerate((i32, i64, i32, i64, docs)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, seg), i32), *none(i64), side, *none(i64, i64, i64), *rest], schema=schema)

    return order.mapInArrow(run, _SUFFIX)


def block_starts(once: DataFrame, levels: int, least: int = LEAST) -> DataFrame:
    """(seq_id, place, depth): suffixes that begin with a repeated block; bit k of depth: one of 2^k lines."""
    held = cut(intervals(suffix_order(once, levels), least))
    ends = held.where("seq_id is null").select("seg", F.col("place").alias("side"), "site", "level", "name", "docs")
    # The intervals that segments leave open, decided over all segments.
    key = ["site", "level", "name"]
    kept = ends.select(*key, F.explode("docs").alias("doc")).distinct().groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    bits = lambda side: F.coalesce(F.bit_or(F.when(F.col("side") == side, F.expr("shiftleft(1L, level)"))), F.lit(0).cast("bigint"))
    open_ = sized(ends.join(kept, key).groupBy("seg").agg(bits(0).alias("head_kept"), bits(1).alias("tail_kept")))
    both = held.where("seq_id is not null").join(open_, "seg", "left").fillna(0, ["head_kept", "tail_kept"])
    part = lambda side: F.col(side).bitwiseAND(F.col(f"{side}_kept"))
    return both.select("seq_id", "place", F.col("own").bitwiseOR(part("head")).bitwiseOR(part("tail")).alias("depth")).where("depth <> 0")


def block_counts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(lines, blocks, most_docs): the distinct repeated blocks of 1, 2, 4, ... lines, and the most documents of one."""
    once = cut(distinct_sequences(sequences(pages)))
    levels = levels_of(once)
    named = suffixes(once, levels).join(block_starts(once, levels, least), ["seq_id", "place"])
    each = named.select("site", "doc", "depth", F.posexplode("names").alias("level", "name")).where(F.expr("(shiftright(depth, level) & 1) = 1"))
    docs = each.select("site", "level", "name", "doc").distinct().groupBy("site", "level", "name").agg(F.count("*").alias("docs"))
    return docs.groupBy(F.expr("shiftleft(1L, level)").alias("lines")).agg(F.count("*").alias("blocks"), F.max("docs").alias("most_docs"))


def repeated_lines(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, line_no): the lines of every page that a repeated block covers."""
    seqs = cut(sequences(pages))
    once = distinct_sequences(seqs)
    starts = block_starts(once, levels_of(seqs), least).groupBy("seq_id").agg(F.collect_list("place").alias("places"))
    both = seqs.select("page_id", "seq_id", "nos").join(starts, "seq_id")
    return both.select("page_id", F.explode(F.transform("places", lambda i: F.get("nos", i))).alias("line_no"))


def remove_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, content): every content without its found lines; contents without such lines stay as they are."""
    drop = found.groupBy("page_id").agg(F.collect_set("line_no").alias("__drop"))
    kept = F.array_join(F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains("__drop", i + 1)), "\n")
    return pages.select("page_id", "content").join(drop, "page_id", "left").select("page_id", F.when(F.col("__drop").isNull(), F.col("content")).otherwise(kept).alias("content"))
