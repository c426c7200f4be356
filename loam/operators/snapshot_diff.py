"""What changed between full snapshots.

Every snapshot is unpivoted into cells (kind, key, field, value digest) and one presence cell for each key.
The comparison of snapshot r with r-1 counts the cells of r as +1 and those of r-1 as -1; equal cells cancel
in a grouped sum, so only differences survive. A second sum by key reads the class from the signs: presence +1
is added, -1 removed, and a key whose presence cancels but whose fields do not is changed in those fields.

Values travel as digests (two 64-bit words and the length), so the shuffle does not grow with the texts.

Defined cases: a row without a snapshot that is listed, or without a url, has no identity and takes no part; null
content equals empty content; of repeated captures the latest ts (null is earliest), then the highest id, stands;
equal copies of a row change nothing; an empty table gives no rows; columns other than the named ones are ignored.
Ties in taken_at are ordered by snapshot_id; snapshots without taken_at come first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.functions.text import squeeze
from loam.functions.urls import url_key

PRESENCE = ""


def digest(c: Column) -> Column:
    """A comparable digest of a value of any length."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit("#"), F.reverse(v)).alias("b"), F.length(v).alias("n"))


def snapshot_ranks(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, rank, next_id): one row per snapshot in the order of taken_at."""
    one = snapshots.select("snapshot_id", "taken_at").where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max("taken_at").alias("taken_at"))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("taken_at").asc_nulls_first(), "snapshot_id")
    return one.select("snapshot_id", F.lead("snapshot_id").over(order).alias("next_id"), F.row_number().over(order).alias("rank"))


def latest(rows: DataFrame, kind: str, id_col: str, fields: Mapping[str, Column]) -> DataFrame:
    """The row that stands for each (snapshot, key): latest ts, then highest id; fields as digests."""
    cells = F.struct(*[digest(c).alias(name) for name, c in fields.items()])
    return (
        rows.where(F.col("url").isNotNull() & F.col("snapshot_id").isNotNull())
        .select("snapshot_id", F.lit(kind).alias("rec_kind"), url_key(F.col("url")).alias("url_key"), F.struct("ts", id_col).alias("__at"), cells.alias("__cells"))
        .groupBy("snapshot_id", "rec_kind", "url_key")
        .agg(F.max_by("__cells", "__at").alias("__cells"))
    )


def signed_cells(standing: DataFrame, ranks: DataFrame, fields: list[str]) -> DataFrame:
    """Unpivot standing rows into (snapshot_id compared, rec_kind, url_key, field, value, sign)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("n"))
    cell = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    unpivoted = F.array(cell(PRESENCE, zero), *[cell(f, F.col(f"__cells.{f}")) for f in fields])
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("rank") > 1, F.col("snapshot_id")).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("next_id").alias("at"), F.lit(-1).alias("sign")),
        ),
        lambda s: s["at"].isNotNull(),
    )
    return (
        standing.join(ranks, "snapshot_id")
        .select("rec_kind", "url_key", F.explode(sides).alias("side"), unpivoted.alias("cells"))
        .select("side.at", "side.sign", "rec_kind", "url_key", F.explode("cells").alias("cell"))
        .select(F.col("at").alias("snapshot_id"), "rec_kind", "url_key", "cell.field", "cell.value", "sign")
    )


def diff(cells: DataFrame) -> DataFrame:
    """(snapshot_id, rec_kind, url_key, change, changed_fields) from signed cells."""
    key = ["snapshot_id", "rec_kind", "url_key"]
    surviving = cells.groupBy(*key, "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    return (
        surviving.groupBy(*key)
        .agg(F.coalesce(F.sum(F.when(F.col("field") == PRESENCE, F.col("n"))), F.lit(0)).alias("p"), F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("changed_fields"))
        .select(*key, F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed").alias("change"), F.when(F.col("p") == 0, F.col("changed_fields")).otherwise(F.array()).alias("changed_fields"))
    )


#: Fields that are compared unless others are named: the content of a page, the text of a file.
PAGE_FIELDS, PDF_FIELDS = ("content",), ("text",)


def snapshot_changes(snapshots: DataFrame, pages: DataFrame, pdfs: DataFrame, page_fields: tuple[str, ...] = PAGE_FIELDS, pdf_fields: tuple[str, ...] = PDF_FIELDS) -> DataFrame:
    """Changes of pages and pdfs between consecutive snapshots, in the named fields; texts are compared squeezed, other
    fields as JSON, and null counts as empty."""

    def value(df: DataFrame, c: str) -> Column:
        text = df.schema[c].dataType.simpleString() == "string"
        return squeeze(F.coalesce(c, F.lit(""))) if text else F.to_json(F.struct(c))

    ranks = snapshot_ranks(snapshots)
    both = []
    for df, kind, id_col, names in ((pages, "page", "page_id", page_fields), (pdfs, "pdf", "pdf_id", pdf_fields)):
        standing = latest(df, kind, id_col, {c: value(df, c) for c in names})
        both.append(signed_cells(standing, ranks, list(names)))
    return diff(both[0].unionByName(both[1]))
